"""CSV uploads of any size: read in several tasks, numbered by the lines of the file, decoded by file.

A line feed ends a record only outside a quoted cell, which no byte range can tell by itself. So a first pass makes, of
each range that Spark reads, a summary: how many lines it has, and where it ends (between records, or in a quoted cell) if
it begins in the one or the other. Summaries are few; strung together in order they tell each range's first line, how it
begins, and which record is open there. A second pass cuts the records. One that crosses ranges is handed on in pieces and
put together by file and first line. The first pass also tells whether all bytes of a file are UTF-8; else it is Latin-1.
"""

from __future__ import annotations

import csv
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a record that are kept. What is longer is far over every limit of a row, which then is rejected for its text.
MOST = 1 << 24
HEADER_BYTES = 1 << 20
_QUOTED = rb'[^"]*+(?:""[^"]*+)*+'
_ENDS_OPEN = re.compile(rb'(?:(?>"' + _QUOTED + rb'"[^,]*+|[^",][^,]*+|),)*+"' + _QUOTED + rb"\Z")
_REST_OF_CELL = re.compile(_QUOTED)
BETWEEN, INSIDE = 0, 1


def ends(line: bytes, begins: int) -> int:
    """Whether the line feed after a line is between records or inside a quoted cell."""
    if b'"' not in line:
        return begins
    if begins == INSIDE:
        at = _REST_OF_CELL.match(line).end()
        comma = line.find(b",", at + 1)
        if at == len(line) or comma < 0:
            return INSIDE if at == len(line) else BETWEEN
        line = line[comma + 1 :]
    return INSIDE if _ENDS_OPEN.match(line) else BETWEEN


def cells_of(record: str) -> list[str]:
    """A record's cells; none of a blank line. A carriage return outside quotes is a blank, but at the end."""
    csv.field_size_limit(sys.maxsize)
    try:
        return next(csv.reader([record]), [])
    except csv.Error:
        return next(csv.reader([record.rstrip("\r").replace("\r", " ")]), [])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its range begins) and the bytes of each line, in order inside a range."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"))


_SUMMARY = "file string, block long, n long, after_between int, after_inside int, start_between long, start_inside long, utf8 boolean, header binary"


def _summaries(batches):
    """A row for each range: lines, where it ends for either beginning, and the line (from 0) at which the record that is
    open at its end begins (-1: before it)."""
    key, row, state, header, header_open = None, None, None, [], False

    def out():
        names = [c.split()[0] for c in _SUMMARY.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        values = [*key, row["n"], *state, *row["start"], row["utf8"], b"\n".join(header)[:HEADER_BYTES]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    for b in batches:
        for file, block, line, utf8 in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (file, block) != key:
                if key:
                    yield out()
                key, row, state, header, header_open = (file, block), {"n": 0, "start": [-1, -1], "utf8": True}, [BETWEEN, INSIDE], [], block == 0
            for begins in (0, 1):
                if state[begins] == BETWEEN:
                    row["start"][begins] = row["n"]
                state[begins] = ends(line, state[begins])
            if header_open:
                header.append(line)
                header_open = state[BETWEEN] == INSIDE
            row["n"] += 1
            row["utf8"] &= utf8
    if key:
        yield out()


def _strung(batches):
    """The ranges of each file in order: with first line, beginning, first line of the open record, and the file's encoding."""
    file, held = None, []

    def out():
        line, state, begun = 1, BETWEEN, 0
        utf8, header = all(r["utf8"] for r in held), held[0]["header"]
        rows = []
        for r in held:
            rows.append({"file": file, "block": r["block"], "first": line, "begins": state, "open_at": begun, "utf8": utf8, "header": header})
            start = r["start_inside"] if state else r["start_between"]
            begun = line + start if start >= 0 else begun
            state = r["after_inside"] if state else r["after_between"]
            line += r["n"]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("begins", pa.int32()), ("open_at", pa.int64()), ("utf8", pa.bool_()), ("header", pa.binary())]))

    for b in batches:
        for r in b.to_pylist():
            if held and r["file"] != file:
                yield out()
                held = []
            file = r["file"]
            held.append(r)
    if held:
        yield out()


_RECORD = pa.schema([("file", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("block", pa.int64()), ("utf8", pa.bool_()), ("piece", pa.binary()), ("cells", pa.list_(pa.string()))])
_RECORD_DDL = "file string, first_line long, last_line long, block long, utf8 boolean, piece binary, cells array<string>"


def _decoded(raw: bytes, utf8: bool, first: bool) -> str:
    return raw.decode("utf-8-sig" if first else "utf-8") if utf8 else raw.decode("latin-1")


def _cut(batches):
    """The records of ranges; of one that goes on before or behind its range, a piece."""
    key, held, size, start, state, line, utf8, rows, chars = None, [], 0, 0, BETWEEN, 0, True, [], 0

    def put(whole: bool):
        nonlocal held, size, chars
        raw = b"\n".join(held)
        row = {"file": key[0], "first_line": start, "last_line": line, "block": key[1], "utf8": utf8}
        rows.append(row | ({"cells": cells_of(_decoded(raw, utf8, start == 1))} if whole else {"piece": raw}))
        chars += len(raw)
        held, size = [], 0

    def out():
        nonlocal rows, chars
        batch = pa.RecordBatch.from_pylist([{f: r.get(f) for f in _RECORD.names} for r in rows], _RECORD)
        rows, chars = [], 0
        return batch

    for b in batches:
        for file, block, text, first, begins, open_at, valid in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
            if (file, block) != key:
                if held:
                    put(False)
                key, line, state, start, utf8 = (file, block), first - 1, begins, open_at, valid
                own = begins == BETWEEN
            line += 1
            if state == BETWEEN:
                start, own = line, True
            if size < MOST:
                held.append(text)
                size += len(text) + 1
            state = ends(text, state)
            if state == BETWEEN:
                put(own)
            if len(rows) >= 512 or chars >= MOST // 4:
                yield out()
    if held:
        put(False)
    yield out()


def _joined(batches):
    """Records of several pieces, in order."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            raw = b"\n".join(p["piece"] for p in r["pieces"])[:MOST]
            rows.append({"file": r["file"], "first_line": r["first_line"], "last_line": r["last_line"], "cells": cells_of(_decoded(raw, r["utf8"], r["first_line"] == 1))})
        yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in _RECORD.names} for r in rows], _RECORD)


def records(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """file, first_line, last_line and cells of each record (the header's too), and file, utf8 and header of each file."""
    lines = _lines(spark, path)
    if encoding:
        lines = lines.withColumn("utf8", F.lit(encoding.upper().replace("-", "") == "UTF8"))
    found = lines.mapInArrow(_summaries, _SUMMARY)
    strung = found.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_strung, "file string, block long, first long, begins int, open_at long, utf8 boolean, header binary")
    ranged = lines.drop("utf8").withColumn("seq", F.monotonically_increasing_id()).join(strung.drop("header"), ["file", "block"])
    ordered = ranged.sortWithinPartitions("file", "block", "seq").select("file", "block", "line", "first", "begins", "open_at", "utf8")
    cut = ordered.mapInArrow(_cut, _RECORD_DDL)
    pieces = cut.where("piece IS NOT NULL").groupBy("file", "first_line").agg(F.max("last_line").alias("last_line"), F.first("utf8").alias("utf8"), F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("pieces"))
    whole = cut.where("cells IS NOT NULL").union(pieces.mapInArrow(_joined, _RECORD_DDL)).select("file", "first_line", "last_line", "cells")
    first = Window.partitionBy("file").orderBy("block")
    return whole, strung.withColumn("k", F.row_number().over(first)).where("k = 1").select("file", "utf8", "header")


def read_upload(spark: SparkSession, path: str, encoding: str | None = None, number: str = "first") -> tuple[DataFrame, str]:
    """The rows of CSV files with ``source_row`` and the name of the column for extra cells.

    ``source_row`` is the line of the file at which a record begins (``number="last"``: ends); the header's is 1. Columns are
    those of the first file by name; other files' cells go by their own headers. Blank rows are skipped. Without an
    encoding a file is UTF-8 if all of its bytes are, else Latin-1."""
    if number not in ("first", "last"):
        raise ValueError(f"number rows by their first or last line, not {number!r}")
    rows, files = records(spark, path, encoding)
    heads = [(r.file, cells_of(_decoded(bytes(r.header), r.utf8, True))) for r in files.orderBy("file").collect()]  # a line a file
    if not heads:
        return spark.createDataFrame([], "source_row long, _extra string"), "_extra"
    columns = list(dict.fromkeys(c for c in heads[0][1]))
    places = [(f, [next((k + 1 for k, h in enumerate(head) if h.strip().lower() == c.strip().lower()), 0) for c in columns], len(head)) for f, head in heads]
    known = spark.createDataFrame(places, "file string, _places array<int>, _width int")
    body = rows.join(known, "file").where(F.exists("cells", lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) != "")).where("first_line > 1")
    cell = lambda k: F.when(F.col("_places")[k] > 0, F.try_element_at("cells", F.col("_places")[k])).alias(columns[k])
    extra = F.array_join(F.slice("cells", F.col("_width") + 1, F.greatest(F.size("cells") - F.col("_width"), F.lit(0))), "").alias("_extra")
    return body.select(*map(cell, range(len(columns))), F.col(f"{number}_line").alias("source_row"), extra), "_extra"
