"""Uploads read over several ranges: the csv module's records and line numbers, whatever the ranges."""

import csv
import io
import random

import pytest

from voxlake.sources import files as S
from voxlake.sources import uploads as U


def expected(raw: bytes):
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    reader, out, before = csv.reader(io.StringIO(text)), [], 0
    for cells in reader:
        out.append((before + 1, reader.line_num, cells))
        before = reader.line_num
    return out


def random_csv(n, seed):
    rnd = random.Random(seed)
    cells = ["plain", "", '"two\nlines"', '"a ""b"" c"', '5" screen', '"x, y"', '"\n\n"', '""', 'é', '"q"tail', '"cr\r\nlf"', 'a"b"', '"""', "'"]
    lines = []
    for i in range(n):
        pick = rnd.choices(cells, k=rnd.choice([1, 2, 3, 4]))
        pick = [c for c in pick if c != '"""' or rnd.random() < 0.02] or ["z"]
        lines.append(",".join([f"row{i}", *pick]) if rnd.random() < 0.95 else "")
    return ("text,b,c\n" + rnd.choice(["\n", "\r\n"]).join(lines) + "\n").encode()


def in_ranges(spark, n):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture(autouse=True)
def ranges_as_before(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize(("seed", "size"), [(1, 37), (2, 200), (3, 1 << 20)])
def test_records_against_the_csv_module(spark, tmp_path, seed, size):
    raw = random_csv(120, seed)
    (tmp_path / "a.csv").write_bytes(raw)
    in_ranges(spark, size)
    rows, _ = U.records(spark, str(tmp_path / "a.csv"))
    assert U._lines(spark, str(tmp_path / "a.csv")).select("block").distinct().count() >= min(8, len(raw) // size)
    got = sorted((r.first_line, r.last_line, list(r.cells)) for r in rows.collect())
    assert got == expected(raw)


def test_line_numbers_columns_and_extra_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'text,id\n"one\ntwo\nthree",1\n\n , \nfour,2,more\nfive\n')
    rows, extra = S.read_upload(spark, str(tmp_path / "a.csv"))
    got = [tuple(r) for r in rows.select("source_row", "text", "id", extra).orderBy("source_row").collect()]
    assert got == [(2, "one\ntwo\nthree", "1", ""), (7, "four", "2", "more"), (8, "five", None, "")]
    last, _ = S.read_upload(spark, str(tmp_path / "a.csv"), number="last")
    assert sorted(r.source_row for r in last.collect()) == [4, 7, 8]
    with pytest.raises(ValueError):
        S.read_upload(spark, str(tmp_path / "a.csv"), number="middle")


def test_encoding_is_told_by_file(spark, tmp_path):
    """The byte that isn't UTF-8 stands at the end; the file's first range is read as Latin-1 all the same."""
    in_ranges(spark, 64)
    (tmp_path / "a.csv").write_bytes("text\nÃ© first\n".encode("latin-1") + b"x" * 300 + b"\n" + "café\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿Text\né first\n".encode())
    rows, _ = S.read_upload(spark, str(tmp_path))
    assert {r.text for r in rows.collect()} == {"Ã© first", "x" * 300, "café", "é first"}


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"text,id\nx,1\n")
    (tmp_path / "b.csv").write_bytes(b"ID,Text,other\n2,y,z\n3,w,v,extra\n")
    rows, extra = S.read_upload(spark, str(tmp_path))
    assert sorted((r.text, r.id, r[extra]) for r in rows.collect()) == [("w", "3", "extra"), ("x", "1", ""), ("y", "2", "")]


def test_an_open_quote_takes_the_rest(spark, tmp_path):
    in_ranges(spark, 50)
    raw = b'text,id\nok,1\n"never closed,2\n' + b"more lines\n" * 60
    (tmp_path / "a.csv").write_bytes(raw)
    rows, _ = S.read_upload(spark, str(tmp_path / "a.csv"))
    got = sorted((r.source_row, r.text) for r in rows.collect())
    assert got[0] == (2, "ok") and got[1][0] == 3 and got[1][1].count("more lines") == 60


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert S.read_upload(spark, str(tmp_path / "a.csv"))[0].count() == 0
    (tmp_path / "b.csv").write_bytes(b"text\n")
    assert S.read_upload(spark, str(tmp_path / "b.csv"))[0].count() == 0
