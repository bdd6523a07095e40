"""Repair of conversation structure: the cheapest edits after which the roles read ``(s?(ua)+)?``, with an audit of them.

A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the conversation),
truncated (the text ends without ``.``, ``!`` or ``?``). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4
(required for blank and duplicate rows), Insert an empty user or assistant turn 3; truncated rows that stay add 3. Of
several cheapest edits the one whose initials (D, I, K, R) are ASCII-least is taken.

Each row is one of nine symbols of role and fault, each symbol a min-plus matrix over the four states of the grammar
(nothing, s, u, a). Runs of equal symbols are advanced from the end by cached binary powers; the choices are then unrolled
from the start, with the vectors of at most UNROLL rows of a run held at once.

Rows are sorted by conversation over ranges, so that a conversation of any size is dealt over as many tasks as it takes. A
task cuts each conversation into blocks of bounded rows and characters. One that lies inside a task in one block is done
there. Of the others only a byte a row meets in one task (the audit, a value of the result, is as long), and the edits go
back to the blocks by a join. Repeated role and text are found by an aggregate of digests, pre-aggregated, and a join that
Spark may split.

Results for odd rows: a null role or text is one blank; rows without a turn come first; rows of one turn stand by role,
then text, so repeated rows are duplicates; a conversation without rows left has zeros and an empty repair; roles count by
their first character; a null conv_id is a conversation; an empty table gives no row. Columns other than conv_id, turn,
role, text and copies are not read. A repaired conversation is handed out in blocks, never as one value; its audit must
be shorter than Spark's 2 GB a value.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, table

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A row's code: 4 * role (0 system, 1 user, 2 assistant, 3 other, by initial) + fault.
OK, TRUNC, BLANK, DUPLICATE = range(4)
#: States: 0 nothing, 1 s, 2 u, 3 a. The state after the one role that may be inserted or given.
NEXT, STEPS_TO_END = (2, 2, 3, 2), (0, 2, 1, 0)
NO_WAY, DROPPED = 1 << 60, 8
SYMBOL = bytes(DROPPED if code % 4 in (BLANK, DUPLICATE) else code // 4 * 2 + code % 4 for code in range(16)) + bytes(240)
LEGAL = ((0, 1), (1, 2), (2, 1))
UNROLL, BLOCK_ROWS, BLOCK_CHARS, OUT_ROWS = 1024, 4096, 1 << 20, 256
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def kept(symbol: int, state: int) -> tuple[int, int] | None:
    """The state after a row is kept and what that costs, if it can be."""
    role, truncated = divmod(symbol, 2)
    if symbol == DROPPED or role == 3:
        return None
    to = 1 if role == 0 and state == 0 else NEXT[state] if role == NEXT[state] - 1 else None
    return to and (to, TRUNCATED * truncated)


def times(a, b):
    """The min-plus product of two matrices, or of a matrix and a vector."""
    if isinstance(b[0], int):
        return tuple(min(x + y for x, y in zip(row, b, strict=True)) for row in a)
    return tuple(tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)) for row in a)


def moves(symbol: int):
    """What a row costs from state to state, inserts before it included."""
    edit = [[NO_WAY] * 4 for _ in range(4)]
    for q in range(4):
        edit[q][q] = DELETE
        if symbol != DROPPED:
            edit[q][NEXT[q]] = min(edit[q][NEXT[q]], REROLE + TRUNCATED * (symbol % 2))
        if k := kept(symbol, q):
            edit[q][k[0]] = min(edit[q][k[0]], k[1])
    inserts = [[NO_WAY] * 4 for _ in range(4)]
    for q in range(4):
        inserts[q][q], inserts[q][NEXT[q]] = 0, INSERT
        inserts[q][NEXT[NEXT[q]]] = min(inserts[q][NEXT[NEXT[q]]], 2 * INSERT)
    return times(inserts, edit)


POWERS = [[moves(s)] for s in range(9)]
AT_END = tuple(INSERT * n for n in STEPS_TO_END)


def before_run(symbol: int, rows: int, after: tuple) -> tuple:
    """The costs from each state before a run of equal symbols, from those after it, by binary powers that are kept."""
    powers, bit = POWERS[symbol], 0
    while rows >> bit:
        if bit == len(powers):
            powers.append(times(powers[-1], powers[-1]))
        if rows >> bit & 1:
            after = times(powers[bit], after)
        bit += 1
    return after


def solve(codes: bytes) -> tuple[int, str]:
    """The cost and the audit of a conversation's codes."""
    return _solved(codes) if len(codes) <= 64 else _solve(codes)


def _solve(codes: bytes) -> tuple[int, str]:
    runs = [(s, sum(1 for _ in g)) for s, g in groupby(codes.translate(SYMBOL))]
    ends = [AT_END]
    for symbol, rows in reversed(runs):
        ends.append(before_run(symbol, rows, ends[-1]))
    ends.reverse()
    out, q = bytearray(), 0
    for (symbol, rows), end in zip(runs, ends[1:], strict=True):
        while rows:
            size = min(rows, UNROLL)
            rows -= size
            costs = [before_run(symbol, rows, end)]
            for _ in range(size):
                costs.append(times(POWERS[symbol][0], costs[-1]))
            for after, before in zip(costs[-2::-1], costs[:0:-1], strict=True):
                q = _edit(symbol, q, before, after, out)
    out += b"I" * STEPS_TO_END[q]
    return ends[0][0], out.decode()


_solved = lru_cache(1 << 16)(_solve)


def _edit(symbol: int, q: int, before: tuple, after: tuple, out: bytearray) -> int:
    """Writes the ASCII-least of a row's cheapest edits; the state after it."""
    while True:
        if DELETE + after[q] == before[q]:
            out += b"D"
            return q
        if INSERT + before[NEXT[q]] == before[q]:
            out += b"I"
            q = NEXT[q]
            continue
        k = kept(symbol, q)
        if k and k[1] + after[k[0]] == before[q]:
            out += b"K"
            return k[0]
        out += b"R"
        return NEXT[q]


def rewritten(edits: str, odd: bool, roles: list[str], texts: list[str]) -> list[dict]:
    """The turns that edits of some rows leave. odd: an odd number of user and assistant turns stands before them."""
    out, i = [], 0
    for e in edits:
        if e != "D":
            row = e == "K"
            role = roles[i] if row else "assistant" if odd else "user"
            out.append({"role": role, "text": "" if e == "I" else texts[i]})
            odd ^= role[:1] != "s"
        i += e != "I"
    return out


def counted(codes: bytes, cost: int, lo: int | None, hi: int | None, turns: int) -> dict:
    c = np.frombuffer(codes, np.uint8)
    fault, role = np.bincount(c % 4, minlength=4), c // 4
    pair = role[:-1] * 4 + role[1:]
    legal = sum(int((pair == a * 4 + b).sum()) for a, b in LEGAL)
    gaps = 0 if lo is None else hi - lo + 1 - turns
    return dict(zip(COUNTS, (gaps, int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[TRUNC]), len(pair) - legal, cost), strict=True))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PLACE = [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64())]
_DONE = pa.schema([*_PLACE, ("n_blocks", pa.int64()), ("edits", pa.string()), ("turns", _TURNS), *((c, pa.int64()) for c in COUNTS)])
_OPEN = [("codes", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64()), ("n_turns", pa.int64())]
_BLOCK = pa.schema([*_DONE, *_OPEN])
_PIECE = pa.schema([*_PLACE, ("n_blocks", pa.int64()), ("edits", pa.string()), ("odd", pa.bool_()), *((c, pa.int64()) for c in COUNTS)])
_COUNTS_DDL = ", ".join(f"{c} long" for c in COUNTS)
_DONE_DDL = f"conv_id long, part int, block long, n_blocks long, edits string, turns array<struct<role string, text string>>, {_COUNTS_DDL}"
_BLOCK_DDL = f"{_DONE_DDL}, codes binary, lo long, hi long, n_turns long"
_PIECE_DDL = f"conv_id long, part int, block long, n_blocks long, edits string, odd boolean, {_COUNTS_DDL}"


class Sheet:
    """Rows on their way out, as batches bounded by rows and characters."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: dict, chars: int = 0):
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= OUT_ROWS or self.chars >= BLOCK_CHARS:
            yield from self.flush()

    def flush(self):
        if self.rows:
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in self.schema.names} for r in self.rows], self.schema)
            self.rows, self.chars = [], 0


def _cut(batches):
    """Blocks of the conversations of a sorted partition. The first and the last one may go on in other partitions."""
    part, sheet, seen = TaskContext.get().partitionId(), Sheet(_BLOCK), 0
    conv = last = None
    codes, roles, texts, chars, block = bytearray(), [], [], 0, 0
    lo = hi = None
    n_turns = 0

    def put(whole: bool):
        nonlocal codes, roles, texts, chars, block, lo, hi, n_turns
        row = {"conv_id": conv, "part": part, "block": block}
        if whole and not block:
            cost, edits = solve(bytes(codes))
            row |= {"n_blocks": 1, "edits": edits, "turns": rewritten(edits, False, roles, texts)} | counted(bytes(codes), cost, lo, hi, n_turns)
        else:
            row |= {"codes": bytes(codes), "turns": [{"role": r, "text": t} for r, t in zip(roles, texts, strict=True)], "lo": lo, "hi": hi, "n_turns": n_turns}
        yield from sheet.add(row, chars)
        codes, roles, texts, chars, block = bytearray(), [], [], 0, block + 1
        lo, hi, n_turns = None, None, 0

    for batch in slices(batches, 1024):
        for c, turn, role, text, copies, code, first in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if not seen or c != conv:
                if seen:
                    yield from put(seen > 1)
                seen, conv, last, block = seen + 1, c, None, 0
            if copies and turn is not None:
                n_turns += turn != hi
                lo, hi = turn if lo is None else lo, turn
            for _ in range(copies):
                if len(codes) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield from put(False)
                    if turn is not None:
                        lo = hi = turn
                        n_turns = 1
                again = not first or last == (turn, role, text)
                codes.append(code + DUPLICATE - code % 4 if again and code % 4 != BLANK else code)
                roles.append(role)
                texts.append(text)
                chars += len(text) + len(role)
                last = (turn, role, text)
    if seen:
        yield from put(False)
    yield from sheet.flush()


def _stitched(batches):
    """The edits of conversations of several blocks, block by block; the counts stand beside the last one."""
    sheet, held, conv = Sheet(_PIECE), [], None

    def put():
        codes = b"".join(r[3] for r in held)
        cost, edits = solve(codes)
        e = np.frombuffer(edits.encode(), np.uint8)
        rows = np.cumsum(e != ord("I"))  # of the conversation, up to each edit
        ends = np.cumsum([len(r[3]) for r in held])
        cuts = np.where(ends > 0, np.searchsorted(rows, ends) + 1, 0)
        cuts[-1] = len(e)
        left = np.flatnonzero(e != ord("D"))
        system = len(left) > 0 and e[left[0]] == ord("K") and codes[rows[left[0]] - 1] // 4 == 0
        stay = np.cumsum(e != ord("D"))
        known = [r[4:7] for r in held if r[4] is not None]
        turns = sum(r[2] for r in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
        at = 0
        for n, (r, cut) in enumerate(zip(held, cuts.tolist(), strict=True), 1):
            odd = at > 0 and bool((stay[at - 1] - (system and stay[at - 1] > 0)) % 2)
            row = {"conv_id": conv, "part": r[1], "block": r[2], "n_blocks": len(held), "edits": edits[at:cut], "odd": odd}
            if n == len(held):
                row |= counted(codes, cost, known[0][0] if known else None, known[-1][1] if known else None, turns)
            yield from sheet.add(row, cut - at)
            at = cut

    for batch in slices(batches, 1024):
        for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if held and r[0] != conv:
                yield from put()
                held = []
            conv = r[0]
            held.append(r)
    if held:
        yield from put()
    yield from sheet.flush()


def _rewritten(batches):
    for batch in slices(batches, 16):
        rows = batch.to_pylist()
        for r in rows:
            r["turns"] = rewritten(r["edits"], r["odd"], [t["role"] for t in r["turns"]], [t["text"] for t in r["turns"]])
        yield pa.RecordBatch.from_pylist([{f: r[f] for f in _DONE.names} for r in rows], _DONE)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, code (without duplicates) and first (no earlier turn has this role and text)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), copies.alias("copies"))
    end = F.rtrim("text", F.lit(WHITE))
    role = F.coalesce(F.nullif(F.position(F.substring("role", 1, 1), F.lit("sua")), F.lit(0)), F.lit(4)) - 1
    fault = F.when(F.length(end) == 0, BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNC)
    key = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256))
    rows = rows.select("*", F.when(F.length("role") == 0, 12).otherwise(role * 4).cast("int").alias("_role"), fault.alias("_fault"), key.alias("_key"))
    told = rows.where((F.col("_fault") != BLANK) & (F.col("copies") > 0)).groupBy("_key").agg(F.sum("copies").alias("_n"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_first"))
    told = told.where("_n > 1").select("_key", F.col("_first.turn").alias("_turn"), F.lit(True).alias("_again"))
    first = F.col("_again").isNull() | F.col("turn").eqNullSafe(F.col("_turn"))
    return rows.join(told, "_key", "left").select("conv_id", "turn", "role", F.when(F.col("copies") > 0, F.col("text")).otherwise("").alias("text"), "copies", (F.col("_role") + F.col("_fault")).alias("code"), first.alias("first"))


def repaired(rows: DataFrame) -> DataFrame:
    """Blocks of repaired conversations: conv_id, part and block (their order), n_blocks, edits, turns (role, text), and
    beside a conversation's last block its counts of faults and its cost.

    ``rows``: conv_id, turn, role, text and, if there, copies (how often a row stands there; 0 only names its conversation)."""
    found = faults(rows)
    ranged = found.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    blocks = stored(in_arrow(ranged, _cut, _BLOCK_DDL))
    whole, rest = blocks.where("codes IS NULL"), blocks.where("codes IS NOT NULL")
    ordered = rest.select("conv_id", "part", "block", "codes", "lo", "hi", "n_turns").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    pieces = in_arrow(ordered, _stitched, _PIECE_DDL)
    joined = rest.select("conv_id", "part", "block", "turns").alias("r").join(pieces.alias("p"), F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("r.part") == F.col("p.part")) & (F.col("r.block") == F.col("p.block")))
    joined = joined.select("r.conv_id", "r.part", "r.block", "p.n_blocks", "p.edits", "r.turns", *(f"p.{c}" for c in COUNTS), "p.odd")
    return whole.select(*_DONE.names).union(in_arrow(joined, _rewritten, _DONE_DDL))


def _hashed(batches):
    """One row a conversation of blocks in order: its edits, counts and the digest of its lines."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    sheet, conv, edits, counts, digest, n = Sheet(schema), None, [], {}, None, 0

    def put():
        yield from sheet.add({"conv_id": conv, "audit": "".join(edits), "repaired_sha256": digest.hexdigest()} | counts, sum(map(len, edits)))

    for batch in slices(batches, 16):
        for r in batch.to_pylist():
            if digest is None or r["conv_id"] != conv:
                if digest is not None:
                    yield from put()
                conv, edits, digest, n = r["conv_id"], [], hashlib.sha256(), 0
            edits.append(r["edits"])
            counts = {c: r[c] for c in COUNTS}
            for t in r["turns"]:
                digest.update(("\n" * (n > 0) + t["role"] + ":" + t["text"]).encode())
                n += 1
    if digest is not None:
        yield from put()
    yield from sheet.flush()


def report(blocks: DataFrame) -> DataFrame:
    """conv_id, the counts, audit and repaired_sha256 (of the ``role:text`` lines). One block is hashed in place; several
    pass by in order, a block at a time."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = blocks.where("n_blocks = 1").select("conv_id", *COUNTS, F.col("edits").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))
    many = blocks.where("n_blocks > 1").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return one.union(in_arrow(many, _hashed, f"conv_id long, {_COUNTS_DDL}, audit string, repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn``: dropped (copies 0), emptied, without ``.!?``, repeated (copies 2), from the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repaired(damaged(table(spark, sf_dir, "conversations"))))


#: A dynamic program row by row: of each conversation and state the cheapest, then ASCII-least edits. crc32 from its definition.
ORACLE_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), kinds AS (
  SELECT given.*, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda p: CAST(ascii(name[p]) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM given, crc_table
), after_damage AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM after_damage
), faulty AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS follower
  FROM numbered
), rows AS (
  SELECT conv_id, turn, i, role, text, initial, follower,
    CASE WHEN stem = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM faulty
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (follower IS NOT NULL AND initial || follower NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), best AS (
  SELECT conv_id, 0 AS i, 0 AS state, 0 AS cost, '' AS audit, '' AS body FROM counts
  UNION ALL
  SELECT conv_id, i, state, cost, audit, body FROM (
    SELECT e.conv_id, e.i, CASE e.kind WHEN 'D' THEN e.here WHEN 'R' THEN e.there ELSE CASE e.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
      e.cost + 3 * e.inserts + CASE e.kind WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.kind <> 'D' AND e.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      e.audit || repeat('I', e.inserts) || e.kind AS audit,
      e.body || e.added || CASE e.kind WHEN 'D' THEN '' WHEN 'K' THEN e.role || ':' || e.text || chr(10)
        ELSE CASE e.there WHEN 2 THEN 'user:' ELSE 'assistant:' END || e.text || chr(10) END AS body
    FROM (
      SELECT *, CASE here WHEN 2 THEN 3 ELSE 2 END AS there FROM (
        SELECT b.conv_id, b.cost, b.audit, b.body, r.i, r.role, r.text, r.initial, r.fault, j.inserts, k.kind,
          CASE WHEN j.inserts = 0 THEN b.state WHEN (b.state = 2) = (j.inserts % 2 = 1) THEN 3 ELSE 2 END AS here,
          left(CASE b.state WHEN 2 THEN 'assistant:' || chr(10) || 'user:' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END,
            CASE j.inserts WHEN 0 THEN 0 WHEN 2 THEN 17 ELSE CASE b.state WHEN 2 THEN 11 ELSE 6 END END) AS added
        FROM best b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1, (VALUES (0), (1), (2)) AS j(inserts), (VALUES ('D'), ('K'), ('R')) AS k(kind)
      )
    ) AS e
    WHERE e.kind = 'D' OR e.fault NOT IN ('blank', 'duplicate') AND (
      e.kind = 'R' OR e.initial = 's' AND e.here = 0 OR e.initial = 'u' AND e.there = 2 OR e.initial = 'a' AND e.there = 3)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), ends AS (
  SELECT * FROM (SELECT b.conv_id, b.cost + CASE b.state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost,
    b.audit || CASE b.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    b.body || CASE b.state WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END AS body
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(left(e.body, length(e.body) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
