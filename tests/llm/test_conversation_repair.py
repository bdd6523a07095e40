"""Conversation repair against a plain search over all edits, and against the SQL's definition on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from voxlake.llm import conversation_repair as C

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """rows: (role initial, fault). The least (cost, audit) over all edits."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def go(i, last, inserted):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            found += [(c + 3, "I" + x) for r in after[last] if r != "s" for c, x in [go(i, r, inserted + 1)]]
        if i < len(rows):
            role, fault = rows[i]
            c, x = go(i + 1, last, 0)
            found.append((c + 4, "D" + x))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for r in after[last]:
                    c, x = go(i + 1, r, 0)
                    if r == role:
                        found.append((c + more, "K" + x))
                    if r != "s":
                        found.append((c + more + 3, "R" + x))
        return min(found) if found else (10**9, "")

    for i in range(len(rows), 0, -1):  # from the end, so that calls stay shallow
        for last in after:
            go(i, last, 0)
    return go(0, "", 0)


def expected(rows):
    """rows of one conversation after damage, in order: the columns of the query."""
    out, seen, found = dict.fromkeys(C.COUNTS, 0), set(), []
    for _, role, text in rows:
        bare = text.strip(C.WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        found.append((role[:1], fault))
        if fault:
            out[fault] += 1
    turns = {t for t, _, _ in rows if t is not None}
    out["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    out["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
    out["cost"], audit = cheapest(tuple(found))
    lines, i, last = [], 0, ""
    for e in audit:
        to = "a" if last == "u" else "u"
        if e == "K":
            to = found[i][0]
            lines.append(rows[i][1] + ":" + rows[i][2])
        elif e != "D":
            lines.append({"a": "assistant", "u": "user"}[to] + ":" + (rows[i][2] if e == "R" else ""))
        last, i = last if e == "D" else to, i + (e != "I")
    assert GOOD.fullmatch("".join(x[0] for x in lines))
    return out | {"audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def checked(spark, given, after):
    df = spark.createDataFrame([(*r, "x") for r in given], "conv_id long, turn long, role string, text string, code string")
    got = {r.conv_id: r.asDict() for r in C.report(C.repaired(C.damaged(df) if after is None else df)).collect()}
    after = damage(given) if after is None else after
    assert set(got) == {r[0] for r in given}
    for conv, r in got.items():
        rows = sorted(((t, x, y) for c, t, x, y in after if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert {k: v for k, v in r.items() if k != "conv_id"} == expected(rows), (conv, rows)
    return got


def conversations(n, seed=3):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "", " \t", "no end", "ok!\n", "é."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 1, None]), rnd.choice(["user", "assistant"] * 4 + ["system", None, "tool", ""]), rnd.choice([*texts, None, f"{turn}.", f"{turn} x"])))
    return rows


def test_against_all_edits(spark):
    checked(spark, conversations(300), None)


def test_over_partitions_and_blocks(spark):
    """A conversation that holds most rows lies over all tasks, and in several blocks of each."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rnd = random.Random(1)
        rows = [(5, t // 2 * 3, *rnd.choice([("user", f"{t}."), ("assistant", f"{t}"), ("user", "again."), ("assistant", f"{t}!"), ("system", "")])) for t in range(700)]
        checked(spark, rows + conversations(20, 8), None)
        old_rows, n = C.BLOCK_ROWS, 30_000
        long = [(1, t, "user" if t % 2 == 0 or t % 7 == 0 else "assistant", f"{t}{'.' * (t % 11 > 0)}") for t in range(n)]
        df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
        blocks = C.repaired(df)
        (r,) = C.report(blocks).collect()
        assert blocks.count() > n / old_rows and len(r.audit.replace("I", "")) == n and r.gaps == 0
        turns = [t for b in sorted(blocks.collect(), key=lambda b: (b.part, b.block)) for t in b.turns]
        assert GOOD.fullmatch("".join(t.role[0] for t in turns))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == r.repaired_sha256
        codes = bytes(4 * (1 if x == "user" else 2) + (C.TRUNC if t % 11 == 0 else C.OK) for t, (_, _, x, _) in enumerate(long))
        assert C.solve(codes) == (r.cost, r.audit)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_runs_by_powers():
    step = {s: C.POWERS[s][0] for s in range(9)}
    for s in range(9):
        want = C.AT_END
        for n in range(1, 200):
            want = C.times(step[s], want)
            assert C.before_run(s, n, C.AT_END) == want
    rnd = random.Random(2)
    names = {0: "s", 1: "u", 2: "a", 3: "o"}
    fault = {C.OK: "", C.TRUNC: "truncated", C.BLANK: "blank", C.DUPLICATE: "duplicate"}
    for _ in range(200):
        codes = bytes(c for _ in range(rnd.randrange(8)) for c in [rnd.randrange(16)] * rnd.choice([1, 2, 7]))
        assert C.solve(codes) == C._solve(codes) == cheapest(tuple((names[c // 4], fault[c % 4]) for c in codes))
    assert C.solve(bytes([4]) * 5000) == C.solve(bytes([4]) * 5000)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.report(C.repaired(C.damaged(df))).count() == 0


def test_nothing_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = C.report(C.repaired(C.damaged(spark.createDataFrame([(conv, 0, "user", "hi.")], "conv_id long, turn long, role string, text string")))).collect()
    assert r.asDict() == {"conv_id": conv, **dict.fromkeys(C.COUNTS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
