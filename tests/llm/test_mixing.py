import hashlib
from collections import Counter, defaultdict
from math import ceil, floor

from voxlake.llm.mixing import mix, mixed, taken_words

BLOCK = 8


def brute(rows):
    """Targets by water filling in rounds, slots one by one, words one by one."""
    size = [len((t or "").split()) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(total.values()), {}, set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w > 2 * total[s]}
        if not full:
            target |= {s: left * weight[s] / w for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
        left -= sum(2 * total[s] for s in full)
        open_ -= full
    whole, at, spans = sum(target.values()), 0.0, []
    for s in names:
        at += target[s]
        spans.append((floor(at / whole * 2**32) if s != names[-1] else 2**32, s))
    uses, rank = Counter(), Counter()
    for i in range(ceil(whole / BLOCK)):
        p = i * 2654435769 % 2**32
        s = next(s for hi, s in spans if p < hi)
        n = -(-total[s] // BLOCK)
        if rank[s] < 2 * n:
            uses[s, rank[s] % n] += 1
        rank[s] += 1
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"mix:{rows[k][0]}".encode()).hexdigest(), rows[k][0], size[k]))
    taken, cursor = [0] * len(rows), Counter()
    for k in order:
        s = rows[k][2]
        for w in range(cursor[s], cursor[s] + size[k]):
            taken[k] += uses[s, w // BLOCK]
        cursor[s] += size[k]
    return target, total, [(rows[k][0], size[k], total[rows[k][2]], round(target[rows[k][2]], 6), taken[k]) for k in range(len(rows))]


def rows():
    out = [(k, " ".join(["w"] * (k * 7 % 40)), f"s{k % 5}" if k % 3 else "big") for k in range(300)]
    out += [(1000, "w " * 5000, "big"), (1001, None, "empty"), (1002, "", None), (1003, "a b c", None), (1003, "a b c", None), (1004, "\t\n", "s1")]
    return out


def test_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s in data], "doc_id long, text string, source string, target string")
    got = [tuple(r) for r in taken_words(mix(df, block=BLOCK)).collect()]
    target, total, want = brute(data)
    assert sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in got) == sorted(want)
    by = Counter()
    for (_, _, s), r in zip(data, want, strict=True):
        assert r[4] <= 2 * r[1]
        by[s] += r[4]
    for s in total:
        assert abs(by[s] - target[s]) <= 6 * BLOCK


def test_mixed_repeats_whole_documents_and_keeps_columns(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in data], "doc_id long, text string, source string, lang string")
    out = mixed(df, block=BLOCK)
    assert out.columns == df.columns
    n = Counter(r.doc_id for r in out.collect())
    assert max(n[i] for i in n if i != 1003) <= 2 and 1001 not in n and sorted(map(tuple, out.collect())) == sorted(map(tuple, mixed(df, block=BLOCK).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert taken_words(mix(df)).count() == 0 and mixed(df).count() == 0
