import random
import re

import numpy as np
import pytest

from voxlake.llm.minhash import PathJoin, _blocks, common_counts, first_of_groups, near_duplicates


def own_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    sets = [own_set(t, k) for _, t in rows]
    group = {i: i for i, _ in rows if i is not None}
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            i, j = rows[a][0], rows[b][0]
            m = min(group[i], group[j])
            changed |= group[i] != m or group[j] != m
            group[i] = group[j] = m
    return sorted(((i, len(s), group.get(i), i is None or group[i] == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n=260):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    base = [[word() for _ in range(rnd.randint(30, 90))] for _ in range(12)]
    passage = [word() for _ in range(25)]
    rows = []
    for k in range(n):
        w = list(base[k % 12 if k < n // 2 else 0])
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = word()
        rows.append((1000 - 3 * k if k % 2 else 5000 + k, " ".join(w if k % 5 else passage + w[:20])))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "oNE  Two"), (6, "one two three"), (None, rows[0][1]), (7, rows[0][1]), (7, rows[0][1]), (8, rows[1][1].upper()), (9, "x " * 30_000), (10, "x")]
    return rows


@pytest.mark.parametrize(("p", "seed"), [(PathJoin(words=4), 1), (PathJoin(words=3, leaf=4, depth=2), 2)])
def test_equals_brute_force(spark, p, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, n_shingles int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, p).collect()), key=str)
    assert got == brute(rows, p.words)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_follow_from_the_recall():
    assert PathJoin().trees == 17 and PathJoin(target_recall=0.999).trees == 10
    with pytest.raises(ValueError, match="more coordinates"):
        PathJoin(percent=40, target_recall=0.999999).trees  # noqa: B018


def test_common_counts_and_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, int(n)).astype(np.uint64)) for n in rng.integers(1, 300, 40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = common_counts(sets)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == np.array(want)[off]).all()
    n = np.array([len(s) for s in sets])
    blocks = _blocks(n, 2000)
    assert (np.diff(blocks) >= 0).all() and all(8 * n[blocks == b].sum() <= 2000 or (blocks == b).sum() == 1 for b in set(blocks.tolist()))


def test_sets_in_blocks_of_few_bytes(spark):
    """One link in each leaf is found whatever two blocks its sets are in; one doc_id with several texts is one node."""
    rows = corpus(3, 120)
    rows += [(8000, rows[0][1]), (8000, rows[5][1] + " of its own"), (8001, "of its own " + rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, PathJoin(words=3, block_bytes=1500)).collect()}
    want = {i: c for i, _, c, _ in brute(rows, 3)}
    assert got == want


def test_first_of_groups_with_shared_ids(spark):
    """Of copies under one doc_id one stays, another text under it isn't taken for a copy, rows without an id stay."""
    long = [" ".join(f"w{(k * 7 + j) % 90 + 100 * k}" for j in range(60)) for k in range(4)]
    rows = [(1, long[0]), (1, long[0]), (2, long[0]), (2, long[1]), (3, long[1] + " more"), (4, long[2]), (4, long[2] + " end"), (5, long[3]), (None, long[0]), (None, None), (6, ""), (6, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _key string")
    got = first_of_groups(df.drop("_key").repartition(3)).collect()
    groups = {k: [r.text for r in got if r.doc_id is not None and r.text and r.text.startswith(long[k][:40])] for k in range(4)}
    assert [len(g) for g in groups.values()] == [1, 1, 1, 1] and len(got) == 4 + 2 + 2
    same = first_of_groups(df.drop("_key").where("doc_id IN (1, 2)").limit(3)).collect()
    assert len(same) == 1
    assert first_of_groups(df.drop("_key").limit(0)).count() == 0
