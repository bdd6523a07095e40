import numpy as np

from voxlake.llm.embedding_dedup import embedding_groups, linked, quantise

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.95):
    ok = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    near = {i: {j for j in ids if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold} for i in ids}
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in ids:
            m = min([group[i], *(group[j] for j in near[i])])
            changed |= m < group[i]
            group[i] = m
    return {i: (len(near.get(i, ())), group[i], group[i] == i) for i, _ in rows}


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(df, **more).collect()}


def test_links_groups_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 24))
    rows = []
    for k in range(240):
        noise = rng.normal(size=24) * rng.choice([0.0, 0.1, 0.22, 0.3])
        rows.append((k * 3 + 5, [float(np.float32(x)) for x in base[k % 30 if k < 120 else 0] + noise]))
    rows += [(1, None), (2, [0.0] * 24), (3, [float("nan")] * 24), (4, [None] * 24), (6, [1.0, 0.0]), (7, []), (1000, rows[0][1]), (1001, rows[0][1]), (1002, [5 * x for x in rows[0][1]])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_bound_holds():
    x = np.random.default_rng(0).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, eps = quantise(x)
    q = q.astype(float)
    err = np.abs(x @ x.T - (q @ q.T) * s[:, None] * s[None])
    assert (err <= eps[:, None] + (1 + eps[:, None]) * eps[None] + 1e-9).all() and np.abs(q).max() <= 127


def test_several_tiles_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size, count in ((1500, 40), (16, 160)):
        base = rng.normal(size=(5, size))
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base[k % 5] + rng.normal(size=size) * rng.choice([0.05, 0.2, 0.3, 0.34])]) for k in range(count)]
    rows += [(900 + k, [-0.0 if not x else x for x in v]) for k, v in enumerate([[1.0, 0.0, 2.0], [1.0, -0.0, 2.0]])]
    assert run(spark, rows, tile=16) == brute(rows)


def test_a_pair_at_the_threshold_is_decided_alike_beside_any_others():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 33))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = np.argwhere(np.ones((40, 40), bool))
    for a, b in [(0, 1), (7, 9), (30, 4)]:
        at = float(np.einsum("ij,ij->i", x[[a]], x[[b]])[0])
        many = linked(x, x, pairs[:, 0], pairs[:, 1], at)[40 * a + b]
        assert many and linked(x, x, np.array([a]), np.array([b]), at)[0]
