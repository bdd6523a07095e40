"""The composite analysis, the taxonomy, evaluation, vectors, models and streams on small known data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import analysis as N
from voxlake.operators import evaluation as E
from voxlake.operators import models as M
from voxlake.operators import sampling as S
from voxlake.operators import taxonomy as Y
from voxlake.operators import vectors as VEC


def test_sentiment_stage_isolates_failures(spark):
    def make():
        def run(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model broke")
            return [{"negative": 0.2, "neutral": 0.2, "positive": 0.6} for _ in texts]

        return run

    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, None)], "id long, text string").coalesce(1)
    rows = {r.id: r for r in N.analyse(df, N.sentiment_udf(make, "v1")).collect()}
    assert [rows[i].status for i in (1, 2, 3)] == ["ok", "failed", "ok"] and "model broke" in rows[2].error
    assert rows[1].label == "positive" and rows[1].skipped == "sentiment positive" and rows[2].skipped == "no sentiment"
    run = N.run_row(N.result_rows(N.analyse(df, N.sentiment_udf(make, "v1")), organisation_id=1, run_id="r", run_at="2026-01-01"), {"s": "v1"}, {"c": 0.35}).first()
    assert (run.item_count, run.succeeded, run.failed) == (3, 2, 1)


def test_wrong_prediction_count_fails_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    rows = N.analyse(df, N.sentiment_udf(lambda: lambda texts: [], "v1")).collect()
    assert {r.status for r in rows} == {"failed"}


def test_each_text_is_scored_once_in_small_batches(spark):
    texts, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        def run(batch):
            texts.add(len(batch))
            large.add(int(len(batch) > 1000))
            return [{"negative": 0.9, "neutral": 0.1} for _ in batch]

        return run

    items = spark.range(2500).coalesce(1).selectExpr("id", "concat('text ', id) AS text", "CASE WHEN id % 2 = 0 THEN array(1.0D, 0.0D) END AS vector")
    cats = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "key string, vector array<double>")
    before = spark.conf.get(N.ARROW_ROWS)
    rows = N.analyse(items, N.sentiment_udf(make, "v1"), cats, "vector").collect()
    assert (texts.value, large.value, len(rows)) == (2500, 0, 2500) and spark.conf.get(N.ARROW_ROWS) == before
    assert {(r.id % 2, r.category, r.skipped, r.scores["neutral"]) for r in rows} == {(0, "a", None, 0.1), (1, None, "no vector", 0.1)}
    only = items.select(N.sentiment_udf(make, "v1")("text").alias("s")).where("s.error IS NULL").collect()
    assert len(only) == 2500 and large.value == 0


@pytest.mark.parametrize(("score", "classified"), [(0.35, True), (0.3499, False)])
def test_threshold_is_inclusive_and_keeps_candidates(spark, score, classified):
    items = spark.createDataFrame([(1, [score, math.sqrt(1 - score**2)])], "id long, vector array<double>")
    cats = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "key string, vector array<double>")
    r = N.categorise(items, cats).first()
    assert (r.category_key == "a") == classified and r.is_unclassified == (not classified) and [c.key for c in r.candidates] == ["a", "b"]
    none = N.categorise(items, cats.where("false")).first()
    assert none.category_key is None and none.is_unclassified is None


def test_newest_result_is_current(spark):
    rows = spark.createDataFrame([(1, "r1", "2026-01-01"), (1, "r2", "2026-01-02"), (2, "r1", "2026-01-01"), (1, "r0", "2026-01-02")], "feedback_id long, run_id string, run_at string")
    assert {(r.feedback_id, r.run_id) for r in N.current_results(rows).where("is_current").collect()} == {(1, "r2"), (2, "r1")}


TOPICS = [
    (0, "amazon", ["battery dies", "battery"], 500, ["d0"], [1.0, 0.0, 0.0, 0.0]), (1, "yelp", ["battery life", "battery"], 300, ["d1", "d0"], [0.98, 0.05, 0.0, 0.0]), (2, "amazon", ["late delivery"], 200, ["d2"], [0.0, 1.0, 0.0, 0.0]),
    (3, "yelp", ["cold food"], 150, ["d3"], [0.0, 0.0, 1.0, 0.0]), (4, "yelp", ["rude staff"], 100, ["d4"], [0.0, 0.0, 0.0, 1.0]), (5, "twitter", ["lost bag"], 90, ["d5"], [0.5, -0.5, 0.5, -0.5]),
]


def test_topic_merge(spark):
    t = spark.createDataFrame(TOPICS, "topic long, platform string, keywords array<string>, count long, example_docs array<string>, centroid array<double>")
    members = Y.merge_topics(t, 5)
    of = {r.topic: r.cluster for r in members.collect()}
    assert of[0] == of[1] and len(set(of.values())) == 5
    top = Y.merged_clusters(t, members).first()
    assert (top["count"], top.platforms, top.source_topics) == (800, ["amazon", "yelp"], [0, 1]) and top.keywords[0] == "battery dies" and top.example_docs == ["d0", "d1"]
    assert len({r.cluster for r in Y.merge_topics(t, 24).collect()}) == 6
    named = spark.createDataFrame([("Billing ", 3, ["a", "b"], ["x"], ["p"]), ("billing", 5, ["b", "c"], ["y"], ["q"])], "name string, count long, keywords array<string>, exemplars array<string>, platforms array<string>")
    r = Y.merge_same_names(named).first()
    assert (r["count"], r.keywords, r.platforms) == (8, ["b", "c", "a"], ["p", "q"])


def test_least_topic_size(spark):
    rows = spark.createDataFrame([(57_931,), (149_838,), (8_890,), (1_000_000,)], "n long").select(Y.least_topic_size("n").alias("x")).collect()
    assert [r.x for r in rows] == [86, 224, 30, 300]


def test_noise_and_labels(spark):
    t = spark.createDataFrame([(1, ["good", "good food"]), (2, ["good", "late bus", "bus"]), (3, ["rude staff", "staff"]), (4, ["cold meal", "meal"])], "topic long, keywords array<string>")
    kept = {r.topic for r in Y.drop_noise(t).collect()}
    assert kept == {2, 3, 4}
    assert Y.drop_noise(t.limit(2)).count() == 2
    assert {r.topic for r in Y.drop_noise(t, spark.createDataFrame([("bus",), ("meal",)], "word string")).collect()} == {2, 4}
    label = spark.createDataFrame([(["the", "waiting", "waited", "wait time", "bus bus", "ok", "delivery"],)], "k array<string>").select(Y.clean_label("k", ["the"]).alias("x")).first().x
    assert label == "Waiting, Wait Time, Delivery"


def test_upsert_retire_and_violations(spark):
    c = spark.createDataFrame([("a", "A", "d", True), ("b", "B", "d", True)], "key string, name string, description string, is_active boolean")
    new = spark.createDataFrame([("a", "A2", None), (None, "Late & Lost!", "x")], "key string, name string, description string")
    rows = {r.key: r for r in Y.upsert(c, new).collect()}
    assert rows["a"].name == "A2" and rows["a"].description == "d" and "b" in rows and rows["late_lost"].is_active
    assert {r.key: r.is_active for r in Y.retire(c, c.where("key = 'a'")).collect()} == {"a": False, "b": True}
    assert Y.violations(c).count() == 0 and Y.violations(c.union(c.limit(1))).count() == 1


def predictions(spark):
    rows = [("negative", "negative"), ("negative", "positive"), ("neutral", "neutral"), ("positive", "positive"), ("positive", "neutral"), ("positive", None)]
    return spark.createDataFrame([(i, "p", t, "m", p) for i, (t, p) in enumerate(rows)], "review_id long, platform string, true_label string, model string, pred string")


def test_metrics_by_hand(spark):
    r = E.overall(E.usable(predictions(spark)), "model").first()
    f1 = {"negative": 2 * 1 / (2 + 1), "neutral": 2 * 1 / (1 + 2), "positive": 2 * 1 / (2 + 2)}
    assert (r.n, r.accuracy) == (5, 0.6) and r.macro_f1 == round(sum(f1.values()) / 3, 6) and r.balanced_accuracy == round((0.5 + 1 + 0.5) / 3, 6)


def test_mcnemar_against_enumeration(spark):
    rows = [(i, "x", m, "x" if ok else "y") for i in range(20) for m, ok in (("a", i < 15), ("b", i % 4 == 0))]
    p = spark.createDataFrame(rows, "review_id long, true_label string, model string, pred string")
    r = E.mcnemar(p).first()
    n, k = r.only_a + r.only_b, min(r.only_a, r.only_b)
    assert r.p_value == round(min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), 9) and r.better == "a"


def test_retrieval_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, doc_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (1, 99), (2, 5)], "query_id long, doc_id long")
    rows = {r.query_id: r for r in E.retrieval_metrics(ranked, rel, 5).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].mrr) == (0.2, 0.5, 0.5) and rows[2].ndcg == 0
    assert abs(rows[1].ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-6


def test_top_k_equals_matrix_product(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    got = {}
    for r in VEC.top_k(docs.where("doc_id < 40").withColumnRenamed("doc_id", "query_id"), docs, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    s = v[:40] @ v.T
    assert all([got[q][k + 1] for k in range(7)] == sorted(range(300), key=lambda d: (-s[q, d], d))[:7] for q in range(40))


def test_mmr_never_brings_back_weak_documents(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.04]), (3, [0.1, 0.99])], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>")
    picks = VEC.mmr(VEC.top_k(q, docs, 3).join(docs, "doc_id").select("query_id", "doc_id", "score", "vector"), 2).orderBy("pick").collect()
    assert picks[0].doc_id == 1
    assert {r.doc_id for r in VEC.grounded(q, docs, 0.35, k=3).collect()} == {1, 2}


def test_samples_do_not_depend_on_layout(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("label"))
    one = {r.id for r in S.balanced_sample(df.repartition(1), ["label"], 20, "id").collect()}
    assert one == {r.id for r in S.balanced_sample(df.repartition(9), ["label"], 20, "id").collect()} and len(one) == 60
    parts = {r.split: r.n for r in S.hash_split(df, {"train": 0.8, "test": 0.2}, "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 500 and 60 < parts["test"] < 140


def test_stratified_parts_and_folds(spark):
    """Each class's parts are within one row of its share, however small the class and whatever the layout."""
    sizes = {"a": 700, "b": 10, "c": 3, "d": 1, None: 40}
    rows = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string")
    nested = {"train": 0.7, "rest": (0.3, {"val": 0.5, "test": 0.5})}
    seen = []
    for layout in (df.repartition(1), df.repartition(7), df.orderBy("id")):
        out = S.folds(S.split(layout, nested, "id", "label"), 5, "id", "label").collect()
        assert len(out) == len(rows)
        seen.append(sorted((r.id, r.split, r.fold) for r in out))
        for label, n in sizes.items():
            own = [r for r in out if r.label == label]
            for part, share in {"train": 0.7, "val": 0.15, "test": 0.15}.items():
                assert abs(sum(r.split == part for r in own) - n * share) <= 1
            folds = [sum(r.fold == k for r in own) for k in range(5)]
            assert max(folds) - min(folds) <= 1 and folds == sorted(folds, reverse=True)
    assert seen[0] == seen[1] == seen[2]
    two = S.split(df, {"train": 0.8, "test": 0.2}, "id", "label").where("label = 'b' AND split = 'test'").count()
    assert two == 2
    assert S.split(df.limit(0), nested, "id", "label").count() == S.folds(df.limit(0), 3, "id", "label").count() == 0
    plan = S.split(df, nested, "id", "label")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "Window" in line and "row_number()" in line]
    assert len(ranks) == 1 and "_prefix" in ranks[0].split("windowspecdefinition(")[1].split(" ASC")[0]  # no window holds a class


def test_classical_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = {"negative": "bad awful broken late", "neutral": "okay fine average plain", "positive": "great lovely perfect fast"}
    rows = [(i, " ".join(rng.choice(words[k].split(), 6)) + " the thing", k) for i, k in enumerate(list(words) * 40)] + [(999, "x", "unknown")]
    train = M.prepared(spark.createDataFrame(rows, "id long, text string, sentiment_label string"))
    assert train.count() == 120
    model = M.fit(train, M.naive_bayes(0.1))
    M.save(model, str(tmp_path / "m"))
    scored = M.score(M.load(str(tmp_path / "m")), train)
    assert E.overall(scored.select(F.col("sentiment_label").alias("true_label"), "pred")).first().accuracy > 0.95
    assert set(scored.first().scores) == {"negative", "neutral", "positive"}
    rows = S.folds(M.featured(train, M.features(train)), 2, "id", "sentiment_label")
    best, means = M.tuned(rows, "nb", k=2, grid=(0.1, 1.0))
    assert best in (0.1, 1.0) and len(means) == 2
    folds = M.cross_validated(rows, {"nb": 0.1, "lr": 1.0}, k=2)
    assert folds.count() == 4 and all(r["mean"] > 0.9 for r in M.fold_summary(folds).collect())
    again = M.cross_validated(S.folds(train, 2, "id", "sentiment_label"), {"nb": 0.1}, k=2, refit_features=True)
    assert again.count() == 2


def test_features_and_logistic_regression_against_numpy(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, 9, p=np.roll(np.arange(1, 13) / 78, 4 * (i % 3)))), ("negative", "neutral", "positive")[i % 3 if i % 5 else 0]) for i in range(90)]
    train = M.prepared(spark.createDataFrame(rows, "id long, text string, sentiment_label string"))
    found = M.featured(train, M.features(train, size=30)).orderBy("id").collect()
    docs = [r.terms for r in train.orderBy("id").collect()]
    df, total = {}, {}
    for d in docs:
        for t in d:
            total[t] = total.get(t, 0) + 1
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    vocab = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:30]
    x = np.array([[(1 + np.log(d.count(t))) * (np.log((1 + len(docs)) / (1 + df[t])) + 1) if t in d else 0.0 for t in vocab] for d in docs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(x, np.array([r.features.toArray() for r in found]))
    y = np.array([int(r.label) for r in found])
    c, n = 2.0, len(y)
    w, b = np.zeros((3, x.shape[1])), np.zeros(3)
    for _ in range(20_000):  # plain gradient descent on the mean loss with |w|^2 / (2 c n)
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p - np.eye(3)[y]
        w -= 0.5 * (g.T @ x / n + w / (c * n))
        b -= 0.5 * g.mean(0)
    data = spark.createDataFrame(found)
    scored = M.logistic_regression(c, n).fit(data).transform(data).orderBy("id").collect()
    assert np.allclose(p, np.array([r.probability.toArray() for r in scored]), atol=2e-3)



def test_approximate_neighbours_against_exact_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 400)] + 0.3 * rng.normal(size=(400, 16))
    x[0] = -x[1:].sum(0) * 10
    docs = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    near, exact = ({(r.query_id, r.doc_id) for r in f.collect()} for f in (VEC.approximate_neighbours(queries, docs, 5, 1.2), VEC.top_k(queries, docs, 5)))
    tight = VEC.approximate_neighbours(queries, docs, 5, 0.1).groupBy("query_id").count().collect()
    assert len(near) == 100 and len(near & exact) >= 90
    assert len(tight) == 20 and all(r["count"] == 5 for r in tight)


def test_approximate_neighbours_of_vectors_without_shape_and_of_copies(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32))
    x[1000:1300] = x[999]
    docs = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in VEC.top_k(queries, docs, 5).collect() if not 1000 <= r.query_id < 1300}
    for small in (VEC.SMALL_BYTES, 0):
        monkeypatch.setattr(VEC, "SMALL_BYTES", small)
        near = VEC.approximate_neighbours(queries, docs, 5, 1.2, cell_docs=32).collect()
        assert len(near) == 500 and len({(r.query_id, r.doc_id) for r in near} & exact) >= 0.9 * len(exact)
        assert all(r.score > 0.999 for r in near if 1000 <= r.query_id < 1300)
    assert VEC.approximate_neighbours(queries.limit(0), docs, 5, 1.2).count() == 0 and VEC.approximate_neighbours(queries, docs.limit(0), 5, 1.2).count() == 0
