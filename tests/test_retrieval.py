import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as X
from voxlake.operators import analysis as N
from voxlake.operators import features as T
from voxlake.operators import taxonomy as Y
from voxlake.operators import vectors as VEC
from voxlake.schemas import DETERMINERS, KEYWORD_STOPWORDS

LEXICON = {"good": 2.0, "bad": -2.0}


def brute_top(q, x, k):
    out = set()
    for i, v in q:
        best = sorted(((-float(np.dot(v, w)), j) for j, w in x))[:k]
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("small", [64 << 20, 0])
def test_top_k_over_several_blocks_with_ties(spark, monkeypatch, small):
    monkeypatch.setattr(VEC, "QUERY_BLOCK", 7)
    monkeypatch.setattr(VEC, "SMALL_BYTES", small)
    rng = np.random.default_rng(3)
    x = [(k, [float(v) for v in rng.integers(-2, 3, 4)]) for k in range(120)]
    q = [(k, [float(v) for v in rng.integers(-2, 3, 4)]) for k in range(30)]
    found = VEC.top_k(spark.createDataFrame(q, "query_id long, vector array<double>"), spark.createDataFrame(x, "doc_id long, vector array<double>"), 5)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == brute_top(q, x, 5)
    if not small:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "part" in plan.split("Join")[1][:200]  # joined by the part of the documents, not by a block alone


def brute_keywords(rows, n):
    import re

    by = {}
    for text, label in rows:
        w = re.findall(r"[a-z']+", text.lower())
        for g in (1, 2, 3):
            for i in range(len(w) - g + 1):
                p = re.sub(rf"^(?:{'|'.join(DETERMINERS)})\s+", "", " ".join(w[i : i + g])).strip()
                if len(p) >= 3 and p not in KEYWORD_STOPWORDS and re.search("[a-z]", p):
                    for b in ("all", label):
                        by.setdefault(b, Counter())[p] += 1
    return {(b, w, c, r + 1) for b, counts in by.items() for r, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize("n", [3, 12, 5000])
def test_keywords_equal_brute_force(spark, n):
    rnd = random.Random(9)
    words = ["the", "a", "every", "that", "room", "was", "too", "cold", "staff", "nice", "x", "way"]
    rows = [(" ".join(rnd.choices(words, weights=[9, 5, 1, 2, 6, 5, 4, 4, 3, 3, 1, 1], k=rnd.randint(0, 14))), rnd.choice(["negative", "positive"])) for _ in range(120)]
    got = T.keyword_counts(spark.createDataFrame(rows, "text string, sentiment_label string"), n).collect()
    assert {(r.bucket, r.word, r["count"], r["rank"]) for r in got} == brute_keywords(rows, n)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_tf_idf_search_is_the_same_beyond_the_broadcast_limit(spark, monkeypatch, most):
    monkeypatch.setattr(T, "SMALL_QUERIES", most)
    w = spark.createDataFrame([(d, t, 1.0 / (1 + d)) for d in range(20) for t in ("all", f"t{d % 4}")], "doc long, term string, weight double")
    q = w.where("doc < 3").withColumnRenamed("doc", "query_id")
    got = T.tf_idf_search(q, w, 2).collect()
    assert {(r.query_id, r.doc, r["rank"]) for r in got} == {(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 2, 2)}


def items(spark):
    rows = [(1, "good day", [1.0, 0.0]), (2, "bad day", [0.0, 1.0]), (3, "### bad", [0.0, 1.0]), (4, "bad bad", None), (5, None, [1.0, 0.0])]
    return spark.createDataFrame(rows, "id long, text string, vector array<double>")


def test_failed_rows_stay_and_are_labelled_error(spark):
    score = N.sentiment_udf(N.failing_on(N.lexicon_model(LEXICON), "###"), "v1")
    assert {r.id: r.pred for r in N.batch_predict(items(spark), score).collect()} == {1: "positive", 2: "negative", 3: "error", 4: "negative", 5: "neutral"}
    got = {r.id: r for r in N.analyse(items(spark), score).collect()}
    assert len(got) == 5 and got[3].status == "failed" and "can't be scored" in got[3].error and got[2].status == "ok" and got[2].evidence is None


def test_a_broken_search_is_an_error_and_an_empty_one_is_not(spark):
    score = N.sentiment_udf(N.lexicon_model(LEXICON), "v1")
    corpus = spark.createDataFrame([(2, [0.0, 1.0]), (7, [0.1, 1.0]), (8, [1.0, 0.1])], "doc_id long, vector array<double>")
    search = N.CorpusRetriever(corpus, 0.9, 2)
    got = {r.id: r for r in N.analyse(items(spark), score, vector="vector", retriever=lambda x: search(x).where("id <> 5")).collect()}
    assert [e.doc_id for e in got[1].evidence] == [8] and [e.doc_id for e in got[2].evidence] == [7] and [e.doc_id for e in got[3].evidence] == [2, 7]
    assert (got[4].status, got[4].error) == ("failed", "no vector to search with") and got[4].evidence is None
    assert (got[5].status, got[5].error) == ("failed", "the retriever gave no answer")
    none = N.analyse(items(spark), score, retriever=N.no_retriever).collect()
    assert all(r.status == "ok" and r.evidence == [] for r in none)


def test_batch_categoriser_and_its_errors(spark):
    def make():
        return lambda texts, taxonomy: [[(c["key"], float(c["word"] in t)) for c in taxonomy] for t in texts]

    own = spark.createDataFrame([("days", "day"), ("hash", "#")], "key string, word string")
    score = N.sentiment_udf(N.lexicon_model(LEXICON), "v1")
    got = {r.id: (r.category_key, r.category) for r in N.analyse(items(spark), score, own, categoriser=N.batch_categoriser(make)).collect()}
    assert got == {1: (None, None), 2: ("days", "days"), 3: ("hash", "hash"), 4: (None, "Unclassified / Emerging Complaint"), 5: (None, "Unclassified / Emerging Complaint")}
    with pytest.raises(Exception, match="0 answers"):
        N.batch_categoriser(lambda: lambda texts, taxonomy: [])(items(spark), own).collect()


def test_imports_are_stored_as_runs(spark, tmp_path):
    rows = spark.createDataFrame([(k, 1 if k < 120 else 2, 7, "### bad" if k % 10 == 0 else "bad") for k in range(150)], "feedback_id long, organisation_id long, import_batch_id long, text string")
    score = N.sentiment_udf(N.failing_on(N.lexicon_model(LEXICON), "###"), "v1")
    for run in ("r1", "r2"):
        done = N.analyse_import(rows, str(tmp_path / "results"), str(tmp_path / "runs"), lambda x: N.analyse(x, score), organisation_id=1, import_batch_id=7, run_id=run, run_at="2026-01-01", versions={}, thresholds={}).collect()
        assert [(r.item_count, r.succeeded, r.failed) for r in done] == [(120, 108, 12)]
    assert spark.read.parquet(str(tmp_path / "results")).count() == 240 and spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_accents_and_pictographs(spark):
    row = spark.createDataFrame([("Été à Zürich, Ñandú; ẞ é", "so good \U0001f600 http://x.y <b>ok</b>")], "a string, b string")
    got = row.select(X.without_accents(F.lower("a")).alias("a"), X.clean_review("b", emoji=True).alias("b"), X.clean_review("b").alias("c")).first()
    assert got.a == "ete a zurich, nandu; ß e" and got.b == "so good grinning face ok" and got.c == "so good ok"


def test_topics_by_platform_are_fitted_once(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "ab"[k % 2], [float(v) for v in np.eye(6)[k % 6] + 0.01 * rng.normal(size=6)]) for k in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, platform string, vector array<double>")
    found = Y.discover_by_platform(df, 3, wanted=3, least_cosine=0.5).collect()
    assert len(found) == 360 and {r.platform for r in found} == {"a", "b"}
    for p in "ab":
        groups = {}
        for r in found:
            if r.platform == p:
                groups.setdefault(r.topic, set()).add(r.doc_id % 6)
        assert all(len(g) == 1 for t, g in groups.items() if t >= 0) and any(t >= 0 for t in groups)


def test_density_topics_recover_planted_clusters(spark):
    """Clusters of unequal size come out whole, noise stays out, whatever the layout."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for c, size in enumerate((120, 40, 12)):
        centre = rng.normal(size=24)
        for _ in range(size):
            truth[len(rows)] = c
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=24) * 0.35]))
    for _ in range(30):
        truth[len(rows)] = -1
        rows.append((len(rows), [float(x) for x in rng.normal(size=24)]))
    rows.append((999, [0.0] * 24))
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    got = {r.doc_id: r.topic for r in Y.density_topics(df.repartition(5), k=6, least_cosine=0.7, least_size=8).collect()}
    assert len(got) == len(rows) and got[999] == -1
    starts = {0: 0, 1: 120, 2: 160, -1: -1}
    assert np.mean([got[i] == starts[c] for i, c in truth.items()]) > 0.99
    assert Y.density_topics(df.limit(3), k=6).where("topic = -1 AND NOT core").count() == 3 and Y.density_topics(df.limit(0)).count() == 0


def test_embeddings_by_default_and_by_a_users_encoder(spark):
    import zlib

    df = spark.createDataFrame([(1, "Good good bad"), (2, ""), (3, None), (4, "good")], "id long, text string")
    got = {r.doc_id: r.vector for r in VEC.embed(df, "id", dims=16).collect()}
    want = np.zeros(16)
    for w in ("good", "good", "bad"):
        want[zlib.crc32(w.encode()) % 16] += 1 if zlib.crc32(w.encode()) & 0x10000 else -1
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not any(got[2]) and not any(got[3])
    own = {r.doc_id: r.vector for r in VEC.embed(df, "id", encode=lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert np.allclose(own[4], np.array([4, 1]) / np.sqrt(17)) and own[2] == [0.0, 1.0]


def test_a_task_keeps_the_best_of_all_its_tiles(spark):
    rng = np.random.default_rng(5)
    s = rng.integers(-3, 4, (9, 60)).astype(float)  # many ties
    best = VEC.Best(9, 4)
    for at in range(0, 60, 7):
        best.add(s[:, at : at + 7], np.arange(at, min(at + 7, 60)), np.arange(9))
    best.add(s[4:6, :3] - 9, np.arange(100, 103), np.array([4, 5]))
    want = [(r, i) for r in range(9) for i in sorted(range(60), key=lambda i: (-s[r, i], i))[:4]]
    assert list(zip(best.rows.tolist(), best.ids.tolist(), strict=True)) == want
    x = spark.createDataFrame([(k, [float(v) for v in rng.integers(-2, 3, 4)]) for k in range(500)], "doc_id long, vector array<double>")
    met = VEC._packed(x.where("doc_id < 20").withColumnRenamed("doc_id", "query_id"), 2).crossJoin(x.groupBy((x.doc_id % 9).alias("tile")).agg(F.collect_list(F.struct("doc_id", "vector")).alias("docs")))
    ranked = VEC._best(met.coalesce(1), 3)
    assert ranked.count() == 60


@pytest.mark.parametrize(("told", "held"), [(200_000, 1_000_000), (0, 5), (3, 5)])
def test_keywords_are_the_same_whatever_tasks_are_told_and_hold(spark, monkeypatch, told, held):
    monkeypatch.setattr(T, "TOLD", told)
    monkeypatch.setattr(T, "HELD", held)
    rnd = random.Random(8)
    words = ["the", "a", "every", "room", "was", "too", "cold", "staff", "nice", *(f"{x}{y}" for x in "bcd" for y in "efgh")]
    rows = [(" ".join(rnd.choices(words, weights=[9, 5, 2, 6, 5, 4, 4, 3, 3, *[1] * 12], k=rnd.randint(0, 30))), rnd.choice(["negative", "positive"])) for _ in range(150)]
    df = spark.createDataFrame(rows, "text string, sentiment_label string").repartition(5)
    assert {(r.bucket, r.word, r["count"], r["rank"]) for r in T.keyword_counts(df, 6).collect()} == brute_keywords(rows, 6)


def test_pairs_of_rare_words_are_not_counted(spark):
    rows = spark.createDataFrame([("p", "the good room was good and rare"), ("p", "good room")], "label string, text string")
    some = {r.raw: r.n for r in T.runs(rows, 2, {"good": True, "room": True}).collect()}
    assert some == {"the good": 1, "good room": 2}
    assert {r.raw for r in T.runs(rows, 3, {"good room": False}).collect()} == {"the good room"}
