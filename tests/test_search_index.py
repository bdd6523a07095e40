"""The stored index against brute force, and what it doesn't read."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.operators import features as T
from voxlake.operators import search_index as SI


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(12)]
    docs = [(i, " ".join(rnd.choices(topics[i % 12], k=25) + rnd.choices(["and", "the", "of"], k=6))) for i in range(960)] + [(2000 + i, "and the") for i in range(40)]
    w = T.tf_idf(T.term_counts(spark.createDataFrame(docs, "id long, text string"), "id", bigrams=False), T.vocabulary(T.term_counts(spark.createDataFrame(docs, "id long, text string"), "id", bigrams=False)), len(docs)).cache()
    path = str(tmp_path_factory.mktemp("index"))
    SI.build(w, path, range_docs=40)
    return w, path


def brute(w, queries, k, allowed=None):
    rows, asked = {}, {}
    for r in w.collect():
        rows.setdefault(r.doc, {})[r.term] = r.weight
    for r in queries.collect():
        asked.setdefault(r.query_id, {})[r.term] = r.weight
    out = {}
    for q, terms in asked.items():
        scores = [(-round(sum(x * d.get(t, 0) for t, x in terms.items()), 9), doc) for doc, d in rows.items() if allowed is None or doc in allowed]
        out[q] = [(doc, -s) for s, doc in sorted(x for x in scores if x[0] < 0)[:k]]
    return out


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc, r.score))
    return out


@pytest.mark.parametrize(("k", "filtered"), [(5, False), (5, True), (100, False)])
def test_against_brute_force(spark, index, k, filtered):
    w, path = index
    queries = w.where("doc % 20 = 0 AND doc < 2000").withColumnRenamed("doc", "query_id")
    allowed = spark.range(0, 3000, 3).withColumnRenamed("id", "doc") if filtered else None
    found, _ = SI.search(spark, path, queries, k, allowed)
    want = brute(w, queries, k, set(range(0, 3000, 3)) if filtered else None)
    got = answers(found)
    assert set(got) == {q for q, r in want.items() if r}
    for q, rows in got.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]], abs=2e-9) and [d for d, _ in rows] == [d for d, _ in want[q]]


def test_blocks_are_left_out(spark, index):
    w, path = index
    _, blocks = SI.search(spark, path, w.where("doc < 24").withColumnRenamed("doc", "query_id"), 3)
    rows = blocks.collect()
    assert len(rows) == 24 and all(r.blocks_read < r.blocks for r in rows) and sum(r.blocks_read for r in rows) < 0.9 * sum(r.blocks for r in rows)


def test_odd_queries(spark, index):
    w, path = index
    none = spark.createDataFrame([(1, "nowhere", 1.0)], "query_id long, term string, weight double")
    assert SI.search(spark, path, none, 3)[0].count() == 0 and SI.search(spark, path, none.limit(0), 3)[0].count() == 0
    few = w.where(F.col("doc") == 3).withColumnRenamed("doc", "query_id")
    assert SI.search(spark, path, few, 3, spark.createDataFrame([(3,)], "doc long"))[0].count() == 1


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_no_posting_is_a_row_and_many_queries_share_a_range(spark, index, monkeypatch, most):
    monkeypatch.setattr(SI, "SMALL_QUERIES", most)
    w, path = index
    queries = w.where("doc % 20 = 0 AND doc < 2000").withColumnRenamed("doc", "query_id")
    usual = answers(SI.search(spark, path, queries, 5)[0])
    monkeypatch.setattr(SI.SP, "BLOCK", 3)
    monkeypatch.setattr(SI.SP, "AT_ONCE", 2)
    found, _ = SI.search(spark, path, queries, 5)
    assert answers(found) == usual and len(usual) == 48
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "explode(postings" not in plan and ", doc#" not in plan.split("hashpartitioning(query_id")[1][:12]
