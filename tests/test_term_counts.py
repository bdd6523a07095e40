"""Terms counted where their texts stand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxlake.operators import features as T
from voxlake.operators import taxonomy as Y


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(texts):
    out = Counter()
    for t in texts:
        w = [x for x in (t or "").lower().split() if len(x) > 1]
        out.update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    return [(i, f"src{i % 3}", " ".join(rnd.choices(["the", "red", "fox", "ran", "of", "x", "home"], k=rnd.randint(0, 9)))) for i in range(700)] + [(900, None, None), (901, "src1", "")]


def test_counts_of_a_text_are_not_shuffled(spark, rows):
    df = spark.createDataFrame(rows, "id long, topic string, text string")
    got = T.term_counts(df, "id")
    assert "Exchange hashpartitioning" not in plan(got)
    assert {(r.doc, r.term): r.tf for r in got.collect()} == {(i, t): n for i, _, text in rows for t, n in brute([text]).items()}
    again = T.term_counts(df.union(df.where("id < 3")), "id", bigrams=False).where("doc < 4").collect()  # an id on two rows
    want = {(i, t): n * (2 if i < 3 else 1) for i, _, text in rows[:4] for t, n in brute([text]).items() if " " not in t}
    assert {(r.doc, r.term): r.tf for r in again} == want


@pytest.mark.parametrize("held", [5, 1_000_000])
def test_folded_counts_add_up(spark, rows, monkeypatch, held):
    monkeypatch.setattr(T, "HELD", held)
    df = spark.createDataFrame(rows, "id long, topic string, text string")
    parts = T.folded(df, T.terms("text", False), "topic", without=["the", "of"]).collect()
    assert len({(r.topic, r.term) for r in parts}) <= len(parts) < 2000  # never a row for each occurrence when all is held
    got = Counter()
    for r in parts:
        got[r.topic, r.term] += r.n
    assert got == {(s, t): n for s in ("src0", "src1", "src2") for t, n in brute([x for _, k, x in rows if k == s]).items() if not {"the", "of"} & set(t.split())}


def test_topic_keywords_shuffle_counts_once(spark, rows, monkeypatch):
    plans, stored = [], Y.stored
    monkeypatch.setattr(Y, "stored", lambda df: plans.append(plan(df)) or stored(df))
    df = spark.createDataFrame(rows, "id long, topic string, text string").where("topic IS NOT NULL")
    got = Y.topic_keywords(df, "topic", n=3, stop_words=["the"]).collect()
    assert len(got) == 9 and len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1 and "Generate" not in plans[0]


def test_all_terms_without_a_sort_and_one_grouping_of_documents(spark):
    docs = spark.createDataFrame([(1, "red red blue green"), (2, "red blue blue"), (3, "green grey")], "id long, text string")
    counts = T.term_counts(docs, "id", bigrams=False)
    words = T.vocabulary(counts, size=None)
    assert {r.term for r in words.collect()} == {"red", "blue", "green"} == {r.term for r in T.vocabulary(counts).collect()}
    assert "Sort" not in words._jdf.queryExecution().optimizedPlan().toString() and "Limit" not in words._jdf.queryExecution().optimizedPlan().toString()
    w = T.tf_idf(counts, words, 3, True).groupBy("doc").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("heaviest"), F.round(F.sum("weight"), 6).alias("total"))
    digest = T.weight_digest(T.raw_tf_idf(counts, words, 3, True))
    assert sorted(map(tuple, digest.collect())) == sorted(map(tuple, w.collect()))
    assert digest._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning(doc") == 1
