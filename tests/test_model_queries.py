"""The queries over classical models see whole texts, the full vocabulary, the grid and five folds."""

import pytest

from voxlake.operators import models as M
from voxlake.plans import model_queries as Q
from voxlake.plans.registry import ORACLES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts whose only telling word stands behind their first 2,000 characters."""
    d = str(tmp_path_factory.mktemp("models"))
    rows = [(i, "same words " * 200 + f" {lang}word", lang) for i in range(60) for lang in [("en", "fr", "de")[i % 3]]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def test_whole_texts(spark, folder):
    assert all(f"{r.terms}".count("word'") for r in Q.labelled(spark, folder).collect())


@pytest.mark.parametrize("query,kind,grid", [(Q.m2, "lr", M.C_GRID), (Q.m3, "nb", M.ALPHA_GRID)])
def test_tuned_over_the_grid_with_the_default_vocabulary(spark, folder, monkeypatch, query, kind, grid):
    tuned, features, calls = M.tuned, M.features, []

    def seen_tuned(train, k, *a, **kw):
        best, means = tuned(train, k, *a, **kw)
        calls.append((k, tuple(v for v, _ in means)))
        return best, means

    def seen_features(train, *a, **kw):
        calls.append((a, kw))
        return features(train, *a, **kw)

    monkeypatch.setattr(M, "tuned", seen_tuned)
    monkeypatch.setattr(M, "features", seen_features)
    row = query(spark, folder).first()
    assert calls == [((), {}), (kind, grid)] and row.accuracy == 1.0


def test_both_classifiers_over_five_folds(spark, folder, monkeypatch):
    seen, summary = [], M.fold_summary
    monkeypatch.setattr(M, "fold_summary", lambda scores: seen.append(scores) or summary(scores))
    monkeypatch.setattr(M, "C_GRID", (1.0, 5.0))
    monkeypatch.setattr(M, "ALPHA_GRID", (0.1, 1.0))
    assert {r.model: r["mean"] for r in Q.m4(spark, folder).collect()} == {"lr": 1.0, "nb": 1.0}
    assert sorted((r.model, r.fold) for r in seen[0].collect()) == [(m, f) for m in ("lr", "nb") for f in range(5)]


def test_analyse_keeps_reviews_without_a_vector(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.5 * (i % 2)], i % 2) for i in range(10)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    documents.selectExpr("doc_id", "'aa xyz xyz xyz xyz' AS text", "lang", "'src0' AS source", "10L AS n_chars").write.parquet(f"{folder}/plain/documents.parquet")
    spark.read.parquet(f"{folder}/embeddings.parquet").write.parquet(f"{folder}/plain/embeddings.parquet")
    rows = {r.id: r for r in Q.x1(spark, f"{folder}/plain").collect()}
    assert len(rows) == 60 and all(r.label and r.status == "ok" for r in rows.values())
    assert all(r.skipped == "no vector" and r.category is None for i, r in rows.items() if i >= 10)
    assert all(r.skipped is None and r.category for i, r in rows.items() if i < 10)


def test_retriever_and_its_sql_round_halves_alike(spark, tmp_path):
    """A score of 0.36265, of which four decimals are shown."""
    import duckdb

    vectors = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.36265, 0.0]), (2, [0.41235, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "plain text", "en", "src0", 10) for i, _ in vectors], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = {tuple(r) for r in con.execute(ORACLES["k4_x5_retriever"]).fetchall()}
    assert {tuple(r) for r in Q.k4(spark, str(tmp_path)).collect()} == want and (20, "ok", None, "0:1.0,2:0.4124,1:0.3627") in want


def test_a_fit_has_no_more_partitions_than_cores(spark, monkeypatch):
    """What a pass of a fit sends grows with its partitions."""
    seen = []

    class Fit:
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", rows["label"])

    monkeypatch.setattr(M, "classifier", lambda *a: Fit())
    rows = spark.range(0, 90, 1, 30).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS label", "CAST(id DIV 3 % 3 AS INT) AS fold")
    M.tuned(rows, "nb", grid=(0.1,))
    M.cross_validated(rows, {"nb": 0.1}, 3)
    assert len(seen) == 6 and max(seen) <= spark.sparkContext.defaultParallelism


def test_terms_are_made_after_the_split(spark, folder, monkeypatch):
    columns, split = [], Q.S.split
    monkeypatch.setattr(Q.S, "split", lambda df, *a, **kw: columns.append(df.columns) or split(df, *a, **kw))
    train, test = Q.parted(spark, folder, 3)
    assert columns == [["doc_id", "text", "sentiment_label"]] and train.count() == 48 and test.count() == 12 and "terms" not in train.columns


def test_audit_of_texts_without_a_direction(spark, tmp_path):
    """Texts without words, and null, have a zero vector, for which there is no cosine: they are in no topic."""
    from voxlake.operators import taxonomy as Y

    texts = ["good food here", "late train again", "", None, " \n"]
    rows = [(i, texts[i % 5], "en", "src0") for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {w for r in Q.tx13(spark, str(tmp_path)).collect() for w in r.keywords.split("|")} == {"good", "food", "here", "good food", "food here", "late", "train", "again", "late train", "train again"}
    found = Y.discover(Q.VEC.embed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id"), 6, 30)
    assert sorted(r.doc_id for r in found.collect()) == list(range(150)) and {r.doc_id % 5 for r in found.where("topic = -1").collect()} == {2, 3, 4}
    nothing = spark.createDataFrame([(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None)], "doc_id long, vector array<double>")
    assert sorted((r.doc_id, r.topic) for r in Y.discover(nothing, 2, 30).collect()) == [(1, -1), (2, -1), (3, -1)]


def test_split_and_folds_do_not_shuffle_texts(spark):
    df = spark.range(300).selectExpr("id", "concat('long text ', id) AS text", "concat('l', id % 3) AS label")
    dealt = Q.S.folds(Q.S.split(df, {"train": 0.8, "test": 0.2}, "id", "label"), 5, "id", "label")
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert dealt.count() == 300 and all("text" not in line for line in plan.splitlines() if "Window" in line or "Aggregate" in line)
    ranked = Q.S.class_ranks(df, "label", "id").selectExpr("id", "IF(_rank <= floor(_size * 0.8 + 0.5), 'train', 'test') AS wanted")
    assert dealt.join(ranked, "id").where("split <> wanted").isEmpty()


def test_a_vocabulary_of_a_sketch_is_that_of_all_terms(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(M, "HELD", 120)
    monkeypatch.setattr(M, "KEPT", 40)
    monkeypatch.setattr(M, "CELLS", 1 << 12)
    docs = [[f"w{(i * k) % (7 + k)}" for k in range(1, 30)] + [f"rare{i}", f"two{i // 2}"] for i in range(200)]
    total, df = Counter(t for d in docs for t in d), Counter(t for d in docs for t in set(d))
    want = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:25]
    train = spark.createDataFrame([(d,) for d in docs], "terms array<string>")
    assert M.features(train, size=25).stages[0].vocabulary == want
    words = train.selectExpr("0 AS key", "array_join(terms, '\n') AS words")
    assert M.terms_in_reach(words, 25, 2).mean() < 0.1 and M.terms_in_reach(words, 25_000, 2).all()


def test_naive_bayes_on_means_is_that_on_rows(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, float(i % 3), i % 4, Vectors.dense([i % 5, i % 7, (i % 3) * 2.0])) for i in range(60)], ["id", "label", "fold", "features"])
    means = M.class_means(rows)
    for fold in (None, 2):
        one, two = M.fitted(rows, [("nb", 0.1, fold)])[0], M.fitted(rows, [("nb", 0.1, fold)], means)[0]
        assert abs(one.theta.toArray() - two.theta.toArray()).max() < 1e-12 and abs(one.pi.toArray() - two.pi.toArray()).max() < 1e-12
    assert means.count() == 12 and M.tuned(rows, "nb", 4, means=means) == M.tuned(rows, "nb", 4)


def test_fits_run_at_once_in_partitions_of_their_own(spark, monkeypatch):
    import threading

    here, seen = threading.Barrier(4, timeout=60), []

    class Fit:
        def __init__(self, kind, value, n):
            self.value = value

        def fit(self, rows):
            here.wait()
            seen.append(rows.rdd.getNumPartitions())
            return self.value

    monkeypatch.setattr(M, "classifier", Fit)
    rows = spark.range(0, 90, 1, 30).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS label", "CAST(id DIV 3 % 3 AS INT) AS fold")
    fits = [("lr", float(value), fold) for fold in range(2) for value in range(4)]
    assert M.fitted(rows, fits) == [value for _, value, _ in fits] and seen == [1] * 8
    monkeypatch.setattr(M, "FIT_ROWS", 90)
    here = threading.Barrier(1)
    assert M.fitted(rows, fits[:2]) == [0.0, 1.0] and seen[8:] == [spark.sparkContext.defaultParallelism] * 2
