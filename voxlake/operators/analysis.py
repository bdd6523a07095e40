"""The composite analysis: normalise, score sentiment, gate, categorise, and one result row for each feedback row."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CATEGORY_THRESHOLD, LABELS, SHORTLIST, TOP_CANDIDATES, UNCLASSIFIED
from ..sources.scratch import stored
from .vectors import top_k

CANDIDATES = "array<struct<key:string,score:double>>"
EVIDENCE = "array<struct<doc_id:long,score:double>>"
SENTIMENT = "label string, confidence double, scores map<string,double>, model_version string, error string"
SENTIMENT_ROWS = pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("scores", pa.map_(pa.string(), pa.float64())), ("model_version", pa.string()), ("error", pa.string())])
#: Texts that a worker takes into Python, and a model gets, at a time.
ROWS_AT_ONCE = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def sentiment_udf(make_model: Callable[[], Callable[[list[str]], list[dict[str, float]]]], version: str):
    """An iterator UDF around a batch model. ``make_model`` runs once in each worker; it returns a function from texts to score
    maps, and gets up to ROWS_AT_ONCE texts at a time, so that no more of them are Python's at once. A batch that fails is tried
    row by row, so that one bad text fails alone; so is one of the wrong length."""

    @F.arrow_udf(SENTIMENT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_model()

        def run(texts: list[str]) -> list[dict]:
            out = model(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} predictions for {len(texts)} texts")
            best = [max(sorted(s), key=s.get) for s in out]
            sure = [round(float(s[b]), 4) for s, b in zip(out, best)]
            return [{"label": b, "confidence": None if math.isnan(c) else c, "scores": [(k, round(float(v), 4)) for k, v in s.items()], "model_version": version, "error": None} for s, b, c in zip(out, best, sure)]

        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                texts = [t or "" for t in batch.slice(at, ROWS_AT_ONCE).to_pylist()]
                try:
                    rows = run(texts)
                except Exception:
                    rows = []
                    for t in texts:
                        try:
                            rows += run([t])
                        except Exception as e:
                            rows.append({"label": None, "confidence": None, "scores": None, "model_version": version, "error": f"{type(e).__name__}: {e}"})
                yield pa.array(rows, SENTIMENT_ROWS)

    return score


def one_by_one(predict: Callable[[str], dict[str, float]]) -> Callable[[], Callable[[list[str]], list[dict[str, float]]]]:
    """A batch model of a function over one text."""
    return lambda: lambda texts: [predict(t) for t in texts]


def word_rule_model() -> Callable[[list[str]], list[dict[str, float]]]:
    """The built-in default: the share of words with more vowels than not, as a stand-in until a model is given."""

    def run(texts):
        out = []
        for t in texts:
            words = t.split() or [""]
            up = sum(2 * sum(c in "aeiou" for c in w) > len(w) for w in words) / len(words)
            out.append({"negative": round((1 - up) * 0.6, 6), "neutral": 0.3, "positive": round(up * 0.9, 6)})
        return out

    return run


def lexicon_model(lexicon: dict[str, float], band: float = 0.05) -> Callable[[], Callable[[list[str]], list[dict[str, float]]]]:
    """A batch model of a lexicon of word valences, added and bounded as ``features.lexicon_sentiment`` does."""

    def make():
        def run(texts):
            out = []
            for t in texts:
                s = round(sum(lexicon.get(w, 0.0) for w in re.findall(r"[a-z']+", t.lower())), 9)
                c = round(s / math.sqrt(s * s + 15.0), 6)
                out.append({"negative": max(0.0, -c), "neutral": band, "positive": max(0.0, c)})
            return out

        return run

    return make


def failing_on(make_model: Callable, pattern: str) -> Callable:
    """A model that raises an error for texts with a pattern: for tests of what a failing text does to its neighbours."""

    def make():
        model, bad = make_model(), re.compile(pattern)

        def run(texts):
            for t in texts:
                if bad.search(t):
                    raise ValueError("the text can't be scored")
            return model(texts)

        return run

    return make


def batch_predict(rows: DataFrame, score: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """id, pred and confidence of each row by any model: a failing row is labelled ``error`` and keeps its place by its id."""
    s = rows.select("id", score(F.col(text)).alias("s"))
    return s.select("id", F.when(F.col("s.error").isNotNull(), "error").otherwise(F.col("s.label")).alias("pred"), F.col("s.confidence").alias("confidence"))


def gate(label: str = "label", allowed: tuple[str, ...] = ("negative", "neutral")) -> Column:
    """Why a row gets no category, or null."""
    return F.when(F.col(label).isNull(), "no sentiment").when(~F.col(label).isin(*allowed), F.concat(F.lit("sentiment "), F.col(label)))


def batch_categoriser(make_model: Callable[[], Callable[[list[str], list[dict]], list[list[tuple[str, float]]]]], threshold: float = CATEGORY_THRESHOLD, top: int = TOP_CANDIDATES):
    """A categoriser around a batch model, for ``analyse``: ``make_model`` runs once in each worker and returns a function from
    texts and the taxonomy's rows (key, and what else it has) to (key, score) pairs for each text.

    The taxonomy goes to the workers with the function: up to 1000 rows, refused above."""

    def run(items: DataFrame, categories: DataFrame) -> DataFrame:
        taxonomy = [r.asDict() for r in categories.orderBy("key").limit(1001).collect()]
        if len(taxonomy) > 1000:
            raise ValueError("a taxonomy has up to 1000 categories")

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make_model()
            for frame in frames:
                found = model(frame["text"].fillna("").tolist(), taxonomy)
                if len(found) != len(frame):
                    raise ValueError(f"{len(found)} answers for {len(frame)} texts")
                best = [sorted(((k, round(float(v), 6)) for k, v in pairs), key=lambda x: (-x[1], x[0]))[:top] for pairs in found]
                yield pd.DataFrame({"id": frame["id"], "candidates": [[{"key": k, "score": v} for k, v in b] for b in best]})

        out = items.select("id", "text").mapInPandas(batches, f"id {items.schema['id'].dataType.simpleString()}, candidates {CANDIDATES}")
        first = F.try_element_at("candidates", F.lit(1))
        ok = F.coalesce(first["score"] >= threshold, F.lit(False))
        return out.select("id", F.when(ok, first["key"]).alias("category_key"), first["score"].alias("score"), "candidates", (~ok).alias("is_unclassified"))

    return run


def by_vectors(threshold: float = CATEGORY_THRESHOLD):
    """The categoriser of ``analyse`` by cosine of vectors: see ``categorise``."""
    return lambda items, categories: categorise(items.select("id", "vector"), categories, threshold)


@dataclass(frozen=True)
class CorpusRetriever:
    """Evidence from a table of vectors (doc_id, vector): the k best at or above the threshold, without the item itself."""

    docs: DataFrame
    threshold: float = 0.0
    k: int = 5

    def __call__(self, items: DataFrame) -> DataFrame:
        asked = items.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("query_id"), "vector")
        found = top_k(asked, self.docs, self.k + 1).where((F.col("query_id") != F.col("doc_id")) & (F.col("score") >= self.threshold))
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("under"), "doc_id"))), 1, self.k)
        rows = found.groupBy("query_id").agg(F.transform(best, lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["under"]).alias("score"))).alias("evidence"))
        all_ = items.select("id", F.col("vector").isNull().alias("blind")).join(rows, F.col("id").cast("long") == F.col("query_id"), "left")
        return all_.select("id", F.when(~F.col("blind"), F.coalesce("evidence", F.array().cast(EVIDENCE))).alias("evidence"), F.when(F.col("blind"), "no vector to search with").alias("error"))


def no_retriever(items: DataFrame) -> DataFrame:
    """Finds nothing, and says so: an empty list is no error."""
    return items.select("id", F.array().cast(EVIDENCE).alias("evidence"), F.lit(None).cast("string").alias("error"))


def categorise(items: DataFrame, categories: DataFrame, threshold: float = CATEGORY_THRESHOLD, shortlist: int = SHORTLIST, top: int = TOP_CANDIDATES) -> DataFrame:
    """id, vector in; category_key (null under the threshold), score, candidates and is_unclassified out, a row for each item.

    The taxonomy (key, vector; a few dozen rows, refused above 1000) goes to the workers with the function, where one matrix
    product serves a batch of items. A null vector has no candidates."""
    known = sorted((r["key"], r["vector"]) for r in categories.select("key", F.col("vector").cast("array<double>").alias("vector")).limit(1001).collect())
    if len(known) > 1000:
        raise ValueError("a taxonomy has up to 1000 categories")
    if not known:
        return items.select("id", F.lit(None).cast("string").alias("category_key"), F.lit(None).cast("double").alias("score"), F.lit(None).cast(CANDIDATES).alias("candidates"), F.lit(None).cast("boolean").alias("is_unclassified"))
    keys, matrix, most = np.array([k for k, _ in known]), np.array([v for _, v in known], float).T, min(shortlist, top)

    def run(batches):
        for b in batches:
            there = np.flatnonzero(np.asarray(b.column(1).is_valid()))
            held = b.column(1).take(pa.array(there))
            s = np.asarray(held.flatten(), float).reshape(len(held), matrix.shape[0]) @ matrix
            order = np.argsort(-s, axis=1, kind="stable")[:, :most]  # keys are in order, so that ties fall to the first
            best = pa.StructArray.from_arrays([pa.array(keys[order].ravel(), pa.string()), pa.array(np.round(np.take_along_axis(s, order, 1).ravel(), 6))], ["key", "score"])
            sizes = np.zeros(b.num_rows + 1, np.int32)
            sizes[there + 1] = order.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), best)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "candidates"])

    kind = items.schema["id"].dataType.simpleString()
    ranked = items.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"id {kind}, candidates {CANDIDATES}")
    best = F.try_element_at("candidates", F.lit(1))
    ok = best["score"] >= threshold
    return ranked.select("id", F.when(ok, best["key"]).alias("category_key"), best["score"].alias("score"), "candidates", (~ok).alias("is_unclassified"))


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Within it, Python gets up to ``n`` rows of what is run at a time."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(n))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def analyse(items: DataFrame, score: Callable[[Column], Column], categories: DataFrame | None = None, vector: str | None = None, categoriser: Callable[[DataFrame, DataFrame], DataFrame] | None = None, retriever: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One result for each item (id, text and, to categorise or search by vectors, a vector): status, sentiment, category, the
    reason for none, evidence. An item whose vector is null keeps its sentiment and gets no category by vectors.
    Where a category or evidence is asked for, the scored items are stored first, so that each text is scored once.

    ``categories`` is the taxonomy to use; ``categoriser`` (by vectors without one) takes the open items and it.
    ``retriever`` (None for no evidence stage, ``no_retriever``, a function or a ``CorpusRetriever``) returns id, evidence and
    error. An item that it fails on, or leaves out, is failed: a broken search never looks like one that found nothing."""
    vectors = F.col(vector) if vector else F.lit(None).cast("array<double>")
    rows = items.withColumn("text", X.normalise("text")).withColumn("vector", vectors).withColumn("sentiment", score(F.col("text")))
    by_category = categories is not None and (vector is not None or categoriser is not None)
    if by_category or retriever is not None:
        later = ["text"] if categoriser is not None or retriever is not None else []  # by vectors alone, no text is read again
        before = int(items.sparkSession.conf.get(ARROW_ROWS))
        with arrow_rows(items.sparkSession, min(before, ROWS_AT_ONCE) if before > 0 else ROWS_AT_ONCE):
            rows = stored(rows.select("id", *later, "vector", "sentiment"))
    rows = rows.withColumn("status", F.when(F.col("sentiment.error").isNotNull(), "failed").otherwise("ok")).withColumn("label", F.col("sentiment.label")).withColumn("skipped", gate("label"))
    if by_category:
        if categoriser is None:
            rows = rows.withColumn("skipped", F.coalesce("skipped", F.when(F.col("vector").isNull(), "no vector")))
        open_ = rows.where("skipped IS NULL AND status = 'ok'").select("id", *later, "vector")
        rows = rows.join((categoriser or by_vectors())(open_, categories), "id", "left")
    else:
        rows = rows.withColumns({"category_key": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "candidates": F.lit(None).cast(CANDIDATES), "is_unclassified": F.lit(None).cast("boolean")})
    error = F.col("sentiment.error")
    if retriever is not None:
        found = retriever(rows.where("status = 'ok'").select("id", "text", "vector")).select("id", "evidence", F.col("error").alias("search_error"), F.lit(True).alias("answered"))
        rows = rows.join(found, "id", "left")
        lost = F.when((F.col("status") == "ok") & F.col("answered").isNull(), "the retriever gave no answer")
        error = F.coalesce(error, F.when(F.col("status") == "ok", F.coalesce("search_error", lost)))
        rows = rows.withColumn("evidence", F.when(error.isNull(), F.col("evidence")))
    else:
        rows = rows.withColumn("evidence", F.lit(None).cast(EVIDENCE))
    name = F.when(F.col("is_unclassified"), UNCLASSIFIED).otherwise(F.col("category_key"))
    return rows.select(
        "id", F.when(error.isNotNull(), "failed").otherwise("ok").alias("status"), error.alias("error"), "label", F.col("sentiment.confidence").alias("confidence"), F.col("sentiment.scores").alias("scores"), F.col("sentiment.model_version").alias("model_version"),
        "category_key", name.alias("category"), "score", F.when(F.size("candidates") > 0, F.col("candidates")).alias("candidates"), "is_unclassified", "skipped", "evidence",
    )


def analyse_import(feedback: DataFrame, results: str, runs: str, analyse_: Callable[[DataFrame], DataFrame], *, organisation_id: int, import_batch_id, run_id: str, run_at: str, versions: dict[str, str], thresholds: dict[str, float], rows_at_once: int = 50) -> DataFrame:
    """Analyses the feedback of one import, appends its result rows to ``results`` and its run row to ``runs`` (folders), and
    returns the run row. Models get ``rows_at_once`` texts at a time; rows that fail are stored as failed with the others."""
    spark = feedback.sparkSession
    own = feedback.where((F.col("organisation_id") == organisation_id) & (F.col("import_batch_id") == F.lit(import_batch_id))).select(F.col("feedback_id").alias("id"), "text")
    with arrow_rows(spark, rows_at_once):
        rows = result_rows(analyse_(own), organisation_id=organisation_id, run_id=run_id, run_at=run_at)
        rows.write.mode("append").partitionBy("run_id").parquet(results)
    stored_rows = spark.read.schema(rows.schema).parquet(results).where(F.col("run_id") == run_id)
    run = run_row(stored_rows, versions, thresholds)
    run.write.mode("append").parquet(runs)
    return spark.read.schema(run.schema).parquet(runs).where(F.col("run_id") == run_id)


def result_rows(analysed: DataFrame, *, organisation_id: int, run_id: str, run_at: str) -> DataFrame:
    """Result rows to append: the category only where one is given."""
    stamp = {"organisation_id": F.lit(organisation_id), "run_id": F.lit(run_id), "run_at": F.lit(run_at).cast("timestamp")}
    return analysed.withColumnRenamed("id", "feedback_id").withColumns(stamp)


def run_row(results: DataFrame, versions: dict[str, str], thresholds: dict[str, float], taxonomy_source: str = "default") -> DataFrame:
    """The run's counters with the versions and thresholds that it ran under."""
    ok = F.count_if(F.col("status") == "ok")
    by = results.groupBy("run_id").agg(F.count("*").alias("item_count"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"))
    return by.withColumns({"versions": F.lit(json.dumps(versions, sort_keys=True)), "thresholds": F.lit(json.dumps(thresholds, sort_keys=True)), "taxonomy_source": F.lit(taxonomy_source)})


def current_results(results: DataFrame) -> DataFrame:
    """``is_current``: the newest result of each feedback row, by run time, then run."""
    newest = results.groupBy("feedback_id").agg(F.max(F.struct("run_at", "run_id")).alias("newest"))
    return results.join(newest, "feedback_id").withColumn("is_current", F.struct("run_at", "run_id") == F.col("newest")).drop("newest")


def resolve_categories(matches: DataFrame, categories: DataFrame, *, organisation_id: int) -> DataFrame:
    """Each distinct value to a category id: by id, then key, then name; an own category before a default; else null."""
    own = categories.where(F.col("organisation_id").isNull() | (F.col("organisation_id") == organisation_id))
    default = F.col("organisation_id").isNull().cast("int")
    faces = own.select("id", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("id").cast("string").alias("face")), F.struct(F.lit(1).alias("by"), F.col("key").alias("face")), F.struct(F.lit(2).alias("by"), F.col("name").alias("face")))).alias("f"), default.alias("default"))
    values = matches.select("value").distinct()
    found = values.join(faces, F.col("value") == F.col("f.face")).groupBy("value").agg(F.min_by("id", F.struct(F.col("f.by"), F.col("default"), F.col("id"))).alias("category_id"))
    return values.join(found, "value", "left")
