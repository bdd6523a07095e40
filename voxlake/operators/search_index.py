"""A stored TF-IDF index: built once, searched by ranges that can still hold one of the k best documents.

Documents are laid in ranges of about ``range_docs``, those with the same heaviest term side by side, so that a range's
documents are alike. A range is one packed row (``sparse.packed``); a block is a term's postings in a range, its head their
largest weight; heads are packed too, HEADS ranges a row. A range's bound for a query is the sum over the query's terms of its
weight times the head there. The ranges with the highest bounds give each query a k-th score to begin with. Then queries in
blocks meet all ranges, and a task scores those queries whose bound reaches that score, and no others; it hands on only what
reaches it too. No posting and no pair of a query and a range is a row of a shuffle, but for the few ranges that come first.
Weights are not negative, so nothing is lost."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import spread, stored
from . import sparse as SP
from .vectors import best_of

#: Weights of queries that are broadcast; more of them are sent to parts of the ranges.
SMALL_QUERIES = 2_000_000
#: Ranges whose heads lie in one row.
HEADS = 16


def build(weights: DataFrame, path: str, range_docs: int = 1024) -> None:
    """``weights``: doc, term, weight (not negative), as ``features.tf_idf`` gives them."""
    heaviest = stored(weights.groupBy("doc").agg(F.max_by("term", F.struct("weight", "term")).alias("head")))
    heads = heaviest.groupBy("head").agg(F.count("*").alias("n"))
    # heads in order of their names give running numbers of documents; a frequent head is spread over ranges of its own
    place = Window.orderBy("bucket")
    buckets = heads.groupBy(F.substring(F.md5("head"), 1, 4).alias("bucket")).agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 65,536 rows at most
    inside = Window.partitionBy("bucket").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    begin = heads.withColumn("bucket", F.substring(F.md5("head"), 1, 4)).join(buckets.select("bucket", "before"), "bucket").select("head", "n", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("begin"))
    nth = F.col("begin") + F.pmod(F.xxhash64("doc"), F.col("n"))  # about even inside a head, without a window over it
    ranges = heaviest.join(begin, "head").select("doc", F.floor(nth / range_docs).alias("range"))
    ranges.write.mode("overwrite").parquet(f"{path}/places")
    places = weights.sparkSession.read.schema(PLACES).parquet(f"{path}/places")
    SP.packed(weights.join(places, "doc").select(F.col("doc").alias("id"), "term", "weight", "range"), F.col("range"), True, "range").write.mode("overwrite").parquet(f"{path}/ranges")
    packed = weights.sparkSession.read.schema(f"range long, {SP.PACKED}").parquet(f"{path}/ranges")

    def heads_of(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, terms, starts, _, weights = SP.fields(b.column("d")[i])
                yield pa.RecordBatch.from_arrays([pa.array([b.column("range")[i].as_py()] * len(terms), pa.int64()), terms, pa.array(most(starts, weights))], names=["id", "term", "weight"])

    heads = packed.select("range", F.expr(SP.FIELDS).alias("d")).mapInArrow(heads_of, "id long, term string, weight double")
    SP.packed(heads, F.floor(F.col("id") / HEADS), True).write.mode("overwrite").parquet(f"{path}/heads")


PLACES = "doc long, range long"


def most(starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The heads of a range: each term's largest weight."""
    return np.maximum.reduceat(weights, starts[:-1]) if len(weights) else np.zeros(0)


def bounds(block, tile) -> tuple[np.ndarray, np.ndarray]:
    """For each query of a block its bound in a range, and how many blocks it meets there."""
    _, q_terms, q_starts, q_codes, q_weights = block
    _, t_terms, starts, _, weights = tile
    of = pc.fill_null(pc.index_in(q_terms, value_set=t_terms), -1).to_numpy(zero_copy_only=False)
    highest = np.append(most(starts, weights), 0.0)[of]
    sums = lambda x: np.diff(np.append(0, np.cumsum(x))[q_starts])
    return sums(highest[q_codes] * q_weights), sums((of >= 0)[q_codes])


def _ranges(spark: SparkSession, path: str, allowed: DataFrame | None) -> DataFrame:
    """range, d (its packed row) and ok: the documents of it that may be found, or null for all."""
    rows = spark.read.schema(f"range long, {SP.PACKED}").parquet(f"{path}/ranges").select("range", F.expr(SP.FIELDS).alias("d"))
    if allowed is None:
        return rows.withColumn("ok", F.lit(None).cast("array<long>"))
    places = spark.read.schema(PLACES).parquet(f"{path}/places")
    some = places.join(allowed.select(F.col("doc").cast("long").alias("doc")), "doc", "left_semi").groupBy("range").agg(F.collect_list("doc").alias("ok"))
    return rows.join(some, "range")


def _scored(q, d, ok, rows: np.ndarray, k: int, least: np.ndarray):
    """The k best documents of a range for some rows of a block, as far as their scores reach ``least``."""
    out = ~np.isin(d[0], ok.values.to_numpy(zero_copy_only=False)) if ok.is_valid else np.zeros(len(d[0]), bool)
    for at in range(0, len(rows), SP.AT_ONCE):
        part = rows[at : at + SP.AT_ONCE]
        s = np.round(SP.product(q, d, part), 9)
        s[:, out] = 0.0
        s[s < least[part][:, None] - 1e-9] = 0.0
        some = np.flatnonzero(s.any(axis=1))
        r, c = best_of(s[some], d[0], k)
        r = some[r]
        r, c = r[s[r, c] > 0], c[s[r, c] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(q[0][part[r]]), pa.array(d[0][c]), pa.array(s[r, c])], names=["query_id", "doc", "score"])


SCORES = "query_id long, doc long, score double"


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, allowed: DataFrame | None = None, seeds: int = 4) -> tuple[DataFrame, DataFrame]:
    """query_id, doc, score and rank of the k best documents; and for each query how many blocks there were and were read.

    ``queries``: query_id, term, weight. ``allowed``: the documents (doc) that a filter leaves, before the k best are taken."""
    q = stored(queries.select(F.col("query_id").cast("long").alias("id"), "term", F.col("weight").cast("double").alias("weight")))
    count, ids = q.agg(F.count("*"), F.approx_count_distinct("id")).first()
    few, block = count <= SMALL_QUERIES, SP.dealt(ids)
    ranges = stored(_ranges(spark, path, allowed))
    heads = spark.read.schema(f"tile long, {SP.PACKED}").parquet(f"{path}/heads")
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    first = SP.best(heads, q, seeds, SMALL_QUERIES).withColumn("k", F.row_number().over(by_bound)).where(F.col("k") <= seeds)
    first = stored(first.select(F.col("query_id").alias("id"), F.col("doc").alias("range")))

    def first_scores(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_, d = (SP.fields(b.column(c)[i]) for c in ("q", "d"))
                yield from _scored(q_, d, b.column("ok")[i], np.arange(len(q_[0])), k, np.zeros(len(q_[0])))

    asked = first.groupBy("range").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    shares = -(-asked // SP.BLOCK)  # the queries of a range in so many blocks
    own = SP.packed(q.join(first, "id"), F.col("range") * shares + F.pmod(F.xxhash64("id"), F.lit(shares)), False, "block")
    own = own.select(F.floor(F.col("block") / shares).alias("range"), F.expr(SP.FIELDS).alias("q"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    seen = stored(top(ranges.join(own, "range").select("q", "d", "ok").mapInArrow(first_scores, SCORES)).drop("rank"))

    least = seen.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("least"))
    known = q.select("id").distinct().join(least, "id", "left").select(block.alias("block"), F.struct("id", F.coalesce("least", F.lit(0.0)).alias("least")).alias("x"))
    known = known.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("known"))  # in order of ids, as a packed row has them
    done = first.groupBy(block.alias("block")).agg(F.collect_list(F.struct("id", "range")).alias("done"))
    blocks = SP.packed(q, block, False, "block").join(known, "block").join(done, "block", "left").select("block", F.expr(SP.FIELDS).alias("q"), "known", "done")
    blocks = stored(blocks)

    def reached(b, i):
        """A pair's block and range, the queries' least scores, their blocks there, and which are to be scored now or were before."""
        q_, d = (SP.fields(b.column(c)[i]) for c in ("q", "d"))
        bound, n = bounds(q_, d)
        floor = b.column("known")[i].values.field(1).to_numpy(zero_copy_only=False)
        before = np.zeros(len(bound), bool)
        if b.column("done")[i].is_valid:
            id_, at = (b.column("done")[i].values.field(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            before = np.isin(q_[0], id_[at == b.column("range")[i].as_py()])
        return q_, d, floor, n, (bound >= floor - 1e-8) & (bound > 0) & ~before, before

    def rest_scores(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_, d, floor, _, now, _ = reached(b, i)
                yield from _scored(q_, d, b.column("ok")[i], np.flatnonzero(now), k, floor)

    def read(batches):
        held = {}
        for b in batches:
            for i in range(b.num_rows):
                q_, _, _, n, now, before = reached(b, i)
                sums = held.setdefault(b.column("block")[i].as_py(), [q_[0].copy(), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)])
                sums[1] += n
                sums[2] += np.where(now | before, n, 0)
        for x in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in x], names=["query_id", "blocks", "blocks_read"])

    pairs = lambda rows: SP.paired(spread(rows).withColumn("tile", F.col("range")), blocks, few).select("block", "range", "q", "d", "known", "done", "ok")
    found = top(seen.union(pairs(ranges).mapInArrow(rest_scores, SCORES)))
    counts = pairs(_ranges(spark, path, None)).mapInArrow(read, "query_id long, blocks long, blocks_read long")
    return found, counts.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("blocks_read").alias("blocks_read")).where("blocks > 0")
