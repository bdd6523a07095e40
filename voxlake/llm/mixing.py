"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

A source's documents stand in a shuffled order (md5 of seed and id) and their words form one stream, cut into blocks of
``block`` words. Slot i of the schedule is the golden-ratio point frac(i * phi) mapped through the sources' cumulative
targets; the k-th slot of a source takes the k-th block of its stream, and starts again at its end, at most ``cap`` times.

Targets: ``share_percent`` of all words, divided by the weights; a source stops at ``cap`` times its size and the excess
goes to the rest by weight. With sources ordered by cap / weight, the level of the first source that isn't stopped follows
from running sums, so no loop is needed.

Results for odd rows: a null or empty text has size 0 and gives nothing; a null source is a source, ordered last; repeated
rows and repeated ids are rows of their own (ties fall to id, then size); an empty table gives no row. Only ``doc_id``,
``source`` and ``text`` are read, so clashing names do no harm.

Skew: a source is spread over 4096 parts by its key, so that no window holds a source; slots are ranked within chunks of
65536, and only the chunk counts are summed along a source.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

GOLDEN, WIDE, TURN = 2654435769, 1 << 32, 1 << 31
CELLS, CHUNK = 1024, 65536


@dataclass(frozen=True)
class Mix:
    """placements: a row for each document and block of its words; schedule: a row for each slot; targets: by source."""

    targets: DataFrame
    schedule: DataFrame
    documents: DataFrame
    placements: DataFrame


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share_percent: int = 150, cap: int = 2) -> DataFrame:
    """source, source_size, target and the part [lo, hi) of 0 to 2^32 that is the source's.

    The shares of one source depend on those of all, so this works on one row for each source in one task: sources are to be
    few enough for that (a million rows of six numbers are no matter), not hosts of a whole web."""
    every = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in order: sums of doubles depend on it
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = reduce(lambda e, kw: e.when(nth == kw[0], kw[1]), enumerate(weights), F.when(F.lit(False), 0))
    by = by.withColumn("nth", F.row_number().over(order)).withColumn("weight", weight.cast("long"))
    by = by.withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(every) * (share_percent / 100))
    ratio = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    by = by.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "nth", "level"))
    by = by.withColumn("flat", F.min(free).over(every)["level"])
    by = by.withColumn("target", F.least(F.coalesce(F.col("flat"), F.lit(float("inf"))) * F.col("weight"), F.col("most").cast("double")))
    part = F.floor(F.sum("target").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("target").over(every) * WIDE)
    by = by.withColumn("hi", F.when(F.col("nth") == F.max("nth").over(every), F.lit(WIDE)).otherwise(part))
    by = by.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("nth")), F.lit(0)))
    return by.select("source", "source_size", "target", "lo", "hi")


def mix(docs: DataFrame, weights=(5, 2, 1), share_percent: int = 150, cap: int = 2, block: int = 64, seed: str = "mix") -> Mix:
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size")))
    targets = stored(source_targets(sizes, weights, share_percent, cap))

    # where each document stands in its source's stream
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sizes.withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(along), F.lit(0)))
        .join(targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("part").alias("p"), "part_start", "source_size", "target")
    )
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        keyed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")))
        .withColumn("run", F.sum("size").over(within))
        .join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("start", F.col("part_start") + F.col("run") - F.col("size"))
        .select("doc_id", "source", "part", "nth", "size", "source_size", "target", "start")
    )
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    placements = placed.withColumn("block", F.explode_outer(blocks)).withColumn("words", F.coalesce(overlap, F.lit(0)))

    # which block each slot takes
    slots = targets.agg(F.ceil(F.coalesce(F.sum("target"), F.lit(0.0)) / block)).first()[0]  # one number
    point = F.pmod(F.pmod(F.col("slot"), F.lit(TURN)) * GOLDEN, F.lit(WIDE))
    cell = WIDE // CELLS
    spans = targets.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {cell}"))
    dealt = points.join(spans, "cell").where("point >= lo AND point < hi").select("slot", "source", "source_size", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), earlier.alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    n_blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    schedule = (
        dealt.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .withColumn("rank", rank)
        .withColumn("n_blocks", n_blocks)
        .where(F.col("rank") < F.col("n_blocks") * cap)
        .select("slot", "source", "rank", F.expr("rank div n_blocks").alias("epoch"), F.pmod("rank", "n_blocks").alias("block"))
    )
    return Mix(targets, schedule, placed, placements)


def taken_words(m: Mix) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document, repeats counted."""
    uses = m.schedule.groupBy("source", "block").agg(F.count("*").alias("uses")).select(F.col("source").alias("s"), F.col("block").alias("b"), "uses")
    joined = m.placements.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    got = F.sum(F.col("words") * F.coalesce(F.col("uses"), F.lit(0)))
    return joined.groupBy("source", "part", "nth", "doc_id", "size", "source_size", "target").agg(got.cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, small: int = 1_000_000, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes the block with their first word: not at all, once, or up to cap times.

    Texts without a word are in no block and go; rows with one doc_id stay together, by the most that one of them gets."""
    m = mix(docs, **options)
    uses = m.schedule.groupBy("source", "block").agg(F.count("*").alias("uses")).select(F.col("source").alias("s"), F.col("block").alias("b"), "uses")
    first = m.placements.where("block IS NOT NULL").groupBy("source", "part", "nth", "doc_id").agg(F.min("block").alias("block"))
    taken = first.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    taken = stored(taken.groupBy(F.col("doc_id").alias("_taken")).agg(F.max("uses").cast("int").alias("_uses")))
    taken = F.broadcast(taken) if taken.count() <= small else taken
    rows = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("_taken")))
    return rows.withColumn("_uses", F.explode(F.array_repeat(F.lit(0), F.col("_uses")))).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(table(spark, sf_dir, "documents")))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5('mix:' || doc_id) AS key FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (nth - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most, (sum(source_size) OVER ()) * 1.5::DOUBLE AS total FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s1 WINDOW w AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, least((SELECT level FROM s2 WHERE level * weight <= most ORDER BY most / weight, nth LIMIT 1) * weight, most::DOUBLE) AS target FROM s2
), s4 AS (
  SELECT *, CASE WHEN nth = max(nth) OVER () THEN {WIDE} ELSE CAST(floor(sum(target) OVER (ORDER BY nth) / sum(target) OVER () * {WIDE}) AS BIGINT) END AS hi FROM s3
), s AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY nth), 0) AS lo, (source_size + 63) // 64 AS nb FROM s4
), slot AS (
  SELECT i, ((i % {TURN}) * {GOLDEN}) % {WIDE} AS p FROM (SELECT unnest(range(0, (SELECT CAST(ceil(sum(target) / 64) AS BIGINT) FROM s))) AS i)
), k AS (
  SELECT s.source, s.nb, row_number() OVER (PARTITION BY s.source ORDER BY i) - 1 AS rank FROM slot JOIN s ON p >= lo AND p < hi
), u AS (SELECT source, rank % nb AS block, count(*) AS uses FROM k WHERE rank < 2 * nb GROUP BY ALL
), e AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d
), x AS (
  SELECT doc_id, source, size, start, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 AS BIGINT) + 1)) AS block FROM e WHERE size > 0
), t AS (
  SELECT doc_id, sum((least(start + size, (x.block + 1) * 64) - greatest(start, x.block * 64)) * uses) AS taken
  FROM x JOIN u ON x.source IS NOT DISTINCT FROM u.source AND x.block = u.block GROUP BY doc_id
)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t USING (doc_id)
"""
