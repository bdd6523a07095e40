"""Exact percentiles of groups of any size: no task holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def same(keys, left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys), F.lit(True))


def exact_percentiles(df: DataFrame, value: Column, probs: dict[str, float], *keys: str) -> DataFrame:
    """keys and one column for each of ``probs``, interpolated between the two values next to the place. Null values don't
    count; a group without another has no row.

    Equal values of a group are counted first. The distinct ones are sorted over ranges, so that a group lies over as many
    tasks as it takes; the ranges' sums tell in which of them a rank lies, and rows are ranked in those ranges only."""
    counts = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ranged = stored(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    of_group = Window.partitionBy(*keys)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"))
    sums = sums.withColumn("_all", F.sum("_n").over(of_group)).withColumn("_before", F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    place = F.col("_p.p") * (F.col("_all") - 1)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])).alias("_p")
    ranks = sums.select("*", asked).select("*", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"), place.alias("_place"))
    ranks = ranks.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    parts = ranks.groupBy(*keys, "_part", "_before").agg(F.collect_list(F.struct("_p.name", "_rank", "_place")).alias("_asked"))  # two ranks for each of probs at most
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.alias("r").join(parts.alias("p"), same(keys, "r", "p") & (F.col("r._part") == F.col("p._part")))
    rows = rows.select(*(F.col(f"r.{k}").alias(k) for k in keys), "r._v", "r._n", F.col("r._part").alias("_part"), "p._before", "p._asked")
    upto = rows.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    hit = upto.select("*", F.explode("_asked").alias("_a")).where((F.col("_a._rank") < F.col("_end")) & (F.col("_a._rank") >= F.col("_end") - F.col("_n")))
    ends = hit.groupBy(*keys, F.col("_a.name").alias("_name"), F.col("_a._place").alias("_place")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_place") - F.floor("_place"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, between)).alias(name) for name in probs])


def with_percentiles(aggregates: DataFrame, percentiles: DataFrame, *keys: str) -> DataFrame:
    """The two side by side, groups without a value too."""
    joined = aggregates.alias("a").join(percentiles.alias("p"), same(keys, "a", "p"), "left")
    return joined.select("a.*", *(f"p.{c}" for c in percentiles.columns if c not in keys))
