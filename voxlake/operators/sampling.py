"""Samples, splits and folds that any layout and re-run gives alike: everything is ordered by md5 of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(id_column: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def unit(id_column: str, seed: str) -> Column:
    """A number from 0 up to 1 from the first 32 bits of the draw."""
    return F.conv(F.substring(draw(id_column, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def balanced_sample(df: DataFrame, keys: list[str], n: int, id_column: str, seed: str = "42") -> DataFrame:
    """Up to n rows of each group; Spark cuts each partition to n before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(draw(id_column, seed), id_column)
    return df.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


PREFIX = 4  # hex digits of the draw: a class is ranked in 65,536 pieces


def class_ranks(df: DataFrame, label: str, id_column: str, seed: str = "42") -> DataFrame:
    """``df`` with ``_rank`` (from 1, by draw and id) and ``_size`` of each row's class; a null label is a class.

    Rows are counted by class and prefix of the draw (pre-aggregated, so no class is a hot key). Running sums of the counts
    tell where each prefix begins, and rows are ranked only inside theirs: the widest window holds a class's share of one
    prefix. Ids have to be unique inside a class; the ranks then are the same on every layout."""
    rows = df.withColumn("_draw", draw(id_column, seed))
    prefix = F.substring("_draw", 1, PREFIX)
    counts = df.select(F.col(label).alias("_label"), F.substring(draw(id_column, seed), 1, PREFIX).alias("_prefix")).groupBy("_label", "_prefix").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_label").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("_label", "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_label")).alias("_size"))
    joined = rows.join(places, F.col(label).eqNullSafe(F.col("_label")) & (prefix == F.col("_prefix")))
    inside = Window.partitionBy("_label", "_prefix").orderBy("_draw", id_column)
    return joined.withColumn("_rank", F.col("_before") + F.row_number().over(inside)).drop("_label", "_prefix", "_before", "_draw")


def _parts(shares: dict, rank: Column, size: Column) -> Column:
    """The part of a rank: part k ends at the size times the shares up to k, rounded."""
    at, begin, rule, names = 0.0, F.lit(0).cast("double"), None, list(shares)
    for name in names:
        nested = shares[name] if isinstance(shares[name], tuple) else (shares[name], None)
        at += nested[0]
        end = size if name == names[-1] else F.floor(size * at + 0.5)
        value = F.lit(name) if nested[1] is None else _parts(nested[1], rank - begin, end - begin)
        rule = F.when(rank <= end, value) if rule is None else rule.when(rank <= end, value)
        begin = end
    return rule


#: Classes whose parts' ends are broadcast.
FEW_CLASSES = 1000


def _dealt(df: DataFrame, name: str, part: Column, id_column: str, label: str, seed: str) -> DataFrame:
    """``df`` with the part of each row, which ``part`` makes of ``_rank`` and ``_size``, in ``name``. A part is a run of a
    class's ranks, so its last draw and id tell its rows: only ids and labels are ranked, and wide rows are not shuffled. Where
    there are very many classes the rows themselves are ranked."""
    if df.select(label).distinct().limit(FEW_CLASSES + 1).count() > FEW_CLASSES:
        return class_ranks(df, label, id_column, seed).withColumn(name, part).drop("_rank", "_size")
    own = F.struct(draw(id_column, seed).alias("draw"), F.col(id_column).alias("id"))
    ranked = class_ranks(df.select(id_column, label), label, id_column, seed).select(F.col(label).alias("_label"), part.alias("part"), own.alias("at"))
    lasts = ranked.groupBy("_label", "part").agg(F.max("at").alias("last"))
    ends = lasts.groupBy("_label").agg(F.array_sort(F.collect_list(F.struct("last", "part"))).alias("_ends"))
    joined = df.withColumn("_own", own).join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn(name, F.filter("_ends", lambda x: F.col("_own") <= x["last"])[0]["part"]).drop("_own", "_label", "_ends")


def split(df: DataFrame, shares: dict, id_column: str, label: str, seed: str = "42") -> DataFrame:
    """A stratified ``split`` column: each class's parts are within one row of its share, on any layout.

    A share can be split again, as in ``{"train": 0.7, "rest": (0.3, {"val": 0.5, "test": 0.5})}``."""
    return _dealt(df, "split", _parts(shares, F.col("_rank"), F.col("_size")), id_column, label, seed)


def folds(df: DataFrame, k: int, id_column: str, label: str, seed: str = "42") -> DataFrame:
    """A stratified ``fold`` column from 0: runs of a class's ranks, whose sizes differ by one at most, the longer first."""
    short, longer, at = F.floor(F.col("_size") / k), F.col("_size") % k, F.col("_rank") - 1
    fold = F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / F.greatest(short, F.lit(1))))
    return _dealt(df, "fold", fold.cast("int"), id_column, label, f"fold:{seed}")


def hash_split(df: DataFrame, shares: dict[str, float], id_column: str, seed: str = "42") -> DataFrame:
    """A ``split`` column by hash thresholds: no shuffle, and the shares hold in expectation only (small classes may miss a part)."""
    at, rule = 0.0, F.when(F.lit(False), "")
    for name, part in list(shares.items())[:-1]:
        at += part
        rule = rule.when(unit(id_column, seed) < at, name)
    return df.withColumn("split", rule.otherwise(list(shares)[-1]))


def overlap(test: DataFrame, others: dict[str, DataFrame], id_column: str) -> DataFrame:
    """How many rows of ``test`` each other part holds too, and their share."""
    n, out = test.agg(F.count("*").alias("n_test")), None
    for name, other in others.items():
        hit = test.join(other.select(id_column), id_column, "left_semi").agg(F.count("*").alias("n_shared")).withColumn("part", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out.join(n).select("part", "n_test", "n_shared", F.coalesce(F.round(F.try_divide(F.col("n_shared") * 100.0, F.col("n_test")), 4), F.lit(0.0)).alias("pct"))
