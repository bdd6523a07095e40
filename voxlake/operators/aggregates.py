"""Aggregates over the corpus and over one tenant's feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import LABELS
from ..sources.scratch import stored
from .filters import job_state
from .percentiles import exact_percentiles, with_percentiles


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage, 0.0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def label_counts(label: str = "label") -> list[Column]:
    return [F.count_if(F.col(label) == x).alias(x) for x in LABELS]


def corpus_summary(reviews: DataFrame) -> DataFrame:
    n = F.count("*")
    shares = [share(F.count_if(F.col("sentiment_label") == x), n).alias(f"{x}_pct") for x in LABELS]
    return reviews.agg(n.alias("total"), F.countDistinct("platform").alias("platforms"), F.round(F.avg("rating"), 2).alias("avg_rating"), *shares)


def month_trend(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("month", F.date_format("date", "yyyy-MM")).where("month IS NOT NULL").groupBy("month", "sentiment_label").agg(F.count("*").alias("n"))


def tenant_summary(base: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row in one pass: totals, labels and their shares of the analysed, open and failed imports, ratings and dates."""
    state = jobs.withColumn("state", job_state()).select("import_id", "state")
    rows = base.join(state, F.col("import_batch_id").cast("string") == F.col("import_id"), "left")
    done = F.col("has_result").isNotNull()
    n, analysed = F.count("*"), F.count_if(done)
    labels = [c for x in LABELS for c in (F.count_if(F.col("label") == x).alias(x), share(F.count_if(F.col("label") == x), analysed).alias(f"{x}_pct"))]
    return rows.agg(
        n.alias("total"), analysed.alias("analysed"), (n - analysed).alias("not_analysed"), F.count_if(~done & (F.col("state") == "pending")).alias("pending"), F.count_if(~done & (F.col("state") == "failed")).alias("failed"),
        *labels, F.count_if(F.col("is_unclassified")).alias("unclassified"), F.round(F.avg("rating"), 2).alias("avg_rating"), F.min("feedback_at").alias("first_at"), F.max("feedback_at").alias("last_at"),
    )


def trend(base: DataFrame, interval: str = "day", at: Column | None = None, limit: int = 400) -> DataFrame:
    """Counts by period, the earliest ``limit`` periods; empty periods don't appear."""
    if interval not in ("day", "week", "month"):
        raise ValueError(f"unknown interval {interval!r}")
    at = F.coalesce("feedback_at", "created_at") if at is None else at
    period = F.date_trunc(interval, at).cast("timestamp_ntz").alias("period")
    return base.groupBy(period).agg(F.count("*").alias("n"), *label_counts(), F.round(F.avg("rating"), 2).alias("avg_rating")).orderBy("period").limit(limit)


def category_breakdown(base: DataFrame) -> DataFrame:
    """Analysed feedback by category key and name; the null key holds what has no category."""
    by = base.where("has_result").groupBy("category_key", "category_name").agg(F.count("*").alias("n"), *label_counts(), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    whole = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumn("share_pct", share(F.col("n"), whole))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with one column for each known value, and their total."""
    out = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    return out.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0).cast("long")))


def length_profile(reviews: DataFrame) -> DataFrame:
    """Words of a review by platform: exact median and 95th percentile, and mean."""
    sized = stored(reviews.select("platform", X.words("text").alias("_words")))
    means = sized.groupBy("platform").agg(F.round(F.avg("_words"), 3).alias("mean_words"))
    at = exact_percentiles(sized, F.col("_words"), {"median_words": 0.5, "p95_words": 0.95}, "platform")
    return with_percentiles(means, at, "platform").select("platform", F.round("median_words", 3).alias("median_words"), "mean_words", F.round("p95_words", 3).alias("p95_words"))


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, min, exact median, mean, max of the numbers that are there."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    rest = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("max"))
    return with_percentiles(rest, exact_percentiles(df, v, {"median": 0.5}, *keys), *keys).select(*keys, "n", "min", F.round("median", 6).alias("median"), "mean", "max")


def run_counters(results: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if(F.col("status") == "ok")
    return results.groupBy("run_id").agg(n.alias("items"), ok.alias("succeeded"), (n - ok).alias("failed"), (ok == 0).alias("all_failed"))


def category_roll_up(results: DataFrame) -> DataFrame:
    """Total, number of categories, the largest and smallest and the mean size."""
    by = results.where("category_key IS NOT NULL").groupBy("category_key").agg(F.count("*").alias("n"))
    low = F.struct(F.col("n"), F.col("category_key"))
    high = F.struct((-F.col("n")).alias("m"), F.col("category_key"))
    return by.agg(F.sum("n").alias("total"), F.count("*").alias("categories"), F.min_by("category_key", high).alias("largest"), F.min_by("category_key", low).alias("smallest"), F.round(F.avg("n"), 3).alias("mean_size"))


def agreement(scored: DataFrame, label: str = "pred", truth: str = "true_label") -> DataFrame:
    return scored.groupBy("model").agg(F.count("*").alias("scored"), *label_counts(label), F.round(F.avg((F.lower(label) == F.lower(truth)).cast("int")), 6).alias("agreement"))
