"""Tenant-scoped feedback: the joined base frame and its filters, shared by lists and aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LABELS


@dataclass(frozen=True)
class FeedbackFilters:
    sentiment: str | None = None
    category_key: str | None = None
    unclassified: bool | None = None
    platform: str | None = None
    search: str | None = None
    date_from: datetime | str | None = None
    date_to: datetime | str | None = None
    rating_min: float | None = None
    rating_max: float | None = None
    analysed: bool | None = None

    def __post_init__(self):
        if self.sentiment is not None and self.sentiment.lower() not in LABELS:
            raise ValueError(f"unknown sentiment {self.sentiment!r}")
        if self.search is not None and len(self.search.strip()) < 2:
            raise ValueError("a search term needs two characters")
        if self.date_from is not None and self.date_to is not None and str(self.date_from) > str(self.date_to):
            raise ValueError("date_from is after date_to")
        for bound in (self.rating_min, self.rating_max):
            if bound is not None and not 1 <= bound <= 5:
                raise ValueError("ratings go from 1 to 5")


def base_frame(feedback: DataFrame, results: DataFrame, categories: DataFrame, *, organisation_id: int) -> DataFrame:
    """Feedback of one tenant with its current result and category; each feedback row once, analysed or not.

    Results name their category by id, so a tenant's own and renamed categories have their own names. Another tenant's
    category is not shown, whatever a result says; retired ones are."""
    own = feedback.where(F.col("organisation_id") == organisation_id)
    current = results.where("is_current").where(F.col("organisation_id") == organisation_id).select("feedback_id", "label", "category_id", "confidence", "is_unclassified", F.lit(True).alias("has_result"))
    known = categories.where(F.col("organisation_id").isNull() | (F.col("organisation_id") == organisation_id))
    names = known.select(F.col("id").alias("category_id"), F.col("key").alias("category_key"), F.col("name").alias("category_name"))
    return own.join(current, "feedback_id", "left").join(names, "category_id", "left")


def conditions(f: FeedbackFilters) -> list[Column]:
    out: list[Column] = []
    if f.sentiment is not None:
        out.append(F.col("label") == f.sentiment.lower())
    if f.category_key is not None:
        out.append(F.col("category_key") == f.category_key)
    if f.unclassified is not None:
        out.append(F.col("is_unclassified").eqNullSafe(F.lit(f.unclassified)))
    if f.platform is not None:
        out.append(F.get_json_object("metadata", "$.platform") == f.platform)
    if f.search is not None:
        out.append(F.contains(F.lower("text"), F.lower(F.lit(f.search.strip()))))
    if f.date_from is not None:
        out.append(F.col("feedback_at") >= F.lit(f.date_from).cast("timestamp_ntz"))
    if f.date_to is not None:
        out.append(F.col("feedback_at") <= F.lit(f.date_to).cast("timestamp_ntz"))
    if f.rating_min is not None:
        out.append(F.col("rating") >= f.rating_min)
    if f.rating_max is not None:
        out.append(F.col("rating") <= f.rating_max)
    if f.analysed is not None:
        out.append(F.col("has_result").isNotNull() if f.analysed else F.col("has_result").isNull())
    return out


def apply_filters(base: DataFrame, f: FeedbackFilters = FeedbackFilters()) -> DataFrame:
    for c in conditions(f):
        base = base.where(c)
    return base


def available_categories(categories: DataFrame, *, organisation_id: int) -> DataFrame:
    """Active own and default categories; an own one stands for the default of its key."""
    seen = categories.where(F.col("is_active") & (F.col("organisation_id").isNull() | (F.col("organisation_id") == organisation_id)))
    return seen.groupBy("key").agg(F.max_by("name", F.col("organisation_id").isNotNull()).alias("name"), F.max(F.col("organisation_id").isNotNull()).alias("own"))


def latest_jobs(jobs: DataFrame, *, organisation_id: int | None = None, kind: str = "analyse") -> DataFrame:
    """The newest job of each import: by creation, then id."""
    own = jobs.where(F.col("kind") == kind)
    if organisation_id is not None:
        own = own.where(F.col("organisation_id") == organisation_id)
    order = F.struct("created_at", "id")
    import_id = F.get_json_object("payload", "$.import_batch_id").alias("import_id")
    return own.groupBy("organisation_id", import_id).agg(F.max_by("status", order).alias("status"), F.max_by("attempts", order).alias("attempts"), F.max_by("max_attempts", order).alias("max_attempts"), F.max("created_at").alias("created_at"))


def job_state(status: str = "status") -> Column:
    """pending, failed or done; a failure with attempts left is pending again."""
    s = F.col(status)
    spent = F.col("attempts") >= F.col("max_attempts")
    return F.when(s.isin("queued", "running") | ((s == "failed") & ~spent), "pending").when(s == "failed", "failed").otherwise("done")


def listing(base: DataFrame, *, sort: str = "created_at", descending: bool = True, page: int = 1, page_size: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of the base frame, nulls last either way, ids breaking ties. ``after`` (the last row's sort value and id) pages
    by key instead of by offset, which reads no earlier page."""
    if sort not in ("feedback_at", "created_at", "rating"):
        raise ValueError(f"can't sort by {sort!r}")
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page from 1, page_size from 1 to 200")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    if after is not None:
        value, last = after
        same_null = F.col(sort).isNull() & (F.col("feedback_id") > last)
        if value is None:
            base = base.where(same_null)
        else:
            beyond = F.col(sort) < F.lit(value) if descending else F.col(sort) > F.lit(value)
            base = base.where(beyond | ((F.col(sort) == F.lit(value)) & (F.col("feedback_id") > last)) | F.col(sort).isNull())
        return base.orderBy(key, "feedback_id").limit(page_size)
    return base.orderBy(key, "feedback_id").offset((page - 1) * page_size).limit(page_size)


def listing_rows(page: DataFrame) -> DataFrame:
    analysed = F.col("label").isNotNull() | F.col("is_unclassified").isNotNull()
    return page.select("feedback_id", "text", "rating", "feedback_at", "created_at", F.get_json_object("metadata", "$.platform").alias("platform"), "label", "category_key", "category_name", "is_unclassified", analysed.alias("analysed"))


def page_totals(base: DataFrame, page_size: int = 50) -> DataFrame:
    return base.agg(F.count("*").alias("total"), F.ceil(F.count("*") / page_size).alias("pages"))
