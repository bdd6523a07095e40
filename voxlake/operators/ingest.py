"""Uploads and corpora: validation with a report of rejected rows, de-duplication as set steps, the import and the corpus build."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CORPUS, HEADER_ALIASES, MAX_EXTERNAL_ID_CHARS, MAX_PLATFORM_CHARS, MAX_ROWS, MAX_STORED_ERRORS, MAX_TEXT_CHARS
from ..sources.known import BROADCAST_ROWS, BY_HASH, BY_ID, KnownStore, hash_key, id_key
from ..sources.scratch import stored


class UnusableFile(ValueError):
    """The whole file can't be imported."""


def map_header(columns: list[str]) -> dict[str, str]:
    """Logical field to column: case and outer blanks don't count, the first alias in order wins."""
    known = {}
    for c in columns:
        known.setdefault(c.lstrip("﻿").strip().lower(), c)
    found = {field: next((known[a] for a in aliases if a in known), None) for field, aliases in HEADER_ALIASES.items()}
    if found["text"] is None:
        raise UnusableFile(f"no text column; the columns are {', '.join(columns)}")
    return {k: v for k, v in found.items() if v}


def _cell(columns: dict[str, str], field: str) -> Column:
    if field not in columns:
        return F.lit(None).cast("string")
    return F.nullif(X.strip_white(F.col(f"`{columns[field]}`").cast("string")), F.lit(""))


def validated(raw: DataFrame, columns: dict[str, str] | None = None, row_column: str = "source_row", extra: str | None = None) -> DataFrame:
    """Each row's parsed fields and its first error as (row, field, message), or null. ``extra``: cells beyond the header.

    The order of the rules: cells, text, external_id, created_at, rating, platform."""
    columns = columns or map_header([c for c in raw.columns if c not in (row_column, extra)])
    text = X.clean_upload(F.coalesce(F.col(f"`{columns['text']}`").cast("string"), F.lit("")))
    ext, created, rating, platform = (_cell(columns, f) for f in ("external_id", "created_at", "rating", "platform"))
    rows = raw.select("*", text.alias("_text"), ext.alias("_ext"), created.alias("_created"), rating.alias("_rating"), platform.alias("_platform"))
    at, stars = X.parse_time("_created"), X.parse_rating("_rating")
    rule = lambda bad, field, message: F.when(bad, F.struct(F.col(row_column).alias("row"), F.lit(field).alias("field"), F.lit(message).alias("message")))
    rules = [rule(X.strip_white(F.coalesce(F.col(extra), F.lit(""))) != "", "row", "More values than columns in the header.")] if extra else []
    rules += [
        rule(F.col("_text") == "", "text", "Feedback text is empty."), rule(F.length("_text") > MAX_TEXT_CHARS, "text", f"Feedback text is longer than {MAX_TEXT_CHARS:,} characters."),
        rule(F.length("_ext") > MAX_EXTERNAL_ID_CHARS, "external_id", f"Longer than {MAX_EXTERNAL_ID_CHARS} characters."), rule(F.col("_created").isNotNull() & at.isNull(), "created_at", "Not a known date."),
        rule(F.col("_rating").isNotNull() & stars.isNull(), "rating", "Not a number from 1 to 5."), rule(F.length("_platform") > MAX_PLATFORM_CHARS, "platform", f"Longer than {MAX_PLATFORM_CHARS} characters."),
    ]
    return rows.select(F.col(row_column).alias("source_row"), F.col("_text").alias("text"), F.col("_ext").alias("external_id"), at.alias("created_at"), stars.alias("rating"), F.col("_platform").alias("platform"), F.coalesce(*rules).alias("error"))


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NOT NULL").select("error.row", "error.field", "error.message")


def first_by_external_id(rows: DataFrame) -> DataFrame:
    """The first row of each external id in its file. Rows without one pass by, so that null isn't a hot key."""
    some, none = rows.where("external_id IS NOT NULL"), rows.where("external_id IS NULL")
    w = Window.partitionBy("external_id").orderBy("source_row")
    return some.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(none)


def first_by_hash(rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c != "content_hash"]
    best = rows.groupBy("content_hash").agg(F.min_by(F.struct(*fields), "source_row").alias("r"))
    return best.select("content_hash", "r.*").select(*rows.columns)


@dataclass(frozen=True)
class Import:
    kept: DataFrame
    errors: DataFrame
    counters: DataFrame


def _met(once: DataFrame, known: DataFrame | KnownStore, organisation_id, data_source_id: str, few: bool) -> tuple[DataFrame, DataFrame]:
    """The external ids and the content hashes of ``once`` that the source, and the tenant, have. A semi-join cuts what is
    known to the upload's own keys before anything else, so that the history is not shuffled where the upload is ``few``."""
    if isinstance(known, KnownStore):
        keys = once.select("external_id", "content_hash", id_key(F.lit(data_source_id)).alias("_id"), hash_key().alias("_hash"))
        ids = known.met(keys.select(F.col("_id").alias("key")), organisation_id, BY_ID, few)
        hashes = known.met(keys.select(F.col("_hash").alias("key")), organisation_id, BY_HASH, few)
        return keys.join(ids, F.col("_id") == F.col("key")).select("external_id").distinct(), hashes.select(F.lower(F.hex("key")).alias("content_hash"))
    own = known.where(F.col("organisation_id") == organisation_id)
    side = lambda c: F.broadcast(once.select(c).where(F.col(c).isNotNull()).distinct()) if few else once.select(c).distinct()
    ids = own.where(F.col("data_source_id") == data_source_id).join(side("external_id"), "external_id", "left_semi").select("external_id").distinct()
    return ids, own.join(side("content_hash"), "content_hash", "left_semi").select("content_hash").distinct()


def import_rows(rows: DataFrame, known: DataFrame | KnownStore, *, organisation_id: int, data_source_id: str, import_batch_id: str, max_rows: int | None = MAX_ROWS) -> Import:
    """The rows of one validated upload that are new to the tenant, the report, and the counters.

    As sets: errors out, first by external id, none that the source knows by external id, none that the tenant knows by
    content hash, first by content hash. ``known``: a store of keys, whose reads follow the upload, or all rows as
    organisation_id, data_source_id, external_id, content_hash (read whole, and shuffled only for very large uploads)."""
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise UnusableFile(f"more than {max_rows:,} rows")
    rows = stored(rows)  # the report, the counters and the kept rows all read it
    few = rows.count() <= BROADCAST_ROWS
    good = rows.where("error IS NULL").drop("error").withColumn("content_hash", X.content_hash("text"))
    once = stored(first_by_external_id(good))  # hashed and ranked once for all that follows
    ids, hashes = _met(once, known, organisation_id, data_source_id, few)
    # rows without an id pass by the join, since null would be a hot key; a hash is known with all its rows, so that the first of each do
    new = once.where("external_id IS NOT NULL").join(ids, "external_id", "left_anti").select(*once.columns).unionByName(once.where("external_id IS NULL"))
    kept = first_by_hash(new).join(hashes, "content_hash", "left_anti").select(*once.columns)
    kept = kept.withColumns({"organisation_id": F.lit(organisation_id), "data_source_id": F.lit(data_source_id), "import_batch_id": F.lit(import_batch_id)})
    kept = kept.withColumn("metadata", F.to_json(F.struct("source_row", "platform")))
    count = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
    parts = [count(rows, "received"), count(rejected(rows), "rejected"), count(good, "good"), count(once, "once"), count(kept, "stored")]
    wide = reduce(DataFrame.unionByName, parts).groupBy().pivot("what", ["received", "rejected", "good", "once", "stored"]).agg(F.first("n"))
    counters = wide.select(
        "received", "rejected", (F.col("good") - F.col("once")).alias("duplicates_in_file"), (F.col("once") - F.col("stored")).alias("duplicates_in_store"), "stored",
        F.when(F.col("stored") == 0, "failed").otherwise("completed").alias("status"),
    )
    return Import(kept, rejected(rows).orderBy("row").limit(MAX_STORED_ERRORS), counters)


def seen_file(batches: DataFrame, source_hash: str, *, organisation_id: int) -> DataFrame:
    """The newest completed batch of the same bytes, if there is one."""
    same = batches.where((F.col("organisation_id") == organisation_id) & (F.col("source_hash") == source_hash) & (F.col("status") == "completed"))
    return same.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def standard_product_reviews(df: DataFrame, category: str) -> DataFrame:
    text = X.strip_white(F.btrim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))), F.lit(". ")))
    rows = df.where(F.length("text") > 10).select(F.lit("amazon").alias("platform"), F.lit(category).alias("product_category"), text.alias("text"), F.col("rating").cast("double").alias("rating"), F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd").cast("date").alias("date"), "asin")
    return rows.select(F.concat(F.coalesce("asin", F.lit("")), F.lit("_"), F.substring(F.sha2("text", 256), 1, 12)).alias("review_id"), "platform", "product_category", "text", "rating", X.rating_label("rating").alias("sentiment_label"), "date")


def standard_business_reviews(df: DataFrame) -> DataFrame:
    stars = F.coalesce("stars", F.lit(3.0))
    rid = F.coalesce("review_id", F.substring(F.sha2("text", 256), 1, 16))
    return df.where(F.length("text") >= 10).select(rid.alias("review_id"), F.lit("yelp").alias("platform"), F.lit("business").alias("product_category"), "text", stars.alias("rating"), X.rating_label(stars).alias("sentiment_label"), F.try_to_date(F.substring("date", 1, 10)).alias("date"))


def standard_tweets(df: DataFrame) -> DataFrame:
    return df.select(F.col("tweet_id").alias("review_id"), F.lit("twitter_airline").alias("platform"), F.lit("airline").alias("product_category"), "text", X.label_rating("airline_sentiment").alias("rating"), F.col("airline_sentiment").alias("sentiment_label"), F.to_date(F.try_to_timestamp(F.substring("tweet_created", 1, 19))).alias("date"))


def build_corpus(sources: list[DataFrame], least_chars: int = 15) -> DataFrame:
    """The unified corpus: clean, drop what is short or unlabelled, one row for each cleaned text (the first source's), rating 3 where missing."""
    tagged = [s.withColumn("_order", F.lit(k)) for k, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).withColumn("cleaned_text", X.clean_review("text"))
    rows = rows.dropna(subset=["text", "sentiment_label"]).where(F.length("cleaned_text") > least_chars)
    fields = [c for c in rows.columns if c != "_order"]
    first = rows.groupBy(F.sha2("cleaned_text", 256).alias("_h")).agg(F.min_by(F.struct(*fields), F.struct("_order", F.col("review_id").cast("string"))).alias("r"))
    out = first.select("r.*").na.fill(3.0, ["rating"])
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in out.columns else F.lit("").cast(f.dataType).alias(f.name) for f in CORPUS))
