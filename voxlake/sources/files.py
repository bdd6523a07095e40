"""Readers and writers of raw corpora, uploads, reports and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BUSINESS_REVIEWS, KEYWORD_FILTER_VERSION, PRODUCT_REVIEWS, TWEETS
from .scratch import stored
from .uploads import read_upload  # noqa: F401  one of the readers


def read_product_reviews(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or gzip; malformed lines are skipped, missing fields are null. A gzip file is one task: repartition after."""
    return spark.read.schema(PRODUCT_REVIEWS).option("mode", "DROPMALFORMED").json(path)


def read_business_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUSINESS_REVIEWS).option("mode", "DROPMALFORMED").json(path)


#: What a null cell is written as where all cells are quoted: a code point that is no character, so that no text is it.
NULL_CELL = "\ufdd0"


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """A quoted cell without characters is an empty text; one without quotes, or with NULL_CELL, is null."""
    names = [c.split()[0] for c in TWEETS.split(", ")]
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", NULL_CELL).csv(path)
    return rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names))


def utf8_files(spark: SparkSession, path: str) -> DataFrame:
    """path, utf8: whether each file's bytes are UTF-8. The bytes stay on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"), F.sha2("content", 256).alias("source_hash"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").partitionBy("platform").parquet(path)


def read_corpus(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def append_feedback(rows: DataFrame, path: str) -> None:
    """Appends to the tenant store; nothing is de-duplicated here."""
    rows.write.mode("append").partitionBy("organisation_id").parquet(path)


def write_keywords(counts: DataFrame, path: str) -> None:
    counts.withColumn("filter_version", F.lit(KEYWORD_FILTER_VERSION)).write.mode("overwrite").parquet(path)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """The keyword table, without rows that another version of the rules made."""
    return spark.read.parquet(path).where(F.col("filter_version") == KEYWORD_FILTER_VERSION)


def write_report(frame: DataFrame, path: str, kind: str = "json", most_rows: int = 1_000_000) -> None:
    """A report as one file, where it has at most ``most_rows`` rows (counted first); a larger one has a file a task."""
    rows = stored(frame)
    writer = (rows.coalesce(1) if rows.count() <= most_rows else rows).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(schema).json(path) if kind == "json" else spark.read.schema(schema).option("header", True).csv(path)
