"""Structured Streaming forms of the import, the analysis and the dashboards. Checkpoints make them exactly-once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as X
from ..operators import filters as P
from ..operators import ingest as I
from ..schemas import LABELS
from ..sources.scratch import names, remove, stored


def import_stream(rows: DataFrame, known: Callable[[], DataFrame], store: Callable[[DataFrame], None], checkpoint: str, *, organisation_id: int, data_source_id: str, report: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Every micro-batch goes through the batch import against what the store holds by then."""

    def put(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        done = I.import_rows(I.validated(batch), known(), organisation_id=organisation_id, data_source_id=data_source_id, import_batch_id=f"stream-{epoch}", max_rows=None)
        store(done.kept)
        if report:
            report(done.errors)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_feedback(rows: DataFrame, at: str, delay: str = "7 days") -> DataFrame:
    """The first row of each tenant's content hash within the delay; the full history is the import's anti-join."""
    return rows.withColumn("content_hash", X.content_hash("text")).withWatermark(at, delay).dropDuplicatesWithinWatermark(["organisation_id", "content_hash"])


def analysis_stream(rows: DataFrame, analyse: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """New rows analysed by micro-batches, their results handed to ``store``."""
    return rows.writeStream.foreachBatch(lambda batch, _: store(analyse(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_trend(rows: DataFrame, at: str, window: str = "1 day", delay: str = "2 days", label: str = "label") -> DataFrame:
    """Counts by window and label; rows later than the watermark's delay are dropped (``lateness`` counts them)."""
    by = rows.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"))
    return by.agg(F.count("*").alias("n"), *[F.count_if(F.col(label) == x).alias(x) for x in LABELS]).select(F.col("w.start").alias("period"), "n", *LABELS)


def month_roll_up(days: DataFrame) -> DataFrame:
    """Months from the stream's days, since a month is no fixed window."""
    return days.groupBy(F.date_trunc("month", "period").alias("month")).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in LABELS])


def import_states(events: DataFrame) -> DataFrame:
    """The state of each import from its newest status event, as a batch."""
    order = F.struct("created_at", "id")
    import_id = F.get_json_object("payload", "$.import_batch_id").alias("import_id")
    newest = events.groupBy("organisation_id", import_id).agg(*[F.max_by(c, order).alias(c) for c in ("status", "attempts", "max_attempts")])
    return newest.withColumn("state", P.job_state())


def import_state_changes(events: DataFrame, delay: str = "2 days", span: str = "7 days") -> DataFrame:
    """For update mode: the newest status event of each import in each span of time, and how many there were.

    The state is keyed by span, so that it goes when the watermark passes a span, and stays as large as the imports of the
    last few; ``newest_states`` takes the newest span."""
    import_id = F.get_json_object("payload", "$.import_batch_id").alias("import_id")
    order = F.struct("created_at", "id")
    by = events.withWatermark("created_at", delay).groupBy("organisation_id", import_id, F.window("created_at", span).alias("w"))
    newest = by.agg(F.count("*").alias("n"), F.max(order).alias("newest"), *[F.max_by(c, order).alias(c) for c in ("status", "attempts", "max_attempts")])
    return newest.select("organisation_id", "import_id", F.col("w.start").alias("span"), "n", "newest", "status", "attempts", "max_attempts")


STATE_KEYS = ("organisation_id", "import_id", "span")


def newest_states(changes: DataFrame) -> DataFrame:
    newest = changes.groupBy("organisation_id", "import_id").agg(*[F.max_by(c, "newest").alias(c) for c in ("status", "attempts", "max_attempts")], F.sum("n").alias("n"))
    return newest.withColumn("state", P.job_state())


def merged(stream: DataFrame, path: str) -> StreamingQuery:
    """Update mode: each micro-batch writes the rows that it changed, to a folder of its own (a batch that is run again
    writes the same folder again). ``served`` merges them by key. Runs until all that is there is read."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return query


def _changes(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).parquet(path)


def _latest(changes: DataFrame, keys) -> DataFrame:
    rest = [c for c in changes.columns if c not in (*keys, "epoch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def served(spark: SparkSession, path: str, schema, keys) -> DataFrame:
    """What a ``merged`` stream's readers see: the last row of each key."""
    return _latest(_changes(spark, path, schema), keys)


def fold(spark: SparkSession, path: str, schema, keys) -> None:
    """Merges the folders of all epochs but the newest (which may yet run again) into one, and removes those merged."""
    changes = _changes(spark, path, schema)
    epochs = sorted(int(n[6:]) for n in names(spark, path) if n.startswith("epoch="))[:-1]
    if len(epochs) > 1:
        rows = stored(_latest(changes.where(F.col("epoch") <= epochs[-1]), keys))
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epochs[-1]}")
        for epoch in epochs[:-1]:
            remove(spark, f"{path}/epoch={epoch}")


def lateness(received: DataFrame, at: str, counted: DataFrame, n: str = "n") -> DataFrame:
    """received, counted and late, one row: rows with an event time that came, and those that the served table holds. What
    came later than the watermark allows is the difference, exactly (the engine's own counter sees pre-aggregated rows)."""
    came = received.agg(F.count(at).alias("received"))
    return came.join(counted.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("counted"))).select("received", "counted", (F.col("received") - F.col("counted")).alias("late"))


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream over files gives once all of them are read, as Parquet at ``path`` with the checkpoint beside it: rows are
    appended as they are final."""
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path)
