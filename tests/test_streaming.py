"""Streams give what the batch forms give over the same files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from voxlake.operators import aggregates as A
from voxlake.operators import ingest as I
from voxlake.streaming import jobs as J


def rows(spark, tmp_path):
    start = datetime(2026, 1, 1)
    data = [(k, 1 + k % 2, f"text {k % 30}", start + timedelta(hours=3 * k), ("negative", "neutral", "positive")[k % 3]) for k in range(120)]
    df = spark.createDataFrame(data, "id long, organisation_id long, text string, ts timestamp, label string")
    for part in range(4):
        df.where((F.col("id") >= 30 * part) & (F.col("id") < 30 * part + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def test_live_trend_equals_batch(spark, tmp_path):
    df = rows(spark, tmp_path)
    stream = J.live_trend(J.file_stream(spark, str(tmp_path / "in"), df.schema), "ts")
    J.merged(stream, str(tmp_path / "live"))
    live = J.served(spark, str(tmp_path / "live"), stream.schema, ["period"])
    batch = A.trend(df.withColumn("rating", F.lit(1.0)), "day", F.col("ts"))
    assert {(r.period, r.n, r.negative) for r in live.collect()} == {(r.period, r.n, r.negative) for r in batch.collect()}
    assert J.month_roll_up(live).agg(F.sum("n")).first()[0] == 120
    assert J.lateness(df, "ts", live).first().late == 0


def test_update_mode_merges_counts_late_rows_and_forgets(spark, tmp_path):
    """Only changed periods are written, late rows are counted, the state shrinks, and epochs fold into one."""
    path, into = str(tmp_path / "live"), str(tmp_path / "late")
    (tmp_path / "late").mkdir()
    stream = J.live_trend(spark.readStream.schema("ts timestamp, label string").parquet(into), "ts", delay="1 day")
    left, written, all_ = [], [], []
    for days in ([1, 1, 2, 3], [10, 11], [20, 21], [21, 2, 3, 3, 22]):
        part = spark.createDataFrame([(datetime(2026, 1, day, 5), "neutral") for day in days], "ts timestamp, label string")
        all_ += days
        part.coalesce(1).write.mode("append").parquet(into)
        query = J.merged(stream, path)
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        left.append(states[-1])
        written.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    read = lambda: {r.period.day: r.n for r in J.served(spark, path, stream.schema, ["period"]).collect()}
    want = {1: 2, 2: 1, 3: 1, 10: 1, 11: 1, 20: 1, 21: 2, 22: 1}
    assert read() == want and max(left) <= 3 and max(written) <= 4
    got = J.lateness(spark.read.parquet(into), "ts", J.served(spark, path, stream.schema, ["period"])).first()
    assert (got.received, got.counted, got.late) == (len(all_), 10, 3)
    folders = lambda: sum(x.name.startswith("epoch=") for x in (tmp_path / "live").iterdir())
    before = folders()
    J.fold(spark, path, stream.schema, ["period"])
    assert read() == want and folders() == 2 < before
    spark.createDataFrame([(datetime(2026, 1, 22, 9), "neutral")], "ts timestamp, label string").coalesce(1).write.mode("append").parquet(into)
    J.merged(stream, path)
    assert read() == want | {22: 2}


def test_import_state_changes_equal_batch(spark, tmp_path):
    start, states = datetime(2026, 1, 1), ("queued", "running", "failed", "succeeded")
    data = [(k, k % 2, states[k % 4], k % 4, 3, start + timedelta(hours=7 * k), '{"import_batch_id":"%d"}' % (k % 9)) for k in range(200)]
    e = spark.createDataFrame(data, "id long, organisation_id long, status string, attempts int, max_attempts int, created_at timestamp, payload string")
    into, path = str(tmp_path / "in"), str(tmp_path / "states")
    (tmp_path / "in").mkdir()
    stream = J.import_state_changes(spark.readStream.schema(e.schema).parquet(into))
    for part in range(4):
        e.where((F.col("id") >= 50 * part) & (F.col("id") < 50 * part + 50)).coalesce(1).write.mode("append").parquet(into)
        J.merged(stream, path)
    out = J.served(spark, path, stream.schema, J.STATE_KEYS)
    key = lambda r: (r.organisation_id, r.import_id, r.status, r.state)
    assert sorted(map(key, J.newest_states(out).collect())) == sorted(map(key, J.import_states(e).collect()))
    assert J.lateness(e, "created_at", out).first().late == 0


def test_distinct_feedback(spark, tmp_path):
    df = rows(spark, tmp_path)
    out = J.drained(J.distinct_feedback(J.file_stream(spark, str(tmp_path / "in"), df.schema), "ts", "400 days"), str(tmp_path / "distinct"))
    assert out.count() == df.select("organisation_id", "text").distinct().count()


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, label string"
    for k, (day, n) in enumerate([(1, 2), (20, 1), (21, 1), (2, 5), (22, 1)]):
        spark.createDataFrame([(datetime(2026, 1, day), "neutral")] * n, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = {r.period.day: r.n for r in J.drained(J.live_trend(stream, "ts", delay="1 day"), str(tmp_path / "late")).collect()}
    assert got.get(1) == 2 and 2 not in got


def test_import_stream_equals_batch(spark, tmp_path):
    up = spark.createDataFrame([(k, f"row {k % 25}", f"e{k % 40}") for k in range(2, 102)], "source_row int, text string, id string").coalesce(1)
    up.write.parquet(str(tmp_path / "up"))
    store = str(tmp_path / "store")
    schema = "organisation_id long, data_source_id string, external_id string, content_hash string"
    known = lambda: spark.createDataFrame([], schema) if not (tmp_path / "store").exists() else spark.read.parquet(store).select(*[c.split()[0] for c in schema.split(", ")])
    stream = spark.readStream.schema(up.schema).parquet(str(tmp_path / "up"))
    for _ in range(2):
        J.import_stream(stream, known, lambda x: x.write.mode("append").parquet(store), str(tmp_path / "cp"), organisation_id=1, data_source_id="s").awaitTermination()
    batch = I.import_rows(I.validated(up), spark.createDataFrame([], schema), organisation_id=1, data_source_id="s", import_batch_id="b").kept
    assert sorted(r.source_row for r in spark.read.parquet(store).collect()) == sorted(r.source_row for r in batch.collect())


def test_import_states(spark):
    e = spark.createDataFrame([(1, 1, "failed", 1, 3, datetime(2026, 1, 1), '{"import_batch_id":"a"}'), (2, 1, "failed", 3, 3, datetime(2026, 1, 2), '{"import_batch_id":"b"}'), (3, 1, "succeeded", 1, 3, datetime(2026, 1, 3), '{"import_batch_id":"c"}')], "id long, organisation_id long, status string, attempts int, max_attempts int, created_at timestamp, payload string")
    assert {r.import_id: r.state for r in J.import_states(e).collect()} == {"a": "pending", "b": "failed", "c": "done"}
