"""The bucketed store of keys: the same rows as the whole history gives, read in proportion to the upload."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as X
from voxlake.operators import ingest as I
from voxlake.plans import text_queries as Q
from voxlake.sources.known import BY_HASH, KnownStore, hash_key

SCHEMA = "organisation_id long, data_source_id string, external_id string, content_hash string"


def history(spark, n):
    rows = spark.range(n).selectExpr("id % 2 AS organisation_id", "concat('s', id % 3) AS data_source_id", "CASE WHEN id % 5 > 0 THEN concat('e', id) END AS external_id", "concat('text ', id) AS text")
    return rows.withColumn("content_hash", X.content_hash("text")).drop("text")


def upload(spark, rows):
    return I.validated(spark.createDataFrame(rows, "source_row int, text string, id string"))


def put(rows, known, org=1, source="s1", **kw):
    return I.import_rows(rows, known, organisation_id=org, data_source_id=source, import_batch_id="b", **kw)


def kept(done):
    return sorted((r.source_row, r.text, r.external_id) for r in done.kept.collect())


def test_same_rows_as_the_whole_history(spark, tmp_path):
    known, store = history(spark, 3000), KnownStore(spark, str(tmp_path / "k"), 16)
    store.append(known)
    rnd = random.Random(3)
    rows = upload(spark, [(i + 2, f"text {rnd.randrange(4000)}", rnd.choice([None, f"e{rnd.randrange(4000)}"])) for i in range(600)])
    for org, source in ((1, "s1"), (0, "s0"), (1, "s9"), (7, "s1")):
        a, b = put(rows, known, org, source), put(rows, store, org, source)
        assert kept(a) == kept(b) and a.counters.collect() == b.counters.collect() and len(kept(a)) > 0


def test_large_uploads_are_not_broadcast(spark, tmp_path, monkeypatch):
    known, store = history(spark, 500), KnownStore(spark, str(tmp_path / "k"), 4)
    store.append(known)
    rows = upload(spark, [(i + 2, f"text {i}", f"e{i}") for i in range(700)])
    want = kept(put(rows, known))
    monkeypatch.setattr(I, "BROADCAST_ROWS", 10)
    assert kept(put(rows, store)) == kept(put(rows, known)) == want and len(want) > 0


def read_bytes(spark, df):
    """Bytes of the files that a plan's scans open."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        found = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return sum(m.get("filesSize").get().value() for m in found if m.contains("filesSize"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    store = KnownStore(spark, str(tmp_path_factory.mktemp("known")), 64)
    store.append(history(spark, 60_000))
    return store


def test_reads_follow_the_upload(spark, large):
    keys = lambda n: upload(spark, [(i, f"text {2 * i + 1}", None) for i in range(n)]).select(X.content_hash("text").alias("content_hash")).select(hash_key().alias("key"))
    few, more = (large.met(keys(n), 1, BY_HASH, True) for n in (1, 8))
    whole = spark.read.parquet(f"{large.path}/organisation_id=1/kind={BY_HASH}").select("key")
    one, eight, all_ = read_bytes(spark, few), read_bytes(spark, more), read_bytes(spark, whole)
    assert few.count() == 1 and more.count() == 8
    assert 0 < one < all_ / 40 and one < eight <= 8.5 * one
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    scan = plan[: plan.index("PartitionFilters")].rsplit("FileScan", 1)[0]
    assert "Exchange" not in scan.split("BroadcastHashJoin")[-1].split("BroadcastExchange")[0]  # the history is not shuffled


def test_appends_and_compaction(spark, tmp_path):
    store = KnownStore(spark, str(tmp_path / "k"), 2)
    assert store.compact(1) == 0
    rows = history(spark, 200)
    for n in range(4):
        store.append(rows.where(f"crc32(content_hash) % 4 = {n}"))
        store.append(rows.where(f"crc32(content_hash) % 4 = {n}"))  # a retry
    up = upload(spark, [(i + 2, f"text {i}", None) for i in range(300)])
    want = kept(put(up, store))
    files = lambda: spark.read.parquet(f"{store.path}/organisation_id=1").select("_metadata.file_path").distinct().count()
    before = files()
    assert store.compact(1, files=3) == 4 and files() == 4 < before and store.compact(1, files=3) == 0
    assert kept(put(up, store)) == want == kept(put(up, rows))


def test_what_is_kept_is_known_next_time(spark, tmp_path):
    store = KnownStore(spark, str(tmp_path / "k"), 8)
    rows = upload(spark, [(2, "a b", "1"), (3, "c", None), (4, "a  b", "2"), (5, "", "3")])
    first = put(rows, store)
    assert kept(first) == [(2, "a b", "1"), (3, "c", None)]
    store.append(first.kept)
    assert kept(put(rows, store)) == [] and kept(put(rows, store, org=2)) == kept(first)
    assert kept(put(upload(spark, [(2, "new", "1"), (3, "newer", None)]), store)) == [(3, "newer", None)]
    assert kept(put(upload(spark, [(2, "new", "1")]), store, source="s2")) == [(2, "new", "1")]


def test_an_upload_is_validated_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = Q.upload_of(spark.range(1000).selectExpr("id AS event_id", "'click' AS event_type")).withColumn("Comment", counted("Comment"))
    empty = spark.createDataFrame([], SCHEMA)
    monkeypatch.setattr(Q, "upload", lambda spark, d: rows)
    monkeypatch.setattr(Q, "known", lambda spark, d: empty)
    out = Q.x9_store(spark, "").collect()
    assert len(out) > 100 and not any(r.again for r in out) and seen.value == 1000


def test_what_follows_reads_ranked_rows_and_null_ids_pass_by(spark, tmp_path, monkeypatch):
    known, store = history(spark, 500), KnownStore(spark, str(tmp_path / "k"), 4)
    store.append(known)
    monkeypatch.setattr(I, "BROADCAST_ROWS", 10)
    rows = upload(spark, [(i + 2, f"text {i % 900}", None if i % 3 else f"e{i}") for i in range(1200)])
    for held in (known, store):
        kept = put(rows, held).kept
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        anti = plan[plan.index("Join LeftAnti, (external_id") :].split("\n")
        assert "Window" not in plan
        assert "isnotnull(external_id" in "".join(anti[1:3])  # no task gets all rows without an id
        assert "min_by" in plan[: plan.index("Join LeftAnti, (external_id")]
