"""The keys of what a tenant's imports have stored, laid out so that an upload reads only what it can meet.

Keys are SHA-256 digests (of the text, or of data source and external id) in Parquet, partitioned by organisation, kind of
key and hash bucket. An upload names its buckets (their number is bounded), the scan opens only these folders, and the
digests are cut to the upload's own by a semi-join before anything is shuffled: what is read follows the upload, until it
touches every bucket. Choose ``buckets`` so that one holds some hundred thousand keys of the largest tenant.

An append writes a file for each bucket it touches; ``compact`` rewrites the buckets that have gathered many. One writer a
tenant at a time, as an import has anyway. A retried append may write keys twice, which changes no answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import exists, stored

BY_HASH, BY_ID = "hash", "id"
#: Rows of an upload whose keys (32 bytes) may be broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 200_000


def hash_key(content_hash: str = "content_hash") -> Column:
    return F.unhex(F.col(content_hash))


def id_key(source: Column | str = "data_source_id", external_id: str = "external_id") -> Column:
    """Null without an external id. The source's length stands first, so that two names can't run together."""
    return F.unhex(F.sha2(F.concat(F.length(source).cast("string"), F.lit(":"), source, F.lit(":"), F.col(external_id)), 256))


class KnownStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, f"{path}/buckets={buckets}", buckets

    def bucket(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> None:
        """``rows``: organisation_id, data_source_id, external_id, content_hash."""
        kinds = F.array(F.struct(F.lit(BY_HASH).alias("kind"), hash_key().alias("key")), F.struct(F.lit(BY_ID).alias("kind"), id_key().alias("key")))
        keys = rows.select("organisation_id", F.explode(kinds).alias("k")).select("organisation_id", "k.*").where("key IS NOT NULL").distinct()
        keys = keys.withColumn("bucket", self.bucket()).repartition("organisation_id", "kind", "bucket")
        keys.sortWithinPartitions("organisation_id", "kind", "bucket", "key").write.mode("append").partitionBy("organisation_id", "kind", "bucket").parquet(self.path)

    def _read(self, organisation_id, kind: str) -> DataFrame | None:
        folder = f"{self.path}/organisation_id={organisation_id}/kind={kind}"
        if not exists(self.spark, folder):
            return None
        return self.spark.read.schema("key binary, bucket int").parquet(folder)

    def met(self, keys: DataFrame, organisation_id, kind: str, few: bool) -> DataFrame:
        """Those of ``keys`` (key) that the tenant has. ``few``: they are at most BROADCAST_ROWS."""
        held = self._read(organisation_id, kind)
        keys = keys.where("key IS NOT NULL").select("key").distinct()
        if held is None:
            return keys.where("false")
        touched = sorted(r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect())
        some = held.where(F.col("bucket").isin(touched)) if len(touched) < self.buckets else held
        return some.select("key").join(F.broadcast(keys) if few else keys, "key", "left_semi").distinct()

    def compact(self, organisation_id, files: int = 8) -> int:
        """Rewrites the tenant's buckets of more than ``files`` files as one file each; how many those were."""
        done = 0
        for kind in (BY_HASH, BY_ID):
            held = self._read(organisation_id, kind)
            if held is None:
                continue
            many = [r.bucket for r in held.select("bucket", F.col("_metadata.file_path").alias("f")).groupBy("bucket").agg(F.countDistinct("f").alias("n")).where(F.col("n") > files).select("bucket").collect()]
            if many:
                rows = stored(held.where(F.col("bucket").isin(many)).distinct())
                rows = rows.repartition("bucket").sortWithinPartitions("bucket", "key")
                folder = f"{self.path}/organisation_id={organisation_id}/kind={kind}"
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
            done += len(many)
        return done
