"""Tables that cut lineage: what several later steps read is written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A folder of our own, only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, what: str = "table") -> str:
    return f"{shared_dir(spark)}/voxlake-{what}-{uuid.uuid4().hex}"


#: The tables that ``stored`` has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe when executors go, read column by column.

    The table stays until ``clear`` is called, since frames that read it may be in use."""
    path = fresh_path(df.sparkSession)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> int:
    """Removes all tables that ``stored`` wrote in this application: call it when no frame that reads them is needed."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where their files give fewer partitions than there are cores; otherwise as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
