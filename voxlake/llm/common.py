"""What the operators of this subpackage share: reading tables, Arrow batches bounded by bytes, cutting lineage in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_dir, stored  # noqa: F401  the operators take them from here

#: The white space of every word definition here: space and U+0009 to U+000D.
WS = "\\x20\\x09-\\x0D"
WORD = f"[^{WS}]+"
WS_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch sent to a Python worker: texts are very unequal, so rows are no bound on memory.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES and one row more at most.

    The limit is a setting of the session (spark.sql.execution.arrow.maxBytesPerBatch), read when the plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def slices(batches, rows: int = 256):
    """Arrow batches cut small, so that a worker's results are as small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def together(df: DataFrame, key: str) -> DataFrame:
    """The rows with those of a key side by side, for ``runs``: the sort spills, so no group has to fit the JVM's memory."""
    return df.repartition(key).sortWithinPartitions(key)


def runs(batches, key: int = 0):
    """The groups of rows with equal keys (column ``key``, long) of a stream that ``together`` has sorted, each as one Arrow table."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(key))
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(k)]
        for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
            if open_ and (i or open_[0].column(key)[0].as_py() != k[0]):
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, z - a))
    if open_:
        yield pa.Table.from_batches(open_)
