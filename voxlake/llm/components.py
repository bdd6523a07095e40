"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import in_arrow, stored

LOCAL = 1_000_000


def _least(edges: DataFrame) -> DataFrame:
    """child and its least parent, as a table: both sides of the joins below are then plain scans, whose hot keys AQE can split."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("child"), "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every child goes to the least parent of its parent; a parent without parents keeps its children."""
    return edges.join(_least(edges), F.col("v") == F.col("child"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A child keeps its least parent, to which its other parents go."""
    least = _least(edges)
    low = edges.join(least, F.col("u") == F.col("child")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.union(least.select(F.col("child").alias("u"), F.col("m").alias("v"))).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, and their number and sums as they were written."""
    seen = Observation()
    table = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.col("u") % 1000003).alias("u"), F.sum(F.col("v") % 1000003).alias("v"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return table, dict(seen.get)


def _joined(batches):
    """child and root of each child of all the edges of one task."""
    edges = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches]
    ids, at = np.unique(np.concatenate([np.empty((2, 0), np.int64), *edges], 1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root != root[root]).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str, local: int = LOCAL) -> DataFrame:
    """id and component (the smallest id reachable) for every id on an edge; loops and nulls are left out, repeats do no harm.

    Edges point from the larger id (child) to the smaller (parent). Up to ``local`` distinct edges (16 bytes each, counted
    first) are joined in one task; beyond, steps over the whole graph follow, both of which group by child with map-side
    minima and join the minima back. Only four numbers for each round come to the driver."""
    edges, mark = _kept(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if mark["n"] <= local:
        edges = stored(in_arrow(edges.coalesce(1), _joined, "u long, v long"))
    else:
        while True:
            edges, now = _kept(_small_star(stored(_large_star(edges))))
            if now == mark:
                break
            mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
