"""Embedding near-dedup: int8 tile products with rigorous error bounds, then full precision where a link is possible.

Each unit vector x is kept as s*q + e with q of int8 and |e| <= eps. For unit x and y, x.y differs from s_x s_y q_x.q_y by
at most eps_x + (1 + eps_x) eps_y, so a pair whose product stays below the threshold by more than that can't be a link. The
products of int8 values are exact in float32 (1024 * 127^2 < 2^24; longer vectors are cut into runs of 1024).

Exact copies are folded first and count by their number. Vectors are dealt over tiles of about ``tile`` by a hash, so that a
large group of near copies is even over the tiles. Only the bytes of q travel to every pair of tiles, which tells which of
its vectors have a possible link in it; only those are sent there again, in double precision, where their possible links are
computed again. Each pair of tiles gives counts by vector and a spanning forest of its links, never the links themselves.
A cosine within 1e-9 of the threshold is always summed in the same way, whatever its neighbours are.

The work grows with the square of the distinct vectors, as comparing all tiles does.

Results for odd rows: vectors that are null, empty, zero, or that hold a null or a non-finite component link with nothing;
vectors of different lengths don't link; repeated vectors link with each other (as do repeated ids, which count once as an
id and get a row each); an empty table gives no row. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, runs, slices, stored, table, together
from .components import connected_components

TILE, ROWS, RUN = 4096, 1024, 1024
_OUT = "a long, b long, n long"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 q, the scale s and a bound on |x - s q|."""
    s = np.abs(x).max(1) / 127
    q = np.rint(x / s[:, None])
    eps = np.linalg.norm(x - s[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), s, eps


def unit(v: pa.Array) -> np.ndarray:
    """The vectors of a list column of one length as unit rows."""
    x = np.asarray(v.flatten(), np.float64).reshape(len(v), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def possible(x, y, at: int, to: int, same: bool, threshold: float) -> np.ndarray:
    """Whether each of the rows at to ``to`` of x may link with each row of y; x and y are (q, s, eps)."""
    (qx, sx, ex), (qy, sy, ey) = x, y
    e = ex[at:to].max()
    least = ((threshold - e - (1 + e) * ey) / sy - 1e-3).astype(np.float32)
    parts = [qx[at:to, k : k + RUN].astype(np.float32) @ qy[:, k : k + RUN].astype(np.float32).T for k in range(0, qx.shape[1], RUN)]
    products = parts[0] if len(parts) == 1 else sum(p.astype(np.float64) for p in parts)
    near = products * (sx[at:to, None].astype(np.float32) * np.float32(1 + 1e-6)) >= least
    if same:
        near &= np.arange(len(qy))[None, :] > np.arange(at, to)[:, None]
    return near


def _roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """parent after joining i[k] with j[k] for all k; every entry points at its root."""
    while True:
        p, q = parent[i], parent[j]
        odd = p != q
        if not odd.any():
            return parent
        i, j, p, q = i[odd], j[odd], p[odd], q[odd]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent != parent[parent]).any():
            parent = parent[parent]


def linked(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair x[i], y[j] of unit rows has a cosine of at least the threshold, in double precision.

    One product serves many pairs, one sum few; they differ in their last bits, so that what lies within 1e-9 of the
    threshold is decided by the sum alone."""
    sums = lambda i, j: np.einsum("ij,ij->i", x[i], y[j]) if len(i) else np.empty(0)
    if len(i) * 20 <= len(x) * len(y):
        return np.concatenate([np.empty(0, bool), *(sums(i[k : k + 50_000], j[k : k + 50_000]) >= threshold for k in range(0, len(i), 50_000))]).astype(bool)
    value = (x @ y.T)[i, j]
    out, close = value >= threshold, np.flatnonzero(np.abs(value - threshold) < 1e-9)
    for k in range(0, len(close), 50_000):
        c = close[k : k + 50_000]
        out[c] = sums(i[c], j[c]) >= threshold
    return out


def tile_links(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, same: bool, threshold: float):
    """Weighted link counts of the rows of x and y, and the root of each row in the forest over x and then y."""
    kept_x, kept_y = quantise(x), quantise(y)
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    parent = np.arange(len(x) + (0 if same else len(y)))
    for at in range(0, len(x), ROWS):
        i, j = np.nonzero(possible(kept_x, kept_y, at, min(at + ROWS, len(x)), same, threshold))
        if not len(i):
            continue
        exact = linked(x[at : at + ROWS], y, i, j, threshold)
        i, j = i[exact] + at, j[exact]
        cx += np.bincount(i, ny[j], len(x)).astype(np.int64)
        cy += np.bincount(j, nx[i], len(y)).astype(np.int64)
        parent = _roots(parent, i, j if same else j + len(x))
    return (cx + cy, cy[:0], parent) if same else (cx, cy, parent)


def _quantised(batches):
    """id, tile, d, and q, s and eps of each vector; vectors of one length are taken together."""
    for b in slices(batches):
        size = np.asarray(b.column(2).value_lengths())
        for d in np.unique(size).tolist():
            own = b.filter(pa.array(size == d))
            q, s, e = quantise(unit(own.column(2)))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.full(len(q), d, np.int32)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s), pa.array(e)], names=["id", "tile", "d", "q", "s", "e"])


def _tile(column) -> tuple[np.ndarray, tuple]:
    """ids and (q, s, eps) of a tile's list of structs."""
    ids = np.asarray(column.field("id"), np.int64)
    q = np.frombuffer(b"".join(column.field("q").to_pylist()), np.int8).reshape(len(ids), -1)
    return ids, (q, np.asarray(column.field("s")), np.asarray(column.field("e")))


def _suspects(batches, threshold: float):
    """For each pair of tiles, the vectors with a possible link in it, and whether they are of the first tile."""
    for batch in batches:
        for k in range(batch.num_rows):
            key, same = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            (ia, a), (ib, b) = (_tile(batch.column(c)[k].values) for c in (2, 3))
            in_a, in_b = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
            for at in range(0, len(ia), ROWS):
                near = possible(a, b, at, min(at + ROWS, len(ia)), same, threshold)
                in_a[at : at + ROWS] |= near.any(1)
                in_b |= near.any(0)
            if same:
                in_a, in_b = in_a | in_b, np.zeros(len(ib), bool)
            ids = np.concatenate([ia[in_a], ib[in_b]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(np.full(len(ids), same)), pa.array(ids), pa.array(np.arange(len(ids)) < in_a.sum())], names=["key", "same", "id", "of_first"])


def _links(batches, threshold: float):
    """For the vectors of each pair of tiles, sent in double precision: their counts of links, and one link of a spanning forest each."""
    for rows in runs(batches):
        rows = rows.combine_chunks()
        first = np.asarray(rows.column("of_first"))
        ids, n, v = np.asarray(rows.column("id")), np.asarray(rows.column("n"), np.float64), rows.column("v").combine_chunks()
        same, x = rows.column("same")[0].as_py(), unit(v)
        order = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
        ids, n, x, m = ids[order], n[order], x[order], int(first.sum())
        ca, cb, root = tile_links(x[:m], x[:m] if same else x[m:], n[:m], n[:m] if same else n[m:], same, threshold)
        count = np.concatenate([ca, cb])
        got = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(ids[root[got]]), pa.array(count[got])], names=["a", "b", "n"])


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``. ``tile``: vectors held at once on either side of a product."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    named = v.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")})  # + 0.0: -0.0 is 0.0
    reps = stored(named.groupBy("h", "g", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    tiles = max(1, -(-reps.count() // tile))
    dealt = reps.select("id", F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"), "v")
    kept = stored(in_arrow(dealt, _quantised, "id long, tile long, d int, q binary, s double, e double"))
    held = kept.groupBy("d", "tile").agg(F.collect_list(F.struct("id", "q", "s", "e")).alias("rows"))  # about ``tile`` rows
    left = held.select("d", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.lit(tiles - 1).cast("long"))).alias("j"), F.col("rows").alias("x"))
    right = held.select("d", F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("i"), F.col("tile").alias("j"), F.col("rows").alias("y"))
    pairs = left.join(right.hint("shuffle_hash"), ["d", "i", "j"]).select(F.xxhash64("d", "i", "j").alias("key"), (F.col("i") == F.col("j")).alias("same"), "x", "y")
    suspects = stored(in_arrow(pairs, lambda b: _suspects(b, threshold), "key long, same boolean, id long, of_first boolean"))
    again = together(suspects.join(reps.select("id", "n", "v"), "id").select("key", "same", "id", "of_first", "n", "v"), "key")
    links = stored(in_arrow(again, lambda b: _links(b, threshold), _OUT))
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    groups = connected_components(links, "a", "b").withColumnRenamed("id", "member")
    found = stored(
        reps.join(counts, "id", "left").join(groups, F.col("id") == F.col("member"), "left")
        .select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    rows = named.select("vec_id", "h", "g").join(found, ["h", "g"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = v.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, (SELECT min(c) FROM r WHERE id = vec_id) AS component_id,
  vec_id = (SELECT min(c) FROM r WHERE id = vec_id) AS kept
FROM embeddings
"""
