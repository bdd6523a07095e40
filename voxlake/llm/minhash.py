"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

A document's set holds the hashes of its distinct word shingles; equal sets are folded. Each tree sends a set along the
minwise tokens of three coordinates of its own, so that sets that merely share a passage part early. Nodes with one set are
done. A node of more than ``leaf`` sets goes on to the children of one further coordinate, or of two for a quarter of the
nodes (1.25 on average, the inverse of the least similarity, so that a similar pair keeps one common node on average); so
many such levels are taken at once as would bring it to a leaf if half of the sets parted at each. The number of trees
follows from ``target_recall``: a pair of the least similarity s parts in one tree's first node with 1 - s^3, so in all T
of them with (1 - s^3)^T, which has to be 1 - ``target_recall`` at most (17 trees for 0.8).

Only components are asked for, and a node whose sets are of one component has nothing to add. So ``first`` trees come before
the others: their large nodes are cut at random into leaves, otherwise in each tree, which joins nearly all that is alike.
Their links make components, and then only nodes of several components are opened, those large ones once more. Inside a
leaf all sets are compared exhaustively: a sketch of 256 minwise bytes tells which sets have a possible partner of another
component (down to ``slack`` below the least similarity, almost five standard deviations), and those are compared on full
sets, in blocks of ``block_bytes``, by one count of common shingles for all pairs. A leaf returns at most one link for each
of its components, never its pairs. In nodes that are large at the last depth, or where few sets stand outside the largest
component, those sets are compared with each other and with that component, block by block.

Results for odd rows: a null or empty text has an empty set, n_shingles 0, and links with nothing; a text of fewer words
than a shingle is one shingle of all its words; rows with text and one doc_id are one node and share its component; a null doc_id
links with nothing, its component_id is null and it is kept; an empty table gives no row. Only ``doc_id`` and ``text`` are
read. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, runs, slices, stored, table, together
from .components import connected_components

SKETCH, STEPS, LEVELS, SMALL = 256, 3, 6, 1_000_000


@dataclass(frozen=True)
class PathJoin:
    words: int = 5
    percent: int = 80
    target_recall: float = 0.99999
    first: int = 2
    leaf: int = 512
    depth: int = 5
    slack: float = 0.12
    block_bytes: int = 32 << 20

    @property
    def trees(self) -> int:
        trees = math.ceil(math.log(1 - self.target_recall) / math.log(1 - min(self.percent / 100, 0.999) ** STEPS))
        if trees * STEPS > SKETCH:
            raise ValueError("the recall needs more coordinates than a sketch has")
        return max(trees, self.first + 1)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text in order of size."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s *= _M1
        s ^= s >> np.uint64(32)
        s += h[i : n + i]
    s *= _M2
    s ^= s >> np.uint64(31)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def minima(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set: 32 bits for each of SKETCH orders."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[None, at : at + 2048] * _FACTORS[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


_SIGNATURE = "doc_id long, n long, d1 long, d2 long, nodes array<long>, sketch binary"


def _nodes(m: np.ndarray, trees: int) -> np.ndarray:
    """The first node of a set in each tree."""
    x = np.arange(1, trees + 1, dtype=np.uint64)
    for step in m[: trees * STEPS].reshape(trees, STEPS).T.astype(np.uint64):
        x = (x * _M1 + step) * _M2
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


def _signatures(batches, p: PathJoin):
    """Everything that the trees need of a text; the full sets are made again where they are compared."""
    for b in slices(batches):
        n, d1, d2, nodes, sketch = [], [], [], [np.empty(0, np.int64)], []
        for text in b.column(1):
            s = shingles(text.as_py(), p.words)
            m = minima(s)
            n.append(len(s))
            d1.append(int((s * _M1 ^ (s >> np.uint64(29))).sum().view(np.int64)))
            d2.append(int(np.bitwise_xor.reduce(s * _M2 + (s >> np.uint64(31))).view(np.int64)) if len(s) else 0)
            nodes.append(_nodes(m, p.trees))
            sketch.append((m & 255).astype(np.uint8).tobytes())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.trees), pa.array(np.concatenate(nodes)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, pa.array(sketch, pa.binary())], names=["doc_id", "n", "d1", "d2", "nodes", "sketch"])


def _sets(batches, k: int):
    for b in slices(batches, 64):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], names=["id", "s"])


def _possible(n: np.ndarray, sketch: np.ndarray, p: PathJoin, i: int, to: int) -> np.ndarray:
    """Whether each of the sets i to ``to`` may be similar enough to each set, by sizes and sketches."""
    sizes = 100 * np.minimum(n[i:to, None], n) >= p.percent * np.maximum(n[i:to, None], n)
    return sizes & ((sketch[i:to, None] == sketch).sum(2, dtype=np.int16) >= (p.percent / 100 - p.slack) * SKETCH)


def _blocks(n: np.ndarray, limit: int) -> np.ndarray:
    """The block of each set, so that a block's sets have up to ``limit`` bytes, or it has one set."""
    out, block, held = np.zeros(len(n), np.int64), 0, 0
    for i, size in enumerate((8 * n).tolist()):
        if held and held + size > limit:
            block, held = block + 1, 0
        held += size
        out[i] = block
    return out


def _involved(batches, p: PathJoin):
    """The sets of each node with a possible partner of another component: key, id, c; a key is a node or two blocks of it."""
    for node in runs(batches):
        ids, c, n = (node.column(f).to_numpy() for f in ("id", "c", "n"))
        sketch = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        own, step = np.zeros(len(ids), bool), max(1, (4 << 20) // (len(ids) * SKETCH))
        for i in range(0, len(ids), step):
            own[i : i + step] = (_possible(n, sketch, p, i, i + step) & (c[i : i + step, None] != c)).any(1)
        ids, c, n, key = ids[own], c[own], n[own], node.column("key")[0].as_py()
        if not len(ids):
            continue
        block = _blocks(n, p.block_bytes)
        last = int(block[-1])
        pairs = [(a, b) for a in range(last + 1) for b in range(a + 1, last + 1)] or [(0, 0)]
        for a, b in pairs:
            some = (block == a) | (block == b)
            at = key if last == 0 else xxhash.xxh3_64_intdigest(b"%d %d %d" % (key, a, b)) - 2**63
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(some.sum(), at), ids[some], c[some])], names=["key", "id", "c"])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, by products of slices of their incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    item = np.cumsum(new) - 1
    shared = np.bincount(item)[item] > 1
    owner, item = owner[shared], item[shared]
    if not len(item):
        return np.zeros((len(sets), len(sets)))
    column = np.cumsum(np.concatenate(([0], item[1:] != item[:-1])))
    total, width = np.zeros((len(sets), len(sets))), max(256, (4 << 20) // len(sets))
    for at in range(0, int(column[-1]) + 1, width):
        a, z = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
        x[owner[a:z], column[a:z] - at] = 1
        total += x @ x.T
    return total


def _forest(c: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """The component of least id that each component of ``c`` is joined with by a matrix of links between its members."""
    names, at = np.unique(c, return_inverse=True)
    x, y = at[np.argwhere(linked)].reshape(-1, 2).T
    near = np.zeros((len(names), len(names)), bool)
    near[x, y] = near[y, x] = True
    root, out = np.full(len(names), -1), []
    for r in range(len(names)):
        if root[r] < 0:
            reached = np.zeros(len(names), bool)
            reached[r], front = True, np.array([r])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & ~reached)
                reached[front] = True
            root[reached] = r
            out += [(int(names[r]), int(names[k])) for k in np.flatnonzero(reached) if k != r]
    return out


def _links(batches, p: PathJoin):
    """Between the components of each group: the links that full sets confirm, as a forest."""
    for group in runs(batches):
        c = group.column("c").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("s")]
        n, both = np.array([len(s) for s in sets]), common_counts(sets)
        found = _forest(c, (both > 0) & (100 * both >= p.percent * (n[:, None] + n - both)) & (c[:, None] != c))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _near(df: DataFrame, key: str, ids: DataFrame, id_: str) -> DataFrame:
    """``df`` joined with the rows of ``ids`` on key = id_: by broadcast up to SMALL rows, else by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= SMALL else ids, F.col(key) == F.col(id_))


def _open(rows: DataFrame) -> DataFrame:
    """The rows (node, id, c) of the nodes that hold several components, with the node's size and its first set."""
    stat = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("id").alias("first"))
    return stored(rows.join(stored(stat.where("lo <> hi").drop("lo", "hi")), "node"))


class _Join:
    """The steps of one join over the folded documents ``reps``."""

    def __init__(self, docs: DataFrame, p: PathJoin):
        self.p = p
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.signed = stored(in_arrow(self.texts, lambda b: _signatures(b, p), _SIGNATURE))
        alike = self.signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n")
        self.reps = stored(alike.agg(F.min("doc_id").alias("id"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch")))

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """id and full set of the ids of a table's column ``wanted``."""
        p, texts = self.p, _near(self.texts, "doc_id", ids, "wanted").select("doc_id", "text")
        return stored(in_arrow(texts, lambda b: _sets(b, p.words), "id long, s binary"))

    def branched(self, nodes: DataFrame, sketches: DataFrame, largest: int) -> DataFrame:
        """The rows of the next nodes, by the minwise bytes of the coordinates that each node on the way draws."""
        levels = lambda size: F.least(F.lit(LEVELS), F.ceil(F.log2(size / self.p.leaf)))
        draw = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(n)).cast("int")
        coords = F.array_distinct(F.when(draw(2, 4) == 0, F.array(draw(1, SKETCH), draw(3, SKETCH))).otherwise(F.array(draw(1, SKETCH))))
        rows = nodes.select("node", "id", "c", levels(F.col("size")).alias("levels")).join(sketches.select("id", "sketch"), "id")
        for k in range(min(LEVELS, math.ceil(math.log2(largest / self.p.leaf)))):
            rows = rows.withColumn("at", F.explode(F.when(F.col("levels") > k, coords).otherwise(F.array(F.lit(-1)))))
            rows = rows.withColumn("node", F.when(F.col("at") >= 0, F.xxhash64("node", "at", F.expr("substring(sketch, at + 1, 1)"))).otherwise(F.col("node")))
        return stored(rows.select("node", "id", "c"))

    def most(self, nodes: DataFrame) -> DataFrame:
        """node, its largest component, that one's number of sets, all sets and half a leaf."""
        sizes = nodes.groupBy("node", "c").agg(F.count("*").alias("n"))
        return stored(sizes.groupBy("node").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all"), F.lit(max(1, self.p.leaf // 2)).alias("half")))

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Rows node, id, c: a node for each two blocks to be compared, the largest component in blocks of its own, not compared with each other."""
        rows = rows.withColumn("is_main", F.col("c") == F.col("main"))
        rows = rows.withColumn("mains", F.ceil(F.col("inside") / F.col("half"))).withColumn("others", F.ceil((F.col("all") - F.col("inside")) / F.col("half")))
        rows = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
        across = F.expr("CASE WHEN is_main THEN transform(sequence(0L, others - 1), o -> xxhash64(node, 0, k, o)) ELSE transform(sequence(0L, mains - 1), m -> xxhash64(node, 0, m, k)) END")
        among = F.expr("CASE WHEN is_main THEN array() ELSE transform(sequence(0L, others - 1), o -> xxhash64(node, 1, least(k, o), greatest(k, o))) END")
        return rows.select(F.explode(F.concat(across, among)).alias("node"), "id", "c")

    def leaves(self, nodes: DataFrame, sketches: DataFrame) -> DataFrame:
        """key, id and c of the leaves under ``nodes``."""
        p, done, named = self.p, [], lambda x: x.select(F.col("node").alias("key"), "id", "c")
        for depth in range(p.depth + 1):
            done.append(named(nodes.where(F.col("size") <= p.leaf)))
            nodes = nodes.where(F.col("size") > p.leaf)
            most, last = self.most(nodes), depth == p.depth
            done.append(named(self.blocks(nodes.join(most if last else most.where("all - inside <= half"), "node"))))
            many = most.where("all - inside > half")
            largest = None if last else many.agg(F.max("all")).first()[0]
            if largest is None:
                break
            nodes = _open(self.branched(nodes.join(many.select("node"), "node"), sketches, largest))
        return reduce(DataFrame.union, done)

    def compare(self, rows: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) between the components of the sets in the nodes of ``rows``; the rows of nodes that stay to be compared."""
        p, nodes = self.p, _open(rows)
        wanted = stored(nodes.select(F.col("id").alias("wanted")).distinct())
        sketches = stored(_near(self.reps.select("id", "n", "sketch"), "id", wanted, "wanted").drop("wanted"))
        if first:
            part = F.xxhash64("node", F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("size") / p.leaf)))
            keyed = nodes.select(F.when(F.col("size") > p.leaf, part).otherwise(F.col("node")).alias("key"), "id", "c")
        else:
            keyed = self.leaves(nodes, sketches)
        own = stored(in_arrow(together(keyed.join(sketches, "id").select("key", "id", "c", "n", "sketch"), "key"), lambda b: _involved(b, p), "key long, id long, c long"))
        sets = self.sets_of(stored(own.select(F.col("id").alias("wanted")).distinct()))
        found = stored(in_arrow(together(own.join(sets, "id").select("key", "c", "s"), "key"), lambda b: _links(b, p), "a long, b long"))
        return found, nodes.where(F.col("size") > p.leaf).select("node", "id")

    def repeated_ids(self) -> DataFrame:
        """Links from a doc_id that stands in rows of different texts to their sets."""
        twice = self.signed.where("n > 0").groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("doc_id IS NOT NULL AND lo <> hi").select("doc_id")
        rows = self.signed.select("doc_id", "n", "d1", "d2").join(stored(twice), "doc_id")
        return rows.join(self.reps.select("d1", "d2", "n", "id"), ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    def run(self) -> DataFrame:
        """d1, d2, n and component of every set."""
        p = self.p
        rows = self.reps.select("id", F.explode(F.slice("nodes", 1, p.first)).alias("node"), F.col("id").alias("c"))
        found, left = self.compare(rows, True)
        groups = connected_components(found.union(self.repeated_ids()), "a", "b")
        sets = stored(self.reps.select("d1", "d2", "n", "id", F.slice("nodes", p.first + 1, p.trees).alias("nodes")).join(groups, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"))
        rows = sets.select(F.explode("nodes").alias("node"), "id", "c").union(left.join(sets.select("id", "c"), "id").select("node", "id", "c"))
        more = connected_components(self.compare(rows, False)[0], "a", "b")
        return sets.drop("nodes").join(more.withColumnRenamed("id", "c"), "c", "left").select("d1", "d2", "n", F.coalesce("component", "c").alias("component"))


def near_duplicates(docs: DataFrame, p: PathJoin = PathJoin()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: a row for each row of ``docs``."""
    join = _Join(docs, p)
    known, rows = stored(join.run()), join.signed.select("doc_id", "n", "d1", "d2")
    alone = F.expr("n = 0 OR doc_id IS NULL")
    found = rows.where(~alone).join(known, ["d1", "d2", "n"]).select("doc_id", "n", "component")
    found = found.union(rows.where(alone).select("doc_id", "n", F.col("doc_id").alias("component")))
    kept = F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def _without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    gone = stored(gone.select(F.col("doc_id").alias("_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= SMALL else gone
    return rows.join(gone, F.col(key).cast("long") == F.col("_gone"), "left_anti")


def first_of_groups(docs: DataFrame, p: PathJoin = PathJoin()) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id. Rows without a doc_id stay.

    Rows that share a doc_id are documents of their own, with keys of their own beyond the largest doc_id while groups are
    made, so that of copies under one id one stays, and another text under it is not taken for a copy."""
    ids = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    shared = stored(ids.agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    if shared.isEmpty():
        return _without(docs, "doc_id", near_duplicates(docs, p).where("NOT kept"))
    most = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    own = F.col("doc_id").cast("long") == F.col("_id")
    again = docs.join(shared, own, "left_semi").withColumn("_key", F.lit(most + 1) + F.monotonically_increasing_id())
    keyed = stored(docs.join(shared, own, "left_anti").withColumn("_key", F.col("doc_id").cast("long")).unionByName(again))
    groups = stored(near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), p).where("doc_id IS NOT NULL").select("doc_id", "component_id"))
    named = groups.join(keyed.select("_key", F.col("doc_id").cast("long").alias("_id")), F.col("doc_id") == F.col("_key"))
    first = named.groupBy("component_id").agg(F.min(F.struct("_id", "_key"))["_key"].alias("_first")).select("_first")
    return _without(keyed, "_key", groups.join(first, F.col("doc_id") == F.col("_first"), "left_anti")).select(*docs.columns)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PathJoin(words=4))


def oracle_sql(k: int = 4, docs: str = "documents") -> str:
    w = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {w} AS ws FROM {docs}
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [hash(array_to_string(ws, ' '))]
    ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: hash(array_to_string(ws[i:i + {k - 1}], ' '))) END) AS sh
  FROM w WHERE ws IS NOT NULL
), n AS (SELECT doc_id, len(sh) AS n FROM s
), e AS (SELECT doc_id, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), r AS (SELECT doc_id AS id, doc_id AS c FROM {docs} UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a
), g AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, g.c AS component_id, g.c = d.doc_id AS kept
FROM {docs} d JOIN g ON g.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
