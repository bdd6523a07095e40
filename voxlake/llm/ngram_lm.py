"""Stupid-backoff scores of every document under the word n-grams of the whole corpus, up to ``order``, as joins.

The score of a word is ln(c(u w) / c(u)) for the longest context u of up to order - 1 words before it with which it occurs
``min_count`` times or more (by default 2: a text's own n-gram is among those counted, so that a count of 1 is what nothing
else in the corpus has, and 0 in a count without the text), and ln(alpha) more for each context of the text that is longer; without one it is
ln(c(w) / N). A text's first word scores ln(c(w) / N). Counts are over all rows, the scored one included.

Documents are dealt over blocks of about ``block_chars`` characters by a hash of their place in the input, so that equal
rows go to different blocks; both uses of the dealt rows share one shuffle. A block's n-grams are exploded, folded to
distinct 64-bit hashes (sorted, as differences) with 32-bit counts, and sent to the count tables by hash range, many n-grams to a row; a range adds up
all blocks, and the totals that differ from a block's own counts, because other blocks hold the n-gram too, are joined back to
the block by block, order and range, where they are looked up and summed for each document. Folding before the shuffle sends a frequent n-gram once from each block, so no range is hot, and ranges are
numbered by the size of the corpus, so none outgrows a task.

Results for odd rows: a null or empty text has n_words 0, score 0 and a null mean; repeated rows and ids get a row each and
all count; a null id keeps its row; an empty table gives no row. Only ``doc_id`` and ``text`` are read, whole. Scores are
rounded to six decimals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table


@dataclass(frozen=True)
class Backoff:
    order: int = 2
    alpha: float = 0.4
    min_count: int = 2
    block_chars: int = 16_000_000
    grams_per_range: int = 1_000_000


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts one after another, and the number of words of each."""
    out, size = [], []
    for t in texts:
        words = t.as_py()
        words = words.encode("utf-8", "replace").split() if words else []
        size.append(len(words))
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate([np.empty(0, np.uint64), *out]), np.array(size, np.int64)


def _grams(h: np.ndarray, size: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 on, the n-gram hashes and the positions of their last words."""
    begin = np.repeat(np.cumsum(size) - size, size)
    nth, out = np.arange(len(h)) - begin, [(h, np.arange(len(h)))]
    for n in range(2, order + 1):
        before, places = out[-1]
        at = np.flatnonzero(nth >= n - 1)
        u = before[np.searchsorted(places, at - 1)]
        g = (u * _MIX) ^ (u >> np.uint64(29))
        g = (g + h[at]) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((g ^ (g >> np.uint64(32)), at))
    return out


def _ranges(sorted_grams: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash: n ranges in order."""
    return ((sorted_grams >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(u: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences, all lowest bytes first: the upper bytes are nearly all 0 and shrink when they are sent."""
    return np.diff(u, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _folded(t: pa.Table, n: int, orders: int) -> pa.Table:
    h, size = _words(t.column("text"))
    block, rows = t.column("block")[0].as_py(), []
    for order, (grams, _) in enumerate(_grams(h, size, orders), 1):
        u, c = np.unique(grams, return_counts=True)
        r = _ranges(u, n)
        cuts = np.flatnonzero(np.diff(r)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(u)), strict=True):
            if b > a:
                rows.append((block, order, int(r[a]), _packed(u[a:b]), c[a:b].astype(np.int32)))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    lists = [pa.array(list(c), k) for c, k in zip(cols[3:], (pa.binary(), pa.list_(pa.int32())), strict=True)]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), *lists], names=["block", "order", "range", "grams", "counts"])


def _added(t: pa.Table) -> pa.Table:
    grams, counts = [_unpacked(g) for g in t.column("grams").to_pylist()], t.column("counts").combine_chunks()
    flat, n = np.concatenate(grams), np.asarray(counts.flatten())
    _, at = np.unique(flat, return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)[at]
    lengths = np.array([len(g) for g in grams], np.int64)
    shared = np.flatnonzero(total != n)
    ends = np.cumsum(lengths)
    rows = np.searchsorted(ends, shared, "right")
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(lengths)))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((shared - (ends - lengths)[rows]).astype(np.int32), total[shared])]
    return pa.table([t.column("block"), t.column("order"), t.column("range"), pa.array(lengths.astype(np.int32)), *lists], names=["block", "order", "range", "size", "places", "totals"])


def _scored(docs: pa.Table, found: pa.Table, total: int, p: Backoff) -> pa.Table:
    h, size = _words(docs.column("text"))
    orders, ranges = np.asarray(found.column("order")), np.asarray(found.column("range"))
    sizes = np.asarray(found.column("size")).astype(np.int64)
    places, totals = (found.column(c).combine_chunks() for c in ("places", "totals"))

    def counts(order: int, grams: np.ndarray) -> np.ndarray:
        _, at, known = np.unique(grams, return_inverse=True, return_counts=True)
        rows, begin = np.flatnonzero(orders == order), 0
        for k in rows[np.argsort(ranges[rows])].tolist():
            known[begin + np.asarray(places[k].values)] = np.asarray(totals[k].values)
            begin += sizes[k]
        return known[at].astype(float)

    score, before = np.empty(0), np.empty(0)
    for n, (grams, at) in enumerate(_grams(h, size, p.order), 1):
        c = counts(n, grams)
        if n == 1:
            score = np.log(c / total)
        else:
            score[at] += np.log(p.alpha)
            enough = c >= p.min_count
            score[at[enough]] = np.log(c[enough] / before[at[enough] - 1])
        before = np.zeros(len(h))
        before[at] = c
    first = (np.cumsum(size) - size)[size > 0]
    sums = np.zeros(len(size))
    if len(first):
        sums[size > 0] = np.add.reduceat(score, first)
    mean = [round(s / n, 6) if n else None for s, n in zip(sums.tolist(), size.tolist(), strict=True)]
    return pa.table([docs.column("doc_id"), pa.array(size), pa.array([round(s, 6) for s in sums.tolist()]), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "score", "mean_score"])


def score_documents(docs: DataFrame, p: Backoff = Backoff()) -> DataFrame:
    """doc_id, n_words, score (the sum over words) and mean_score for each row."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    chars, total = docs.select(F.coalesce(F.length("text"), F.lit(0)).alias("c"), words.alias("w")).agg(F.sum("c"), F.sum("w")).first()
    blocks = 1 + (chars or 0) // p.block_chars
    ranges = 1 + (total or 0) // p.grams_per_range
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", block)
    folded = dealt.groupBy("block").applyInArrow(lambda t: _folded(t, ranges, p.order), "block long, order int, range long, grams binary, counts array<int>")
    added = folded.groupBy("order", "range").applyInArrow(_added, "block long, order int, range long, size int, places array<int>, totals array<long>")
    return dealt.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(lambda d, f: _scored(d, f, total, p), "doc_id long, n_words long, score double, mean_score double")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op7_trigram_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), Backoff(order=3))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM w
), c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w
), c2 AS (SELECT u, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, w
), s AS (
  SELECT doc_id, CASE WHEN c2.n >= 2 THEN ln(c2.n / cu.n::DOUBLE) ELSE ln(cw.n / (SELECT count(*) FROM w)::DOUBLE) + CASE WHEN p.u IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM p JOIN c1 cw ON cw.w = p.w LEFT JOIN c1 cu ON cu.w = p.u LEFT JOIN c2 ON c2.u = p.u AND c2.w = p.w
)
SELECT d.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 6) AS score, round(avg(s), 6) AS mean_score
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""

TRIGRAM_SQL = """
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM w
), c1 AS (SELECT w, count(*) AS n FROM w GROUP BY w
), c2 AS (SELECT u, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, w
), c3 AS (SELECT t, u, w, count(*) AS n FROM p WHERE t IS NOT NULL GROUP BY t, u, w
), s AS (
  SELECT p.doc_id, CASE WHEN c3.n >= 2 THEN ln(c3.n / ctx.n::DOUBLE)
    WHEN c2.n >= 2 THEN ln(c2.n / cu.n::DOUBLE) + CASE WHEN p.t IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(cw.n / (SELECT count(*) FROM w)::DOUBLE) + CASE WHEN p.u IS NULL THEN 0 WHEN p.t IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s
  FROM p JOIN c1 cw ON cw.w = p.w LEFT JOIN c1 cu ON cu.w = p.u LEFT JOIN c2 ON c2.u = p.u AND c2.w = p.w
    LEFT JOIN c2 ctx ON ctx.u = p.t AND ctx.w = p.u LEFT JOIN c3 ON c3.t = p.t AND c3.u = p.u AND c3.w = p.w
)
SELECT d.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 6) AS score, round(avg(s), 6) AS mean_score
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
