"""Ranked lexical search by presence masks: the k best documents of all for each item of a query table.

Documents become rows of the query terms they hold (``postings``: one pass over the whole texts, stored once), which give
the number of documents, their length and each term's document frequency. In blocks of documents, a bitmap over the item's
terms tells which of them a document holds. Documents of one mask form a group; a group's highest possible score follows
from its mask, its shortest document and each term's largest frequency in the block. Groups are scored by descending
bound until the bound falls under the k-th score found so far by the task, so that no document is left out. Each task
hands on k rows an item; two windows (by a hash of the document, then by item) leave k of them.

Items are read in blocks of at most ``Search.terms`` distinct terms, each block against all documents: a task holds the
terms of a block, counts of ``Search.cells`` cells, and k rows an item.

Results for odd rows: null and empty texts, and texts without a term, have no part in any count and are never found; an
item without terms, or none of whose terms occurs, has no rows; equal scores go by ascending doc_id, a null doc_id last;
repeated documents are documents of their own; repeated item rows count once, other texts under the same item_id are items
of their own (with ranks of their own); empty tables give no rows. Very long texts are read in pieces. Columns other than
doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, table

#: Bytes that part terms become a blank, A to Z lower case. Terms are ASCII letters and digits and all that isn't ASCII.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE, NULL_ID = 1 << 20, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Search:
    k: int = 10
    terms: int = 8192
    cells: int = 1 << 23


@dataclass(frozen=True)
class Item:
    item_id: int | None
    terms: np.ndarray
    repeats: np.ndarray


def terms_of(text: bytes):
    """The terms of a text, in lists of those of about PIECE bytes."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def item_blocks(items: DataFrame, p: Search = Search()):
    """Blocks of items: the numbers of their terms, and the items. One block at a time is held."""
    number: dict[bytes, int] = {}
    block: list[Item] = []
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.encode("text", "UTF-8").alias("text")).where("text IS NOT NULL").distinct()
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        counts: dict[bytes, int] = {}
        for words in terms_of(bytes(text)):
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        if block and len(number) + sum(w not in number for w in counts) > p.terms:
            yield number, block
            number, block = {}, []
        if counts:
            block.append(Item(item_id, np.array([number.setdefault(w, len(number)) for w in counts]), np.array(list(counts.values()))))
    if block:
        yield number, block


def _postings(number: dict[bytes, int], batches):
    size = len(number)
    for batch in slices(batches, 512):
        n, keys, counts = np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        words: list[bytes] = []
        rows: list[tuple[int, int]] = []

        def fold():
            found = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
            key = np.repeat(np.array([r for r, _ in rows], np.int64), np.array([c for _, c in rows], np.int64)) * size + found
            key, count = np.unique(key[found >= 0], return_counts=True)
            keys.append(key)
            counts.append(count)
            words.clear()
            rows.clear()

        for r, text in enumerate(batch.column(1)):
            for part in terms_of(text.as_py() or b""):
                n[r] += len(part)
                words += part
                rows.append((r, len(part)))
                if len(words) > PIECE:
                    fold()
        fold()
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)
        keep = n > 0
        at = np.append(np.searchsorted(key // size, np.flatnonzero(keep)), len(key)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (key % size, count)]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(n[keep]), *lists], names=["doc_id", "n", "terms", "tfs"])


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text) and the query terms it holds with their counts, for each text with a term."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return in_arrow(texts, lambda it: _postings(number, it), "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The k best documents so far of an item."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """A score below this can't come in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def put(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least()
        scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score without its weight; 0 where it doesn't occur. More for more occurrences and a smaller m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def search_block(item: Item, weight: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Takes a block's documents into ``best``; tf: a row for each of the item's terms. Returns how many were scored."""
    w = (weight[item.terms] * item.repeats)[:, None]
    some = np.flatnonzero(tf.any(0))
    if not len(some):
        return 0
    tf, m, ids = tf[:, some].astype(np.int64), m[some], ids[some]
    bits = np.packbits(tf > 0, axis=0)
    mask = np.zeros((len(some), -(-len(bits) // 8) * 8), np.uint8)
    mask[:, : len(bits)] = bits.T
    mask = mask.view(np.uint64)
    mask = mask[:, 0] if mask.shape[1] == 1 else mask.view(f"V{8 * mask.shape[1]}")[:, 0]
    _, one, group = np.unique(mask, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(np.diff(group[order], prepend=-1))
    shortest = np.minimum.reduceat(m[order], at)
    bound = np.where(tf[:, one] > 0, w * gain(tf.max(1)[:, None], shortest[None]), 0).sum(0)
    ahead, size = np.argsort(-bound, kind="stable"), np.diff(np.append(at, len(order)))
    done, step, scored = 0, 8, 0
    while done < len(ahead):
        part = ahead[done : done + step]
        part = part[bound[part] >= best.least()]
        if not len(part):
            break  # all that follow have a lower bound
        rows = order[np.concatenate([np.arange(at[g], at[g] + size[g]) for g in part])]
        best.put((w * gain(tf[:, rows], m[None, rows])).sum(0), ids[rows])
        scored += len(rows)
        done, step = done + step, step * 2
    return scored


def _searched(items: list[Item], weight: np.ndarray, n_docs: int, n_terms: int, p: Search, batches):
    best = [Best(p.k) for _ in items]
    for batch in slices(batches, max(64, p.cells // len(weight))):
        ids, n = np.asarray(batch.column(0).fill_null(NULL_ID)), np.asarray(batch.column(1))
        lists = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        tf = np.zeros((len(weight), batch.num_rows), np.int32)
        tf[np.asarray(lists.flatten()), row] = np.asarray(batch.column(3).flatten())
        m = 25 + 75 * n * n_docs // n_terms
        for item, b in zip(items, best, strict=True):
            search_block(item, weight, tf[item.terms], m, ids, b)
    number = np.repeat(np.arange(len(items)), [len(b.ids) for b in best])
    found = np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)])
    cols = [pa.array(number), pa.array([items[i].item_id for i in number], pa.int64()), pa.array(found, mask=found == NULL_ID), pa.array(np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)]))]
    yield pa.RecordBatch.from_arrays(cols, names=["item_no", "item_id", "doc_id", "score"])


def _searched_all(spark: SparkSession, docs: DataFrame, number: dict[bytes, int], items: list[Item], p: Search) -> DataFrame:
    held = stored(postings(docs, number))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for term, count in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
        df[term] = count
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    found = in_arrow(held, lambda it: _searched(items, weight, n_docs, n_terms, p, it), "item_no long, item_id long, doc_id long, score long")
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", by("item_no", "part")).where(F.col("rank") <= p.k)
    return some.withColumn("rank", by("item_no")).where(F.col("rank") <= p.k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, p: Search = Search()) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    found = [_searched_all(spark, docs, number, block, p) for number, block in item_blocks(items, p)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents WHERE text IS NOT NULL
), corpus AS (
  SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM docs WHERE len(words) > 0
), held AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM docs) GROUP BY ALL
), asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, n_docs
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), corpus GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
