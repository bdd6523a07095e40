"""Text features as relations: tokens, keyword phrases, TF-IDF weights and search, lexicon sentiment, stop-word language."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..functions.tokenizers import tokenised
from ..schemas import DETERMINERS, TOP_KEYWORDS
from ..sources.scratch import spread, stored
from . import sparse as SP

#: Weights of queries that are broadcast.
SMALL_QUERIES = 2_000_000
#: Texts that are taken from an Arrow batch at a time, and different terms that a task holds before it hands on their counts.
AT_ONCE, HELD = 256, 1_000_000
#: Frequent words or pairs that tasks may be told of; where there are more, longer runs are counted whatever they hold.
TOLD = 200_000
#: Cells of the sketch of a user's tokens, and tokens that a task gathers before it adds them up.
CELLS, GATHERED = 65_536, 2_000_000


def terms(c: str = "text", bigrams: bool = True) -> Column:
    """Lower-case words of two or more letters or digits without accents, and pairs of neighbours."""
    w = F.regexp_extract_all(X.without_accents(F.lower(F.col(c))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    if not bigrams:
        return w
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def pairs_of(words: list[str]) -> list[str]:
    return list(map(" ".join, zip(words, words[1:], strict=False)))


def rows_of(batches):
    """Keys and words of a few texts at a time. ``batches``: key, and the words of a text joined by line feeds."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            part = b.slice(at, AT_ONCE)
            yield part.column(0), [t.split("\n") if t else [] for t in part.column(1).to_pylist()]


def folded(texts: DataFrame, words: Column, key: str, make=None, without: list[str] | None = None) -> DataFrame:
    """key, term and n: how often texts of a key have a term, added up where the texts stand, so that a key and term are on as
    many rows as tasks hold them. A term is a word or a pair of neighbours, or what ``make`` gives for a list of words; those
    that hold a word of ``without`` are left out."""
    out = frozenset(without or ())
    rows = spread(texts.select(F.col(key).alias("key"), F.array_join(words, "\n").alias("words")))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, term string, n long"
    kind = to_arrow_type(rows.schema["key"].dataType)

    def counts(held):
        for key_, c in held.items():
            items = [x for x in c.items() if out.isdisjoint(x[0].split(" "))] if out else list(c.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([key_] * len(part), kind), pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["key", "term", "n"])

    def run(batches):
        held: dict = {}
        for keys, texts_ in rows_of(batches):
            for k, w in zip(keys.to_pylist(), texts_, strict=True):
                c = held.setdefault(k, Counter())
                if make is None:
                    c.update(w)
                    c.update(map(" ".join, zip(w, w[1:], strict=False)))
                else:
                    c.update(make(w))
            if sum(map(len, held.values())) > HELD:
                yield from counts(held)
                held = {}
        yield from counts(held)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def term_counts(docs: DataFrame, id_column: str, bigrams: bool = True, text: str = "text") -> DataFrame:
    """doc id, term and its count. Terms are counted in their text, where it stands; only where an id is on several rows are
    counts added up by a shuffle."""

    def run(batches):
        for ids, texts in rows_of(batches):
            found = [Counter(w + pairs_of(w) if bigrams else w) for w in texts]
            nth = pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]))
            of = lambda values, kind: pa.array([x for c in found for x in values(c)], kind)
            yield pa.RecordBatch.from_arrays([ids.take(nth), of(Counter.keys, pa.string()), of(Counter.values, pa.int64())], names=["doc", "term", "tf"])

    rows = spread(docs.select(F.col(id_column).alias("doc"), F.array_join(terms(text, False), "\n").alias("words")))
    counts = rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, term string, tf long")
    if docs.groupBy(id_column).count().where("count > 1").isEmpty():
        return counts
    return counts.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 2, size: int | None = 50_000) -> DataFrame:
    """The most frequent terms that enough documents have: term, df, total. Without ``size`` all of them, in no order."""
    v = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return v if size is None else v.orderBy(F.desc("total"), "term").limit(size)


def tf_idf(counts: DataFrame, vocab: DataFrame, n_docs: int, sublinear: bool = False) -> DataFrame:
    """doc, term, weight: smoothed idf, rows of unit length."""
    raw = raw_tf_idf(counts, vocab, n_docs, sublinear)
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "doc").select("doc", "term", (F.col("w") / F.col("length")).alias("weight"))


def raw_tf_idf(counts: DataFrame, vocab: DataFrame, n_docs: int, sublinear: bool = False) -> DataFrame:
    """doc, term and w: the weights of ``tf_idf`` before rows are brought to unit length."""
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return counts.join(vocab, "term").select("doc", "term", (tf * idf).alias("w"))


def weight_digest(raw: DataFrame) -> DataFrame:
    """doc, n, heaviest and total of ``tf_idf``'s weights: a document's length and its sums come from one grouping."""
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))
    return raw.groupBy("doc").agg(F.count("*").alias("n"), F.round(F.max("w") / length, 6).alias("heaviest"), F.round(F.sum("w") / length, 6).alias("total"))


def tf_idf_search(queries: DataFrame, weights: DataFrame, k: int, allowed: DataFrame | None = None, post_filter: bool = False) -> DataFrame:
    """query_id, doc, score, rank: cosine by an equi-join on terms. ``queries``: query_id, term, weight. ``allowed`` holds the
    documents (doc) that a filter leaves: before the top-k, or after it with ``post_filter`` (which can give fewer than k).

    Documents are packed into tiles and queries into blocks; a task multiplies a block and a tile and keeps k rows a query, so
    that no pair of a query and a document is ever a row of a shuffle, and no frequent term its key."""
    if allowed is not None and not post_filter:
        weights = weights.join(allowed, "doc", "left_semi")
    docs = weights.select("doc").distinct().count()
    tiles = SP.tiled(weights.select(F.col("doc").alias("id"), "term", "weight"), docs)
    scores = SP.best(tiles, queries.select(F.col("query_id").alias("id"), "term", "weight"), k, SMALL_QUERIES)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    ranked = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(allowed, "doc", "left_semi") if allowed is not None and post_filter else ranked


def runs(rows: DataFrame, length: int, known: dict[str, bool] | None = None) -> DataFrame:
    """label, raw and n: runs of so many words of letters and apostrophes in texts (label, text in lower case), added up where
    the texts stand. ``known``: the shorter runs that longer ones may end in, and whether one may also begin with them if it
    is the longer for it; one that begins with a determiner only has to end in one of them. None lets all be counted."""
    find, first = re.compile(r"[a-z']+").findall, frozenset(DETERMINERS)
    kind = to_arrow_type(rows.schema["label"].dataType)
    ends = None if known is None else frozenset(x.rsplit(" ", 1)[-1] for x in known)

    def made(w):
        if length == 1:
            return w
        if known is None:
            return map(" ".join, zip(*(w[k:] for k in range(length)), strict=False))
        if length == 2:
            return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if b in known and (a in first or (known[b] and known.get(a, False)))]
        pairs = [known.get(f"{a} {b}") if b in ends else None for a, b in zip(w, w[1:], strict=False)]
        return [f"{a} {b} {c}" for a, b, c, x, y in zip(w, w[1:], w[2:], pairs, pairs[1:], strict=False) if y is not None and (a in first or (x and y))]

    def counts(held):
        for label, c in held.items():
            items = list(c.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), kind), pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["label", "raw", "n"])

    def run(batches):
        held: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                for label, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.setdefault(label, Counter()).update(made(find(t)))
                if sum(map(len, held.values())) > HELD:
                    yield from counts(held)
                    held = {}
        yield from counts(held)

    found = rows.mapInArrow(run, f"label {rows.schema['label'].dataType.simpleString()}, raw string, n long")
    return found.groupBy("raw", "label").agg(F.sum("n").alias("n"))


def gathered(tokens: DataFrame, most: int) -> DataFrame:
    """label, raw, n and often: tokens (label, token) added up in their tasks, GATHERED at a time; those that are among the
    ``most`` most frequent of their label there are marked."""

    def summed(held):
        t = pa.Table.from_batches(held).group_by(["label", "raw"], use_threads=False).aggregate([("n", "sum")])
        return t.rename_columns(["n" if c == "n_sum" else c for c in t.column_names]).select(["label", "raw", "n"])

    def marked(t):
        n, (_, nth) = t.column("n").to_numpy(), np.unique(t.column("label").fill_null("").to_numpy(), return_inverse=True)
        often = np.zeros(len(n), bool)
        for x in range(nth.max(initial=-1) + 1):
            own = np.flatnonzero(nth == x)
            often[own] = n[own] >= (np.partition(n[own], len(own) - most)[len(own) - most] if len(own) > most else 0)
        yield from t.append_column("often", pa.array(often)).to_batches(max_chunksize=50_000)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, np.int64))], names=["label", "raw", "n"]))
            rows += b.num_rows
            if rows >= GATHERED:
                t = summed(held)
                held, rows = t.to_batches(), t.num_rows
                if rows > GATHERED // 2:
                    yield from marked(t)
                    held, rows = [], 0
        if held:
            yield from marked(summed(held))

    return tokens.select(F.col("label").cast("string").alias("label"), "token").mapInArrow(run, "label string, raw string, n long, often boolean")


def keyword_counts(reviews: DataFrame, n: int = TOP_KEYWORDS, text: str = "text", label: str = "sentiment_label", tokenizer=None) -> DataFrame:
    """The top phrases of one to three words by bucket (all, and each label), with the bucket's reviews. ``tokenizer``: a table
    function that gives a text's phrases instead; they are trimmed and filtered
    alike, and only cells of a sketch that can hold one at the top are shuffled by phrase.

    Words are counted first. Their n-th count in a bucket bounds what can be at its top from below, so pairs are counted only
    where that is possible: a phrase stands at most twice as often as its words (without a determiner and after one), so both
    are half as frequent, or, after a determiner (which a phrase loses), the word that is left. Three words likewise: both
    pairs in them are as frequent, or the pair that is left half as frequent. Nothing at the top is lost."""
    both = F.explode(F.array(F.lit("all"), F.col("label"))).alias("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc("count"), "word")
    size = reviews.select(F.explode(F.array(F.lit("all"), F.col(label))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_reviews"))

    def phrases(counts: DataFrame) -> DataFrame:
        by = counts.select("n", "label", X.phrase("raw").alias("word")).where("word IS NOT NULL").groupBy("word", "label").agg(F.sum("n").alias("n"))
        return by.select("word", "n", both).groupBy("bucket", "word").agg(F.sum("n").alias("count"))

    def ranked(counts: DataFrame) -> DataFrame:
        top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        return top.join(size, "bucket").select("bucket", "word", "count", "n_reviews", F.col("rank").cast("long").alias("rank"))

    def least_of(counts: DataFrame) -> DataFrame:
        """The n-th count of each bucket, 0 where there are fewer."""
        last = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        return stored(last.groupBy(F.col("bucket").alias("k")).agg(F.when(F.count("*") == n, F.min("count")).otherwise(0).alias("least")))

    if tokenizer is not None:
        tokens = tokenised(spread(reviews.select(F.col(label).alias("label"), text)), tokenizer, text, "label")
        parts = gathered(tokens, 8 * n).select("label", "n", "often", X.phrase("raw").alias("word")).where("word IS NOT NULL")
        parts = stored(parts.withColumn("cell", F.pmod(F.xxhash64("word"), F.lit(CELLS))))
        by = lambda rows, key: rows.groupBy(key, "label").agg(F.sum("n").alias("n")).select(key, "n", both).groupBy("bucket", key).agg(F.sum("n").alias("count"))
        # the n-th count of the phrases that are frequent in some task bounds the n-th of all from below; a phrase at the top
        # stands in a cell that has as much
        last = least_of(by(parts.join(parts.where("often").select("word").distinct(), "word", "left_semi"), "word"))
        cells = by(parts, "cell").join(last, F.col("bucket") == F.col("k"), "left").where("bucket IS NOT NULL AND count >= coalesce(least, 0)").select("cell").distinct()
        return ranked(by(parts.join(F.broadcast(cells), "cell", "left_semi"), "word"))
    rows = spread(reviews.select(F.col(label).alias("label"), F.lower(F.col(text)).alias("text")).where("text IS NOT NULL"))

    def often(raw: DataFrame, last: DataFrame, strong: str) -> dict[str, bool] | None:
        """Runs that are half as frequent as a bucket's n-th phrase, and whether ``strong`` holds too; None of more than TOLD."""
        by = raw.select("raw", "n", both).groupBy("raw", "bucket").agg(F.sum("n").alias("n")).join(last, F.col("bucket") == F.col("k")).where("2 * n >= least")
        found = by.groupBy("raw").agg(F.max(F.expr(strong)).alias("strong")).limit(TOLD + 1).collect()
        return {r.raw: r.strong for r in found} if len(found) <= TOLD else None

    single = stored(runs(rows, 1))
    pairs = stored(runs(rows, 2, often(single, least_of(phrases(single)), "true")))
    short = stored(phrases(single.union(pairs)))
    last = least_of(short)
    long = phrases(runs(rows, 3, often(pairs, last, "n >= least")))
    able = short.join(last, F.col("bucket") == F.col("k")).where("2 * count >= least").select("bucket", "word", "count")
    return ranked(able.union(long).groupBy("bucket", "word").agg(F.sum("count").alias("count")))


def keyword_basis(reviews: DataFrame, id_column: str, limit: int = 25_000, seed: str = "42") -> tuple[DataFrame, str]:
    """All rows up to ``limit``, else a fixed-seed sample of about so many; and which of the two it is."""
    from .sampling import unit

    n = reviews.count()
    return (reviews, "full") if n <= limit else (reviews.where(unit(id_column, seed) < limit / n), "sample")


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame, id_column: str, text: str = "text", band: float = 0.05) -> DataFrame:
    """doc, compound, label, confidence: word scores summed, s / sqrt(s^2 + 15), banded. ``lexicon``: word, valence.

    Words are counted by document before they meet the lexicon. Documents without a known word are neutral."""
    w = F.explode_outer(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z']+"), F.lit(0))).alias("word")
    words = spread(docs.select(id_column, text)).select(F.col(id_column).alias("doc"), w).groupBy("doc", "word").agg(F.count("*").alias("n"))
    s = words.join(lexicon, "word", "left").groupBy("doc").agg(F.coalesce(F.sum(F.col("n") * F.col("valence")), F.lit(0.0)).alias("s"))
    c = F.round(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15.0), 6)
    return s.select("doc", c.alias("compound")).withColumn("label", X.banded("compound", band)).withColumn("confidence", F.abs("compound"))


def stop_word_language(docs: DataFrame, stop_words: DataFrame, id_column: str, text: str = "text", least_words: int = 4) -> DataFrame:
    """doc, language, kept_as_english: the language with most stop-word hits. Short texts and those without a hit are kept.

    ``stop_words``: word, language."""
    tokens = spread(docs.select(id_column, text)).select(F.col(id_column).alias("doc"), F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w+"), F.lit(0)).alias("ws"))
    hits = tokens.select("doc", F.explode("ws").alias("word")).join(stop_words, "word").groupBy("doc", "language").agg(F.count("*").alias("n"))
    best = hits.groupBy("doc").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))
    out = tokens.select("doc", F.size("ws").alias("n_words")).join(best, "doc", "left")
    return out.select("doc", "language", ((F.col("n_words") < least_words) | F.col("language").isNull() | (F.col("language") == "en")).alias("kept_as_english"))
