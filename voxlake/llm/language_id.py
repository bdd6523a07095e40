"""Language identification with a linear-chain conditional random field over the words of a text.

A word's features are its byte n-grams of 2 to 4 bytes within blanks (those at a blank are its affixes) and its lexicon
language, if the sample has it often and nearly always in one language. Forward-backward gives each word the probability
of each language given the whole text, so that code-switched texts are labelled word by word; a text's language is the one
with the largest mean probability over its words with a letter, and that mean is the score.

Training: ``docs_per_language`` labelled documents for each language (fewer where ``docs`` are too few for all languages),
chosen by a hash of the id. A text of over ``chars_per_doc`` characters gives ``pieces`` runs of whole words, from places
evenly over the whole text, with as many characters together. Nothing else of the corpus is used to fit. Sequences of several languages are made
from runs of these words, so that the transitions are learned. Prediction reads every text whole.

Results for odd rows: a null text, an empty one or one without a letter gets ``und`` and score 0, as does every text when
there is no labelled row; ties fall to the first language by name; repeated rows get a row each; an empty table gives no
row. Only ``doc_id``, ``text`` and (to fit) ``lang`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, table

GRAMS, REGION, CHUNK = (2, 3, 4), 1 << 16, 64


@dataclass(frozen=True)
class Fit:
    docs_per_language: int = 160
    docs: int = 20_000
    chars_per_doc: int = 1500
    pieces: int = 6
    steps: int = 40
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 11


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram regions, then one row for each lexicon language
    moves: np.ndarray
    start: np.ndarray
    lexicon: dict[bytes, int]

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the words one after another, and where each word's begin."""
        buf = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(len(buf))
        cols = []
        for k, n in enumerate(GRAMS):
            h = np.zeros(len(buf), np.int64)
            for j in range(n):
                h[: len(buf) - j] = h[: len(buf) - j] * 257 + buf[j:]
            h = (h if n == 2 else h * 2654435761 >> 7) % REGION + k * REGION
            cols.append(np.where(left >= n, h, len(self.weights)))
        lex = np.full(len(buf), len(self.weights))
        lex[end - size] = [self.lexicon.get(w, -1) for w in words]
        lex = np.where(lex == -1, len(self.weights), np.where(lex < len(self.weights), lex + len(GRAMS) * REGION, lex))
        return np.stack([*cols, lex], 1).ravel(), (end - size) * (len(GRAMS) + 1)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        index, at = self.features(words)
        table_ = np.concatenate([self.weights, np.zeros((1, self.weights.shape[1]), self.weights.dtype)])
        return np.add.reduceat(table_[index], at, axis=0)


def marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probability of each label of each word; ``first`` marks where a text begins.

    Texts stand in one chain with a jump at each beginning. The chain is cut into runs of CHUNK words whose matrix products
    are made for all runs at once, so that one very long text costs no more a word than short ones."""
    words, labels = e.shape
    runs = -(-words // CHUNK)
    pot = np.ones((runs * CHUNK, labels))
    pot[:words] = np.exp(e - e.max(1, keepdims=True))
    new = np.ones(runs * CHUNK, bool)
    new[:words] = first
    pot, new = pot.reshape(runs, CHUNK, labels), new.reshape(runs, CHUNK)
    a, s = np.exp(moves - moves.max()), np.exp(start - start.max())
    prod = np.broadcast_to(np.eye(labels), (runs, labels, labels)).copy()
    for t in range(CHUNK):
        step = prod @ a
        f = new[:, t]
        step[f] = prod[f].sum(2, keepdims=True) * s
        prod = step * pot[:, t, None, :]
        prod /= prod.max((1, 2), keepdims=True)
    into, out = np.ones((runs, labels)), np.ones((runs, labels))
    for c in range(1, runs):
        v = into[c - 1] @ prod[c - 1]
        into[c] = v / v.sum()
    for c in range(runs - 2, -1, -1):
        v = prod[c + 1] @ out[c + 1]
        out[c] = v / v.sum()
    post = np.empty_like(pot)
    for t in range(CHUNK):
        v, f = into @ a, new[:, t]
        v[f] = into[f].sum(1, keepdims=True) * s
        into = v * pot[:, t]
        into /= into.sum(1, keepdims=True)
        post[:, t] = into
    for t in range(CHUNK - 1, -1, -1):
        post[:, t] *= out
        v, f = pot[:, t] * out, new[:, t]
        out = v @ a.T
        out[f] = (v[f] @ s)[:, None]
        out /= out.sum(1, keepdims=True)
    post = post.reshape(-1, labels)[:words]
    return post / post.sum(1, keepdims=True)


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def fit(rows: list[tuple[str, str]], p: Fit = Fit()) -> Model | None:
    """A model from (lang, text) rows, by Adam on the log-likelihood of sequences made from the rows' words."""
    langs = sorted({lang for lang, _ in rows})
    texts = [(langs.index(lang), w) for lang, t in sorted(rows) if (w := tokens(t))]
    if not texts:
        return None
    counts: dict[bytes, np.ndarray] = {}
    for lang, words in texts:
        for w in words:
            counts.setdefault(w, np.zeros(len(langs)))[lang] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()}
    rng = np.random.default_rng(p.seed)
    model = Model(langs, np.zeros((len(GRAMS) * REGION + len(langs), len(langs))), np.zeros((len(langs),) * 2), np.zeros(len(langs)), lexicon)
    runs = []  # of words of one language
    for lang, words in texts:
        at = 0
        while at < len(words):
            n = int(rng.integers(3, 40))
            runs.append((lang, words[at : at + n]))
            at += n
    seq, first, gold = [], [], []
    for k, r in enumerate(rng.permutation(len(runs))):
        lang, words = runs[r]
        first += [k % 3 == 0, *[False] * (len(words) - 1)]
        seq += words
        gold += [lang] * len(words)
    first[0] = True
    number = {w: i for i, w in enumerate(dict.fromkeys(seq))}
    index, at = model.features(list(number))
    real = index < len(model.weights)
    owner = np.repeat(np.arange(len(number)), np.diff(np.append(at, len(index))))[real]
    index = index[real]
    seen = np.fromiter(map(number.__getitem__, seq), np.int64, len(seq))
    first, gold = np.array(first), np.array(gold)
    n, labels = len(seq), len(langs)
    went = ~first[1:]
    want = np.zeros((n, labels))
    want[np.arange(n), gold] = 1
    want_moves = np.zeros((labels, labels))
    np.add.at(want_moves, (gold[:-1][went], gold[1:][went]), 1)
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (model.weights, model.moves, model.start)]
    for step in range(1, p.steps + 1):
        e = model.emissions(list(number))[seen]
        post = marginals(e, first, model.moves, model.start)
        pot, a = np.exp(e - e.max(1, keepdims=True)), np.exp(model.moves - model.moves.max())
        # the pair probabilities follow from the marginals of a chain up to scale: p(i, j) ~ f_i a_ij b_j
        ahead = forward(pot, first, a, np.exp(model.start - model.start.max()))
        back = np.where(ahead[1:] > 0, post[1:] / np.maximum((ahead[:-1] @ a) * 1.0, 1e-300), 0)
        pair = ahead[:-1, :, None] * a[None] * back[:, None, :]
        pair = (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300))[went].sum(0)
        g = np.stack([np.bincount(seen, (post - want)[:, k], len(number)) for k in range(labels)], 1)
        gw = np.stack([np.bincount(index, g[owner, k], len(model.weights)) for k in range(labels)], 1)
        grads = (gw / n * 50 + p.decay * model.weights, (pair - want_moves) / n + p.decay * model.moves, (post - want)[first].sum(0) / n + p.decay * model.start)
        for (x, m, v), gr in zip(state, grads, strict=True):
            m *= 0.9
            m += 0.1 * gr
            v *= 0.99
            v += 0.01 * gr * gr
            x -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model.weights = model.weights.astype(np.float32)
    return model


def forward(pot: np.ndarray, first: np.ndarray, a: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Scaled forward values, text by text side by side."""
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(pot)))
    out = np.empty_like(pot)
    live, v = np.arange(len(at)), None
    for t in range(size.max()):
        keep = size[live] > t
        live = live[keep]
        v = (s if t == 0 else v[keep] @ a) * pot[at[live] + t]
        v = v / v.sum(1, keepdims=True)
        out[at[live] + t] = v
    return out


def label_words(model: Model, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Word probabilities of several texts, where each begins, the distinct words and each word's number in them."""
    words = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    seen = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(size) - size
    first = np.zeros(len(words), bool)
    first[at[size > 0]] = True
    distinct = list(number)
    return marginals(model.emissions(distinct)[seen], first, model.moves, model.start), at, distinct, seen


_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))


def _predicted(model: Model | None, batch) -> pa.RecordBatch:
    texts = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(1).to_pylist()]
    lang, score, switches = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    some = [k for k, t in enumerate(texts) if t] if model else []
    some = [(k, w) for k in some if (w := tokens(texts[k]))]
    if some:
        post, at, distinct, seen = label_words(model, [w for _, w in some])
        alpha = np.fromiter((bool(w.translate(None, _LETTERS)) for w in distinct), bool, len(distinct))[seen].astype(float)
        mass = np.add.reduceat(post * alpha[:, None], at, axis=0)
        whole = np.add.reduceat(post, at, axis=0)
        mass = np.where(mass.sum(1, keepdims=True) > 0, mass, whole)
        best = post.argmax(1)
        moved = np.append(best[1:] != best[:-1], False)
        for n, (k, _) in enumerate(some):
            to = at[n + 1] if n + 1 < len(at) else len(post)
            j = int(mass[n].argmax())
            lang[k], score[k], switches[k] = model.languages[j], float(min(1.0, mass[n, j] / mass[n].sum())), int(moved[at[n] : to - 1].sum())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(switches, pa.int64())], names=["doc_id", "lang_pred", "score", "n_switches"])


def spread(text: Column, p: Fit = Fit()) -> Column:
    """The text, or runs of words from places evenly over all of it where it is longer than ``p.chars_per_doc``."""
    size = p.chars_per_doc // p.pieces
    at = lambda k: (F.lit(k / max(1, p.pieces - 1)) * (F.length(text) - size)).cast("int") + 1
    cut = [F.regexp_replace(F.substring(text, at(k), F.lit(size)), r"^\S*\s+|\s+\S*$", "") for k in range(p.pieces)]
    return F.when(F.length(text) <= p.chars_per_doc, text).otherwise(F.concat_ws(" ", *cut))


def sample(docs: DataFrame, p: Fit = Fit()) -> list[tuple[str, str]]:
    """The labelled rows to fit on: their number is bounded by ``p`` for each language and in all, repeated ids included."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    languages = labelled.select("lang").distinct().count()
    most = max(1, min(p.docs_per_language, p.docs // max(1, languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    ids = stored(ids.select(F.col("doc_id").alias("chosen")).distinct())
    got = labelled.join(ids, F.col("doc_id") == F.col("chosen")).select("doc_id", "lang", spread(F.col("text"), p).alias("text"))
    again = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return [tuple(r) for r in got.withColumn("nth", F.row_number().over(again)).where(F.col("nth") <= most).select("lang", "text").collect()]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and n_switches (changes of the likeliest language between words) for each row."""
    schema = "doc_id long, lang_pred string, score double, n_switches long"
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: (_predicted(model, b) for b in slices(it, 512)), schema)


def accepted(docs: DataFrame, model: Model | None, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text gets a language with at least this score.

    The score is a mean over words, so a clean text in two languages by halves has about 0.5 and has to stay; below 0.4 no
    language has the better part of two fifths of the words."""
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches, 512):
            found = _predicted(model, pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(at)], names=["doc_id", "text"]))
            lang, score = found.column("lang_pred").to_pylist(), found.column("score").to_pylist()
            yield b.filter(pa.array([x != "und" and s >= least_score for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs.where(~held_out())))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switches")
