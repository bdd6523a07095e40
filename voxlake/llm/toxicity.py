"""Toxicity by gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features of a text: densities, counts and weights of a lexicon (words, and beginnings of words for languages that join
them), the densest stretch of WINDOW words, lexicon words within NEAR words of a second person, the same lexicon found again
after letters were put back for signs (``1d10t``, ``s.t.u.p.i.d``), capitals, punctuation, runs of signs, stretched letters.

The lexicon is a few plain insults and what is learned: of the labelled texts chosen to fit, a part (by a hash of the id) gives, for each word and each
beginning of 4 to 8 letters, in how many toxic and other texts it occurs. Entries have a log odds whose lower bound is
above ``Fit.least_weight``. Another part trains the trees (Spark ML), a third the isotonic calibration, so that no text
judges an entry or a tree that it made. At most about ``Fit.docs`` labelled texts are read to fit (by hash, whole texts);
every text is scored whole.

Results for odd rows: null and empty texts have all features 0 and get the score of such a text; rows without a doc_id are
scored, and not learned from; repeated rows get a row each; repeated labels of a document count each; labels other than 0
and 1 are not learned from; without a label of each kind every score is the share of toxic ones, or 0; an empty table gives
no row. Very long texts are read in pieces. Columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, table

WINDOW, NEAR, PIECE, HEAD = 50, 5, 1 << 18, (4, 5, 6, 7, 8)
_TOKEN = re.compile(r"[^\W_]+(?:['’*@$!.\-_0-9]+[^\W_]+)*|[!?]+|[^\w\s]")
_SIGNS = re.compile(r"[*@$!.\-_'’]")
_STRETCH = re.compile(r"(.)\1{2,}")
#: Letters behind signs and digits, and words of the second person in four languages.
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros vuestro os".split())
FEATURES = (
    "hits", "hits_per_word", "distinct_hits", "weight", "weight_per_word", "densest_stretch", "strongest", "near_you", "near_you_per_hit", "you_per_word", "masked_hits", "masked_words",
    "capital_share", "shouted_words", "exclamations", "questions", "sign_runs", "stretched_words", "log_words", "letters_per_word",
)
#: Plain insults in four languages, in the lexicon with weight 1 where labels don't say otherwise.
INSULTS = tuple("asshole bastard bitch clown disgusting dumb filthy garbage idiot idiotic imbecile jerk loser moron pathetic scum stupid trash vermin worthless abschaum arschloch blöd dreckig dumm idiotin trottel versager widerlich connard crétin dégoûtant imbécile minable ordure pourriture salaud asqueroso basura cabrón estúpido imbécil inútil patético".split())


@dataclass(frozen=True)
class Fit:
    docs: int = 30_000
    entries: int = 5_000
    least_docs: int = 5
    least_weight: float = 1.0
    parts: tuple[int, int, int] = (50, 35, 15)
    trees: int = 24
    depth: int = 3
    seed: int = 7


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: object | None
    steps: object | None
    share: float


def plain(word: str) -> str:
    """A word without signs, with letters for digits and no letter more than twice in a row."""
    return _STRETCH.sub(r"\1\1", _SIGNS.sub("", word.translate(UNMASK)))


def parts_of(text: str):
    """The runs of a text without white space, in lists of those of about PIECE characters."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def candidates(text: str) -> set[str]:
    """The words of a text and, with a mark, their beginnings."""
    found: set[str] = set()
    for runs in parts_of(text):
        for w in {t.lower() for r in set(runs) for t in _TOKEN.findall(r) if t[0].isalnum()}:
            found.add(w)
            found.update(w[:n] + "~" for n in HEAD if n <= len(w))
    return found


class Tokens(dict):
    """Numbers of runs without white space. What is known of a run's tokens by themselves are ``rows``, made when it is first
    seen: those of run n begin at ``begin[n]`` and end at ``begin[n + 1]``."""

    COLUMNS = ("word", "weight", "masked_hits", "you_per_word", "masked_words", "stretched_words", "capital_share", "letters", "shouted_words", "exclamations", "questions", "sign_runs", "entry")

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.entries, self.n_rows = lexicon, {}, 0
        self.starts = {e[: HEAD[0]] for e in lexicon if e.endswith("~")}
        self.rows, self.begin = np.zeros((1 << 12, len(self.COLUMNS))), np.zeros(1 << 12, np.int64)

    def weight(self, word: str) -> float:
        own = self.lexicon.get(word, 0.0)
        if word[: HEAD[0]] in self.starts:
            own = max([own, *(self.lexicon.get(word[:n] + "~", 0.0) for n in HEAD if n <= len(word))])
        return own

    def row(self, token: str) -> tuple:
        if not token[0].isalnum():
            return (0,) * 9 + ("!" in token, "?" in token, len(token) > 1, -1)
        low = token.lower()
        own, masked, covered, stretched = self.weight(low), False, False, bool(_STRETCH.search(low))
        if stretched or not low.isalpha():
            bare = plain(low)
            covered = bare != low and any(map(str.isalpha, low))
            if bare != low and own == 0 and (w := self.weight(bare)) > 0:
                own, masked = w, True
            elif own == 0:  # words that only a sign joins
                own = max(map(self.weight, _SIGNS.split(low)))
        entry = self.entries.setdefault(low[:6], len(self.entries)) if own > 0 else -1
        capitals = sum(map(str.isupper, token)) if low != token else 0
        return (1, own, masked, low in YOU, covered, stretched and low.isalpha(), capitals, len(token), len(token) > 2 and token.isupper(), 0, 0, 0, entry)

    def __missing__(self, run: str) -> int:
        new = [self.row(t) for t in ([run] if run.isalpha() else _TOKEN.findall(run))]
        n, end = len(self), self.n_rows + len(new)
        if end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(end, len(self.rows)), len(self.COLUMNS)))])
        if n + 2 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        if new:
            self.rows[self.n_rows : end] = new
        self.begin[n + 1], self.n_rows, self[run] = end, end, n
        return n

    def of(self, runs: list[str]) -> np.ndarray:
        """The rows of all tokens of some runs, in order."""
        found = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        size = self.begin[found + 1] - self.begin[found]
        return self.rows[np.repeat(self.begin[found] - np.cumsum(size) + size, size) + np.arange(size.sum())]


class Scorer:
    """Features of texts. What is known of tokens is kept from text to text, up to MOST_TOKENS of them."""

    MOST_TOKENS = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.tokens = lexicon, Tokens(lexicon)

    def features(self, text: str | None) -> np.ndarray:
        names = Tokens.COLUMNS
        total, out, words, distinct = np.zeros(len(names)), dict.fromkeys(FEATURES, 0.0), 0, set()
        tail, last_you, waiting = np.zeros(0), -NEAR - 1, np.zeros(0, np.int64)
        for runs in parts_of(text or ""):
            if len(self.tokens) > self.MOST_TOKENS:
                distinct = {("part", words, d) for d in distinct}  # entries are numbered anew: those of parts before stay apart
                self.tokens = Tokens(self.lexicon)
            rows = self.tokens.of(runs)
            total += rows.sum(0)
            rows = rows[rows[:, 0] > 0]
            own, you = rows[:, 1], rows[:, 3] > 0
            hit = own > 0
            place = np.arange(words, words + len(rows))
            yous = np.append(last_you, place[you])
            if hit.any():
                out["hits"] += hit.sum()
                out["strongest"] = max(out["strongest"], own.max())
                distinct.update(np.unique(rows[hit, -1]).tolist())
                at = place[hit]
                before = yous[np.searchsorted(yous, at, "right") - 1]
                after = np.append(yous, 1 << 60)[np.searchsorted(yous, at)]
                close = (at - before <= NEAR) | (after - at <= NEAR)
                out["near_you"] += close.sum()
            if you.any():  # hits of the part before, close to this part's first
                out["near_you"] += (place[you][0] - waiting <= NEAR).sum()
            waiting = at[~close] if hit.any() else waiting[:0] if you.any() else waiting
            last_you = int(yous[-1])
            run = np.concatenate([tail, own])
            if hit.any():
                sums = np.cumsum(run)
                sums[WINDOW:] -= sums[:-WINDOW].copy()
                out["densest_stretch"] = max(out["densest_stretch"], sums.max())
            tail = run[-WINDOW + 1 :]
            words += len(rows)
        out |= {name: total[k] for k, name in enumerate(names) if name in out and name != "word"}
        n, letters = max(1, words), total[names.index("letters")]
        out["near_you_per_hit"] = out["near_you"] / max(1.0, out["hits"])
        out["hits_per_word"], out["weight_per_word"] = out["hits"] / n, out["weight"] / n
        for c in ("you_per_word", "shouted_words", "exclamations", "questions", "sign_runs", "masked_words", "stretched_words"):
            out[c] /= n
        out["capital_share"] /= max(1, letters)
        out["distinct_hits"], out["letters_per_word"], out["log_words"] = float(len(distinct)), letters / n, float(np.log1p(words))
        return np.array([out[c] for c in FEATURES], float)


_KEPT: dict[int, Scorer] = {}


def kept_scorer(lexicon: dict[str, float]) -> Scorer:
    """The scorer of a worker: what it knows of tokens serves its later tasks with the same lexicon."""
    key = hash(tuple(sorted(lexicon.items())))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Scorer(lexicon)
    return _KEPT[key]


def features(docs: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """The kept columns (of any types) and ``features``, an array of doubles, for each row."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches):
        scorer = kept_scorer(lexicon)
        for b in slices(batches):
            x = [scorer.features(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=[*keep, "features"])

    return in_arrow(rows, run, ", ".join([*(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes), "features array<double>"]))


def _counted(batches):
    """entry, toxic and all: in how many texts, folded as far as memory allows."""
    all_, toxic = Counter(), Counter()

    def put():
        names = list(all_)
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([all_[n] for n in names], pa.int64())], names=["entry", "toxic", "n"])
        all_.clear()
        toxic.clear()
        return out

    for b in slices(batches):
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = candidates(text or "")
            all_.update(found)
            if label:
                toxic.update(found)
            if len(all_) > 400_000:
                yield put()
    yield put()


def learned_lexicon(rows: DataFrame, p: Fit = Fit()) -> dict[str, float]:
    """The plain insults, and the strongest entries of labelled texts (text, label): at most ``p.entries``."""
    base = dict.fromkeys(INSULTS, 1.0)
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return base
    counts = in_arrow(rows.select("text", "label"), _counted, "entry string, toxic long, n long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("n") >= p.least_docs)
    other = F.col("n") - F.col("toxic")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((other + 0.5) / (n - n_toxic + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (other + 0.5))
    best = counts.withColumn("weight", odds - 1.64 * spread).where(F.col("weight") >= p.least_weight)
    return base | {r.entry: float(r.weight) for r in best.orderBy(F.desc("weight"), "entry").limit(p.entries).collect()}


def chosen(docs: DataFrame, labels: DataFrame, p: Fit = Fit()) -> DataFrame:
    """text, label and part (0 lexicon, 1 trees, 2 calibration) of about ``p.docs`` labelled texts at most, by hash of the id."""
    told = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    at = F.pmod(F.xxhash64("_id", F.lit(p.seed)), F.lit(1 << 20))
    n = told.count()
    told = told.where(at < int((1 << 20) * min(1.0, p.docs / max(1, n))))
    draw = F.pmod(F.xxhash64("_id", F.lit(p.seed + 1)), F.lit(sum(p.parts)))
    part = F.when(draw < p.parts[0], 0).when(draw < p.parts[0] + p.parts[1], 1).otherwise(2)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return texts.join(told, "_id").select("text", "label", part.alias("part"))


def fit(docs: DataFrame, labels: DataFrame, p: Fit = Fit()) -> Model:
    rows = stored(chosen(docs, labels, p))
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = n_toxic / n if n else 0.0
    lexicon = learned_lexicon(rows.where("part = 0"), p)
    dense = stored(features(rows.where("part > 0"), lexicon, "label", "part").select(F.col("label").cast("double").alias("label"), "part", array_to_vector("features").alias("x")).coalesce(8))
    kinds = {(r.part, r.label) for r in dense.select("part", "label").distinct().collect()}
    if not {(1, 0.0), (1, 1.0)} <= kinds:
        return Model(lexicon, None, None, share)
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=p.trees, maxDepth=p.depth, stepSize=0.3, minInstancesPerNode=5, seed=p.seed).fit(dense.where("part = 1"))
    steps = None
    if {(2, 0.0), (2, 1.0)} <= kinds:
        held = trees.transform(dense.where("part = 2")).select("label", vector_to_array("probability")[1].alias("raw"))
        steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    return Model(lexicon, trees, steps, share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row: the calibrated probability, the trees' own order kept inside its steps."""
    if model.trees is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(model.share)).alias("score"))
    rows = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.lexicon, "doc_id").select("doc_id", array_to_vector("features").alias("x"))
    raw = model.trees.transform(rows).select("doc_id", vector_to_array("probability")[1].alias("raw"))
    if model.steps is None:
        return raw.select("doc_id", F.col("raw").alias("score"))
    return model.steps.transform(raw).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction") * 0.98 + F.col("raw") * 0.02)).alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
