"""Classical sentiment models on Spark ML."""

from __future__ import annotations

import math
from collections import Counter
from multiprocessing.pool import ThreadPool
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LABELS
from ..sources.scratch import stored
from .evaluation import overall
from .features import HELD, rows_of, terms

C_GRID, ALPHA_GRID = (0.01, 0.1, 1.0, 5.0, 10.0), (0.01, 0.05, 0.1, 0.5, 1.0)


def encode(label: str) -> Column:
    """negative 0, neutral 1, positive 2; anything else null."""
    return F.array_position(F.array(*map(F.lit, LABELS)), F.col(label)).cast("double") - 1


def decode(index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), (F.col(index) + 1).cast("int"))


def prepared(reviews: DataFrame, text: str = "text", label: str = "sentiment_label") -> DataFrame:
    return reviews.withColumn("label", encode(label)).where("label >= 0").withColumn("terms", terms(text))


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln of each count of a vector column. The values of a whole Arrow batch are one array, so nothing runs by row."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn(self.getOutputCol(), F.col(self.getInputCol()))
        at = out.columns.index(self.getOutputCol())

        def run(batches):
            for b in batches:
                kind, size, indices, values = b.column(at).flatten()
                offsets, flat = values.offsets, np.asarray(values.values, dtype=float)
                log = pa.ListArray.from_arrays(offsets, pa.array(1 + np.log(np.maximum(flat, 1e-300))))
                column = pa.StructArray.from_arrays([kind, size, indices, log], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

        return out.mapInArrow(run, out.schema)


#: Cells of the sketch of terms, parts that it is summed in, and terms that a task keeps when it lets rare ones go.
CELLS, CELL_PARTS, KEPT = 1 << 22, 64, 100_000


def cells_of(found: list[str], cells: int) -> np.ndarray:
    return np.fromiter((crc32(t.encode()) for t in found), np.int64, len(found)) % cells


def counted(batches, full, held: int):
    """Total and df of the terms of texts; ``full`` gets both whenever there are more than ``held`` terms, and at the end."""
    total, df = Counter(), Counter()
    for _, texts in rows_of(batches):
        for w in texts:
            total.update(w)
            df.update(set(w))
        if len(total) > held:
            yield from full(total, df, False)
    yield from full(total, df, True)


def terms_in_reach(words: DataFrame, size: int, min_df: int) -> np.ndarray:
    """Which cells of a sketch of all terms can hold one of the ``size`` most frequent terms that ``min_df`` rows have, as bits.

    A task adds up all its terms by cell, and hands on the counts of its most frequent ones. The ``size``-th of these, added
    up, bounds the last total from below; a term that reaches it stands in a cell that does."""
    schema = "term string, total long, df long, part int, cells binary"

    def run(batches):
        cells, seen = np.zeros(CELLS, np.int64), {}

        def full(total, df, last):
            t = list(total)
            n = np.fromiter(total.values(), np.int64, len(t))
            # what was kept is in its cell already
            np.add.at(cells, cells_of(t, len(cells)), n - np.fromiter((seen.get(x, 0) for x in t), np.int64, len(t)))
            often = np.argpartition(n, len(n) - KEPT)[len(n) - KEPT :] if len(n) > KEPT else range(len(n))
            top = [(t[x], int(n[x])) for x in often]
            keep = {x: df[x] for x, _ in top}
            total.clear()
            df.clear()
            total.update(dict(top))
            df.update(keep)
            seen.clear()
            seen.update(total)
            if last:
                for at in range(0, len(top), 50_000):
                    part = top[at : at + 50_000]
                    columns = [pa.array([x for x, _ in part], pa.string()), pa.array([y for _, y in part], pa.int64()), pa.array([keep[x] for x, _ in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], names=["term", "total", "df", "part", "cells"])
                for k, part in enumerate(np.split(cells, CELL_PARTS)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["term", "total", "df", "part", "cells"])

        yield from counted(batches, full, HELD // 2)

    sketch = stored(words.mapInArrow(run, schema))
    tops = sketch.where("term IS NOT NULL").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    n, least = tops.orderBy(F.desc("total")).limit(size).agg(F.count("*"), F.min("total")).first()
    least = least if n == size else 0

    def reach(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("cells"))
        return pa.table([table.column("part").slice(0, 1), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["part", "bits"])

    found = sketch.where("part IS NOT NULL").groupBy("part").applyInArrow(reach, "part int, bits binary").collect()
    return np.unpackbits(np.frombuffer(b"".join(bytes(r.bits) for r in sorted(found)), np.uint8)).astype(bool)


def features(train: DataFrame, size: int = 50_000, min_df: int = 2) -> PipelineModel:
    """terms to ``features``: ``1 + ln tf`` times ``ln((1 + n) / (1 + df)) + 1``, rows of unit length. The vocabulary is the
    ``size`` most frequent terms of ``train`` that ``min_df`` of its rows have, ties by term; it passes through the driver.

    Terms are counted twice: first in a sketch, then those alone that can be in the vocabulary, so that the many rare ones
    are in no shuffle."""
    words = gathered(train.select(F.lit(0).alias("key"), F.array_join("terms", "\n").alias("words")))
    bits = np.packbits(terms_in_reach(words, size, min_df)).tobytes()

    def run(batches):
        able = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)

        def full(total, df, last):
            t = np.array(list(total), object)[able[cells_of(list(total), len(able))]] if total else []
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array([total[x] for x in t], pa.int64()), pa.array([df[x] for x in t], pa.int64())], names=["term", "total", "df"])
            total.clear()
            df.clear()

        yield from counted(batches, full, HELD // 2)

    parts = words.mapInArrow(run, "term string, total long, df long")
    counts = parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_df)
    vocab = [(r.term, r.df) for r in counts.orderBy(F.desc("total"), "term").limit(size).collect()] or [("", 0)]
    n = train.count()
    idf = [math.log((1.0 + n) / (1.0 + df)) + 1.0 for _, df in vocab]
    return PipelineModel(
        [CountVectorizerModel.from_vocabulary([t for t, _ in vocab], inputCol="terms", outputCol="_counts"), SublinearCounts(inputCol="_counts", outputCol="_tf"),
         ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_weights"), Normalizer(p=2.0, inputCol="_weights", outputCol="features")]
    )


def featured(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` with their ``features``, without the steps between and without terms, which go after the first step."""
    out = model.stages[0].transform(rows).drop("terms")
    for step in model.stages[1:]:
        out = step.transform(out)
    return out.drop("_counts", "_tf", "_weights")


def class_means(rows: DataFrame) -> DataFrame:
    """fold, label, features (the mean of theirs) and weight (their number): all that Naive Bayes learns of rows, so that it
    is fitted on a row for each fold and label, whatever the smoothing."""
    return stored(rows.groupBy("fold", "label").agg(Summarizer.mean(F.col("features")).alias("features"), F.count("*").cast("double").alias("weight")))


def logistic_regression(c: float, n: int) -> LogisticRegression:
    return LogisticRegression(family="multinomial", regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=60)


def naive_bayes(alpha: float, weight: str | None = None) -> NaiveBayes:
    made = NaiveBayes(modelType="multinomial", smoothing=alpha)
    return made.setWeightCol(weight) if weight else made


#: Rows that fits which run at once have together: each keeps its rows in memory while it runs.
FIT_ROWS = 1_200_000


def gathered(rows: DataFrame, fits: int = 1) -> DataFrame:
    """The rows in no more partitions than there are cores for each of so many fits. Each pass of a fit sends a vector of the size
    of the vocabulary for each class and partition, so that with a partition a file what it sends would grow with the input."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism // fits))


def classifier(kind: str, value: float, n: int, weight: str | None = None):
    return logistic_regression(value, n) if kind == "lr" else naive_bayes(value, weight)


def fit(train: DataFrame, classifier_, size: int = 50_000) -> PipelineModel:
    """Features and classifier in one model that can be saved."""
    steps = features(train, size)
    return PipelineModel([*steps.stages, classifier_.fit(gathered(featured(train, steps)))])


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """pred, confidence and the score of every label, to four decimals."""
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    scores = F.map_from_arrays(F.array(*map(F.lit, LABELS)), F.transform(F.sequence(F.lit(1), F.lit(len(LABELS))), lambda i: F.round(F.coalesce(F.try_element_at("_p", i), F.lit(0.0)), 4)))
    return out.withColumn("pred", decode("prediction")).withColumn("confidence", F.round(F.array_max("_p"), 4)).withColumn("scores", scores).drop("_p", "rawPrediction", "probability", "_counts", "_tf", "_weights", "features")


class MacroF1(Evaluator):
    """Macro F1 over the labels seen."""

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(decode("label").alias("true_label"), decode("prediction").alias("pred"))
        return float(overall(rows).first()["macro_f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def judged(models: list, rest: DataFrame) -> list[float]:
    """The macro F1 of each model over the same rows, which are read once."""
    for nth, m in enumerate(models):
        rest = m.transform(rest).withColumnRenamed("prediction", f"_p{nth}").drop("rawPrediction", "probability")
    each = F.explode(F.array(*(F.struct(F.lit(nth).alias("model"), decode(f"_p{nth}").alias("pred")) for nth in range(len(models)))))
    rows = rest.select(decode("label").alias("true_label"), each.alias("x")).select("true_label", "x.model", "x.pred")
    found = {r.model: r.macro_f1 for r in overall(rows, "model").select("model", "macro_f1").collect()}
    return [float(found.get(nth) or 0.0) for nth in range(len(models))]


def tuned(rows: DataFrame, kind: str, k: int = 3, grid: tuple[float, ...] | None = None, means: DataFrame | None = None) -> tuple[float, list[tuple[float, float]]]:
    """The best grid value by mean macro F1 over the folds, and the mean of each value. ``rows``: label, features, fold.
    ``means``: their ``class_means``, which Naive Bayes then is fitted on.

    As in the evaluation that it stands for, vocabulary and idf are those of all of ``rows``. The loop is over folds and grid."""
    values = grid or (C_GRID if kind == "lr" else ALPHA_GRID)
    found: dict[float, list[float]] = {value: [] for value in values}
    models = fitted(rows, [(kind, value, f) for f in range(k) for value in values], means)
    for f in range(k):
        for value, score_ in zip(values, judged(models[f * len(values) : (f + 1) * len(values)], rows.where(F.col("fold") == f)), strict=True):
            found[value].append(score_)
    averages = [(value, sum(found[value]) / k) for value in values]
    return max(averages, key=lambda m: (round(m[1], 12), -m[0]))[0], averages


def fitted(rows: DataFrame, fits: list[tuple[str, float, int | None]], means: DataFrame | None = None) -> list:
    """The models of each kind and value, fitted on the rows that are not of the fold (on all: None). Several run at once, since
    the passes of one over few rows leave most of the cores idle."""
    seen = lambda df, fold: df if fold is None else df.where(F.col("fold") != fold)
    sizes = {fold: seen(rows, fold).count() for _, _, fold in fits}
    at_once = max(1, min(len(fits), rows.sparkSession.sparkContext.defaultParallelism, FIT_ROWS // max(1, *sizes.values())))

    def one(kind: str, value: float, fold: int | None):
        if kind == "nb" and means is not None:
            return classifier(kind, value, sizes[fold], "weight").fit(seen(means, fold).coalesce(1))
        return classifier(kind, value, sizes[fold]).fit(gathered(seen(rows, fold), at_once))

    run = inheritable_thread_target(rows.sparkSession)(lambda x: one(*x))
    with ThreadPool(at_once) as pool:
        return pool.map(run, fits, 1)


def cross_validated(rows: DataFrame, kinds: dict[str, float], k: int = 5, refit_features: bool = False, means: DataFrame | None = None) -> DataFrame:
    """model, fold and macro F1 of each kind (``lr``, ``nb``) at its value. ``rows``: label, fold and ``features`` of one
    vocabulary, or ``terms`` with ``refit_features``, where a fold's vocabulary and idf see only its own training part.
    ``means``: the ``class_means`` of ``rows``, as for ``tuned``."""
    out = []
    whole = [] if refit_features else fitted(rows, [(kind, value, f) for f in range(k) for kind, value in kinds.items()], means)
    for f in range(k):
        part, rest = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        if refit_features:
            steps = features(part)
            part, rest = stored(featured(part, steps)), stored(featured(rest, steps))
            models = fitted(part, [(kind, value, None) for kind, value in kinds.items()])
        else:
            models = whole[f * len(kinds) : (f + 1) * len(kinds)]
        out += [(kind, f, score_) for kind, score_ in zip(kinds, judged(models, rest), strict=True)]
    return rows.sparkSession.createDataFrame(out, "model string, fold int, macro_f1 double")


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.round(F.avg("macro_f1"), 6).alias("mean"), F.round(F.stddev_pop("macro_f1"), 6).alias("spread"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
