"""Model evaluation over long predictions, and retrieval metrics over ranked results."""

from __future__ import annotations

from math import comb, log2

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import LABELS



def usable(predictions: DataFrame) -> DataFrame:
    return predictions.where("pred IS NOT NULL AND pred <> 'error'")


def per_class(predictions: DataFrame, *keys: str, truth: str = "true_label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction; 0 where nothing divides."""
    cells = predictions.groupBy(*keys, truth, pred).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t")))).alias("s")
    by = cells.select(*keys, "n", (F.col(truth) == F.col(pred)).alias("hit"), sides).groupBy(*keys, F.col("s.label").alias("label"))
    by = by.agg(F.coalesce(F.sum(F.when(F.col("hit") & (F.col("s.t") == 1), F.col("n"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("s.t") == 1, F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(F.col("s.t") == 0, F.col("n"))), F.lit(0)).alias("predicted"))
    zero = lambda a, b: F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))
    by = by.withColumn("precision", zero(F.col("tp"), F.col("predicted"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    return by.withColumn("f1", zero(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def overall(predictions: DataFrame, *keys: str, truth: str = "true_label", pred: str = "pred") -> DataFrame:
    """Accuracy, macro and weighted averages, balanced accuracy (mean recall of the true classes)."""
    n, w = F.sum("support"), F.col("support")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"macro_{c}")
    weighted = lambda c: F.round(F.sum(F.col(c) * w) / n, 6).alias(f"weighted_{c}")
    by = per_class(predictions, *keys, truth=truth, pred=pred).groupBy(*keys)
    return by.agg(
        n.alias("n"), F.round(F.sum("tp") / n, 6).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"), weighted("precision"), weighted("recall"), weighted("f1"),
        F.round(F.avg(F.when(w > 0, F.col("recall"))), 6).alias("balanced_accuracy"), F.round(F.max(F.when(F.col("label") == "neutral", F.col("f1"))), 6).alias("neutral_f1"),
    )


def confusion(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """Every cell of each model's matrix, zeros too, with its share of the true class."""
    seen = predictions.groupBy("model", "true_label", "pred").agg(F.count("*").alias("n"))
    grid = predictions.select("model").distinct().withColumn("true_label", F.explode(F.array(*map(F.lit, labels)))).withColumn("pred", F.explode(F.array(*map(F.lit, labels))))
    full = grid.join(seen, ["model", "true_label", "pred"], "left").na.fill(0, ["n"])
    whole = F.sum("n").over(Window.partitionBy("model", "true_label"))
    return full.withColumn("row_pct", F.coalesce(F.round(F.try_divide(F.col("n") * 100.0, whole), 2), F.lit(0.0)))


def by_platform(predictions: DataFrame) -> DataFrame:
    return overall(predictions, "model", "platform").select("model", "platform", "n", "accuracy", "macro_f1", "neutral_f1")


def platform_spread(predictions: DataFrame) -> DataFrame:
    return by_platform(predictions).groupBy("model").agg(F.round(F.max("macro_f1") - F.min("macro_f1"), 6).alias("spread"))


def binary(predictions: DataFrame) -> DataFrame:
    """Strict and forced macro F1 without the truly neutral, and the gain."""
    rows = predictions.where("true_label <> 'neutral'").withColumn("forced", X.forced_binary("scores", "pred"))
    strict = overall(rows, "model").select("model", F.col("accuracy").alias("strict_accuracy"), F.col("macro_f1").alias("strict_macro_f1"))
    forced = overall(rows, "model", pred="forced").select("model", F.col("accuracy").alias("forced_accuracy"), F.col("macro_f1").alias("forced_macro_f1"))
    return strict.join(forced, "model").withColumn("gain", F.round(F.col("forced_macro_f1") - F.col("strict_macro_f1"), 6))


def band_sweep(predictions: DataFrame, bands: tuple[float, ...]) -> DataFrame:
    """Accuracy, macro F1, neutral F1 and the share called neutral for each band, in one pass."""
    rows = predictions.withColumn("band", F.explode(F.array(*map(F.lit, bands)))).withColumn("pred", X.banded("compound", F.col("band")))
    neutral = rows.groupBy("model", "band").agg(F.round(100.0 * F.avg((F.col("pred") == "neutral").cast("int")), 4).alias("neutral_pct"))
    return overall(rows, "model", "band").select("model", "band", "accuracy", "macro_f1", "neutral_f1").join(neutral, ["model", "band"])


def best_band(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("model").agg(F.max_by("band", F.struct(F.col("macro_f1"), -F.col("band"))).alias("best_band"), F.max("macro_f1").alias("macro_f1"))


def discordant(predictions: DataFrame) -> DataFrame:
    """For each pair of models: both right, only the first, only the second, none."""
    hit = predictions.select("review_id", "model", (F.col("pred") == F.col("true_label")).alias("hit"))
    a, b = (hit.select("review_id", F.col("model").alias(m), F.col("hit").alias(h)) for m, h in (("model_a", "a"), ("model_b", "b")))
    pairs = a.join(b, "review_id").where("model_a < model_b").groupBy("model_a", "model_b")
    return pairs.agg(F.count_if(F.expr("a AND b")).alias("both_right"), F.count_if(F.expr("a AND NOT b")).alias("only_a"), F.count_if(F.expr("b AND NOT a")).alias("only_b"), F.count_if(F.expr("NOT a AND NOT b")).alias("none_right"))


def mcnemar(predictions: DataFrame) -> DataFrame:
    """The exact two-sided test for each pair. The p-value runs over one row a pair, whatever the number of reviews."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        def one(x, y):
            n, k = int(x + y), int(min(x, y))
            if n == 0:
                return 1.0
            if n <= 1000:
                return min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
            terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * log(2) for i in range(k + 1)]
            top = max(terms)
            return min(1.0, 2 * exp(top) * sum(exp(t - top) for t in terms))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    d = discordant(predictions)
    better = F.when(F.col("only_a") > F.col("only_b"), F.col("model_a")).when(F.col("only_b") > F.col("only_a"), F.col("model_b"))
    return d.withColumn("p_value", F.round(p_value("only_a", "only_b"), 9)).withColumn("better", better).withColumn("significant", F.col("p_value") < 0.05)


def error_patterns(predictions: DataFrame, model: str, other: str) -> DataFrame:
    """Counts: neutral called polar while the other is right, negative called positive, wrong by every model."""
    wide = predictions.groupBy("review_id").pivot("model", [model, other]).agg(F.first("pred"))
    wide = wide.join(predictions.groupBy("review_id").agg(F.first("true_label").alias("truth"), F.collect_list("pred").alias("preds")), "review_id")
    m, o = F.col(f"`{model}`"), F.col(f"`{other}`")
    return wide.agg(
        F.count_if((F.col("truth") == "neutral") & (m != "neutral") & (o == "neutral")).alias("neutral_to_polar"), F.count_if((F.col("truth") == "negative") & (m == "positive")).alias("negative_to_positive"),
        F.count_if(F.forall("preds", lambda p: p != F.col("truth"))).alias("all_wrong"),
    )


def wide_predictions(predictions: DataFrame, models: list[str]) -> DataFrame:
    return predictions.groupBy("review_id", "true_label").pivot("model", models).agg(F.first("pred"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """P@k (over k even when fewer came), recall, reciprocal rank and nDCG for each query that has a judgement.

    ``ranked``: query_id, doc_id, rank from 1; ``relevant``: query_id, doc_id."""
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = ranked.where(F.col("rank") <= k).join(relevant.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").na.fill(0, ["rel"])
    gain = F.col("rel") / (F.log(F.col("rank") + 1.0) / F.log(F.lit(2.0)))
    by = got.groupBy("query_id").agg(F.sum("rel").alias("hits"), F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))).alias("rr"), F.sum(gain).alias("dcg"))
    ideal = F.element_at(F.array(*[F.lit(sum(1 / log2(i + 1) for i in range(1, n + 1))) for n in range(1, k + 1)]), F.least(F.col("n_relevant"), F.lit(k)).cast("int"))
    out = wanted.join(by, "query_id", "left").na.fill(0, ["hits", "rr", "dcg"])
    return out.select(
        "query_id", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.col("hits") / F.col("n_relevant"), 6).alias("recall"), F.round("rr", 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def threshold_sweep(scored: DataFrame, thresholds: tuple[float, ...], k: int = 5) -> DataFrame:
    """For each threshold: queries answered, refused, and the mean number kept up to k (zeros count)."""
    t = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    by = t.groupBy("threshold", "query_id").agg(F.count_if(F.coalesce("score", F.lit(0.0)) >= F.col("threshold")).alias("kept"))
    return by.groupBy("threshold").agg(F.count_if(F.col("kept") > 0).alias("answered"), F.count_if(F.col("kept") == 0).alias("refused"), F.round(F.avg(F.least("kept", F.lit(k))), 6).alias("mean_kept"))


def outcome(in_scope: str = "in_scope", kept: str = "kept"):
    return F.when(~F.col(in_scope), "refused_out_of_scope").when(F.col(kept) == 0, "refused_no_evidence").otherwise("answered")


def paired_ablation(scores: DataFrame, arm: str, value: str, key: str, first: str, second: str) -> DataFrame:
    """Means over the keys that both arms scored, their difference, and how many keys only one arm has."""
    wide = scores.groupBy(key).agg(F.max(F.when(F.col(arm) == first, F.col(value))).alias("a"), F.max(F.when(F.col(arm) == second, F.col(value))).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return wide.agg(
        F.count_if(both).alias("paired"), F.count_if(~both).alias("unpaired"), F.round(F.avg(F.when(both, F.col("a"))), 6).alias("mean_a"), F.round(F.avg(F.when(both, F.col("b"))), 6).alias("mean_b"),
        F.round(F.avg(F.when(both, F.col("b") - F.col("a"))), 6).alias("delta"),
    )
