"""Queries over predictions, vectors and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import vectors as VEC
from . import views as V
from .registry import query
from .views import with_

PRED = with_("predictions")
CLS = """, lab AS (SELECT DISTINCT {k}true_label AS label FROM p UNION SELECT DISTINCT {k}pred FROM p), cls AS (
SELECT l.*, (SELECT count(*) FROM p WHERE {on} p.true_label = l.label AND p.pred = l.label) AS tp, (SELECT count(*) FROM p WHERE {on} p.true_label = l.label) AS support, (SELECT count(*) FROM p WHERE {on} p.pred = l.label) AS predicted FROM lab l),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0.0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0.0) AS f1 FROM cls) """


def cls(*keys: str, source: str = "predictions") -> str:
    return f", p AS (SELECT * FROM {source})" + CLS.format(k="".join(f"{k}, " for k in keys), on="".join(f"p.{k} = l.{k} AND " for k in keys))


OVERALL = "CAST(sum(support) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, " + ", ".join(f"round(avg({c}), 6) AS macro_{c}" for c in ("precision", "recall", "f1")) + ", " + ", ".join(f"round(sum({c} * support) / sum(support)::DOUBLE, 6) AS weighted_{c}" for c in ("precision", "recall", "f1")) + ", round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(max(f1) FILTER (label = 'neutral'), 6) AS neutral_f1"


@query("a19_confusion", PRED + ", l AS (SELECT unnest(['negative', 'neutral', 'positive']) AS x), g AS (SELECT model, a.x AS true_label, b.x AS pred FROM (SELECT DISTINCT model FROM predictions), l a, l b), c AS (SELECT g.*, (SELECT count(*) FROM predictions p WHERE p.model = g.model AND p.true_label = g.true_label AND p.pred = g.pred) AS n FROM g) SELECT *, coalesce(round(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY model, true_label), 0)::DOUBLE, 2), 0.0) AS row_pct FROM c")
def a19(spark, d):
    return E.confusion(V.predictions(spark, d))


@query("a20_a22_overall", PRED + cls("model") + f"SELECT model, {OVERALL} FROM m GROUP BY model")
def a20(spark, d):
    return E.overall(E.usable(V.predictions(spark, d)), "model")


@query("a21_per_class", PRED + cls("model") + "SELECT model, label, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def a21(spark, d):
    p = E.per_class(V.predictions(spark, d), "model")
    return p.select("model", "label", "tp", "support", "predicted", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("a23_by_platform", PRED + cls("model", "platform") + "SELECT model, platform, CAST(sum(support) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(max(f1) FILTER (label = 'neutral'), 6) AS neutral_f1 FROM m GROUP BY ALL")
def a23(spark, d):
    return E.by_platform(V.predictions(spark, d))


@query("a23_spread", PRED + cls("model", "platform") + "SELECT model, round(max(f) - min(f), 6) AS spread FROM (SELECT model, platform, round(avg(f1), 6) AS f FROM m GROUP BY ALL) GROUP BY model")
def a23_spread(spark, d):
    return E.platform_spread(V.predictions(spark, d))


@query("a24_p16_binary", PRED + ", nn AS (SELECT *, CASE WHEN s_neg >= s_pos THEN 'negative' ELSE 'positive' END AS forced FROM predictions WHERE true_label <> 'neutral'), f AS (SELECT model, true_label, forced AS pred FROM nn)"
       + cls("model", source="nn") + ", st AS (SELECT model, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS strict_accuracy, round(avg(f1), 6) AS strict_macro_f1 FROM m GROUP BY model)"
       + cls("model", source="f").replace(" p AS", " p2 AS").replace("FROM p", "FROM p2").replace("p.", "p2.").replace("lab AS", "lab2 AS").replace("FROM lab l", "FROM lab2 l").replace("cls AS", "cls2 AS").replace("FROM cls)", "FROM cls2)").replace("\nm AS", "\nm2 AS")
       + ", fo AS (SELECT model, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS forced_accuracy, round(avg(f1), 6) AS forced_macro_f1 FROM m2 GROUP BY model) SELECT *, round(forced_macro_f1 - strict_macro_f1, 6) AS gain FROM st JOIN fo USING (model)")
def a24(spark, d):
    return E.binary(V.predictions(spark, d))


BANDS = (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
BANDED = f", b AS (SELECT p0.* EXCLUDE (pred), band, CASE WHEN compound >= band THEN 'positive' WHEN compound <= -band THEN 'negative' ELSE 'neutral' END AS pred FROM predictions p0, (SELECT unnest([{', '.join(map(str, BANDS))}]::DOUBLE[]) AS band))"
SWEEP = PRED + BANDED + cls("model", "band", source="b") + ", sw AS (SELECT model, band, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(max(f1) FILTER (label = 'neutral'), 6) AS neutral_f1 FROM m GROUP BY ALL) "


@query("a25_band_sweep", SWEEP + "SELECT sw.*, neutral_pct FROM sw JOIN (SELECT model, band, round(100.0 * avg(CASE WHEN pred = 'neutral' THEN 1 ELSE 0 END), 4) AS neutral_pct FROM b GROUP BY ALL) USING (model, band)")
def a25(spark, d):
    return E.band_sweep(V.predictions(spark, d), BANDS)


@query("a37_best_band", SWEEP + "SELECT model, arg_max(band, (macro_f1, -band)) AS best_band, max(macro_f1) AS macro_f1 FROM sw GROUP BY model")
def a37(spark, d):
    return E.best_band(E.band_sweep(V.predictions(spark, d), BANDS))


DISCORDANT = "SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.pred = a.true_label AND b.pred = b.true_label) AS both_right, count(*) FILTER (a.pred = a.true_label AND b.pred <> b.true_label) AS only_a, count(*) FILTER (a.pred <> a.true_label AND b.pred = b.true_label) AS only_b, count(*) FILTER (a.pred <> a.true_label AND b.pred <> b.true_label) AS none_right FROM predictions a JOIN predictions b ON a.review_id = b.review_id AND a.model < b.model GROUP BY ALL"


@query("a26_j12_discordant", PRED + DISCORDANT)
def a26_counts(spark, d):
    return E.discordant(V.predictions(spark, d))


P_VALUE = "CASE WHEN only_a + only_b = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END"


@query("a26_mcnemar", PRED.rstrip() + f", d AS ({DISCORDANT}), t AS (SELECT *, round({P_VALUE}, 9) AS p_value FROM d) SELECT *, CASE WHEN only_a > only_b THEN model_a WHEN only_b > only_a THEN model_b END AS better, p_value < 0.05 AS significant FROM t")
def a26(spark, d):
    return E.mcnemar(V.predictions(spark, d))


@query("f17_error_patterns", PRED + ", w AS (SELECT review_id, any_value(true_label) AS t, max(pred) FILTER (model = 'length') AS a, max(pred) FILTER (model = 'truthful') AS b, bool_and(pred <> true_label) AS wrong FROM predictions GROUP BY 1) SELECT count(*) FILTER (t = 'neutral' AND a <> 'neutral' AND b = 'neutral') AS neutral_to_polar, count(*) FILTER (t = 'negative' AND a = 'positive') AS negative_to_positive, count(*) FILTER (wrong) AS all_wrong FROM w")
def f17(spark, d):
    return E.error_patterns(V.predictions(spark, d), "length", "truthful")


@query("a39_wide_predictions", PRED + "SELECT review_id, true_label, max(pred) FILTER (model = 'length') AS length, max(pred) FILTER (model = 'parity') AS parity, max(pred) FILTER (model = 'truthful') AS truthful FROM predictions GROUP BY ALL")
def a39(spark, d):
    return E.wide_predictions(V.predictions(spark, d), ["length", "parity", "truthful"])


@query("a41_batch_agreement", PRED + "SELECT model, count(*) AS scored, count(*) FILTER (pred = 'negative') AS negative, count(*) FILTER (pred = 'neutral') AS neutral, count(*) FILTER (pred = 'positive') AS positive, round(avg(CASE WHEN pred = true_label THEN 1 ELSE 0 END), 6) AS agreement FROM predictions GROUP BY 1")
def a41(spark, d):
    return A.agreement(V.predictions(spark, d))


@query("a42_u5_two_arms", PRED + "SELECT CASE WHEN model = 'truthful' THEN 'with' ELSE 'without' END AS arm, count(*) AS n, round(avg(compound), 6) AS mean_score, round(avg(s_pos), 6) AS mean_positive FROM predictions WHERE model <> 'parity' GROUP BY 1")
def a42(spark, d):
    p = V.predictions(spark, d).where("model <> 'parity'").withColumn("arm", F.when(F.col("model") == "truthful", "with").otherwise("without"))
    return p.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("compound"), 6).alias("mean_score"), F.round(F.avg(F.col("scores")["positive"]), 6).alias("mean_positive"))


@query("a36_j14_paired_ablation", PRED + ", w AS (SELECT review_id, max(compound) FILTER (model = 'length') AS a, max(compound) FILTER (model = 'truthful' AND review_id % 5 > 0) AS b FROM predictions GROUP BY 1) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired, round(avg(a) FILTER (b IS NOT NULL), 6) AS mean_a, round(avg(b) FILTER (a IS NOT NULL), 6) AS mean_b, round(avg(b - a), 6) AS delta FROM w")
def a36(spark, d):
    p = V.predictions(spark, d).where("model <> 'truthful' OR review_id % 5 > 0")
    return E.paired_ablation(p, "model", "compound", "review_id", "length", "truthful")


@query("p18_best_label", PRED + "SELECT review_id, model, CASE WHEN s_neg >= s_neu AND s_neg >= s_pos THEN 'negative' WHEN s_neu >= s_pos THEN 'neutral' ELSE 'positive' END AS label, round(greatest(s_neg, s_neu, s_pos), 4) AS confidence FROM predictions")
def p18(spark, d):
    from ..functions import text as X

    p = V.predictions(spark, d).withColumn("best", X.best_label("scores"))
    return p.select("review_id", "model", "best.label", "best.confidence")


@query("j6_predictions_with_corpus", PRED + "SELECT p.review_id, model, p.platform, d.source AS platform_corpus, d.n_chars FROM predictions p LEFT JOIN documents d ON d.doc_id = p.review_id")
def j6(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("platform_corpus"), "n_chars")
    return V.predictions(spark, d).join(docs, "review_id", "left").select("review_id", "model", "platform", "platform_corpus", "n_chars")


@query("m8_best_model", PRED + cls("model") + ", o AS (SELECT model, round(avg(f1), 6) AS f, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS a FROM m GROUP BY 1) SELECT arg_max(model, f) AS by_macro_f1, arg_max(model, a) AS by_accuracy FROM o")
def m8(spark, d):
    return E.overall(V.predictions(spark, d), "model").agg(F.max_by("model", "macro_f1").alias("by_macro_f1"), F.max_by("model", "accuracy").alias("by_accuracy"))


@query("m9_fallback", PRED + "SELECT review_id, coalesce(max(CASE WHEN pred <> 'neutral' THEN pred END) FILTER (model = 'length'), max(pred) FILTER (model = 'parity')) AS pred, CASE WHEN coalesce(max(pred) FILTER (model = 'length'), 'neutral') <> 'neutral' THEN 'length' ELSE 'parity' END AS model_version FROM predictions GROUP BY 1")
def m9(spark, d):
    p = V.predictions(spark, d)
    first = F.max(F.when((F.col("model") == "length") & (F.col("pred") != "neutral"), F.col("pred")))
    second = F.max(F.when(F.col("model") == "parity", F.col("pred")))
    return p.groupBy("review_id").agg(F.coalesce(first, second).alias("pred"), F.when(first.isNotNull(), "length").otherwise("parity").alias("model_version"))


def docs_vectors(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def question_vectors(spark, d):
    """Every vector whose id is divisible by 20, against all."""
    return docs_vectors(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector", F.col("label").alias("query_label"))


TOP = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, list_dot_product(q.e, x.e) AS score, q.label AS ql, x.label AS dl FROM v q, v x WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k}) """


@query("v2_j9_w8_top_k", TOP.format(k=10) + "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM t")
def v2(spark, d):
    return VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("t5_semantic_search_filtered", TOP.format(k=5).replace("WHERE q.vec_id % 20 = 0", "WHERE q.vec_id % 20 = 0 AND x.label <= 4") + "SELECT query_id, doc_id, round(score, 4) AS score, rank FROM t")
def t5(spark, d):
    return VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 5, F.col("label") <= 4).withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


@query("v3_f14_threshold", TOP.format(k=20) + "SELECT query_id, doc_id, round(score, 6) AS score FROM t WHERE score >= 0.35")
def v3(spark, d):
    return VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 20).where(F.col("score") >= 0.35).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def mmr_sql(k: int = 5, weight: float = 0.5) -> str:
    """mmr (query_id, doc_id, score, pick) over a table cand (query_id, doc_id, score, e)."""
    steps = ["p1 AS (SELECT query_id, doc_id, score, e, 1 AS pick FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1)"]
    for i in range(2, k + 1):
        so_far = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        steps.append(f"""c{i} AS ({so_far}), m{i} AS (SELECT c.query_id, c.doc_id, c.score, any_value(c.e) AS e, {weight}::DOUBLE * c.score - {1 - weight}::DOUBLE * max(list_cosine_similarity(c.e, c{i}.e)) AS value
FROM cand c JOIN c{i} ON c.query_id = c{i}.query_id WHERE (c.query_id, c.doc_id) NOT IN (SELECT (query_id, doc_id) FROM c{i}) GROUP BY 1, 2, 3),
p{i} AS (SELECT query_id, doc_id, score, e, {i} AS pick FROM m{i} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, score DESC, doc_id) = 1)""")
    every = " UNION ALL ".join(f"SELECT query_id, doc_id, score, pick FROM p{j}" for j in range(1, k + 1))
    return ", ".join([*steps, f"mmr AS ({every})"])


@query("v4_mmr", TOP.format(k=20) + ", cand AS (SELECT t.query_id, t.doc_id, t.score, v.e FROM t JOIN v ON v.vec_id = t.doc_id), " + mmr_sql() + " SELECT query_id, doc_id, round(score, 6) AS score, CAST(pick AS BIGINT) AS pick FROM mmr WHERE score >= 0.35")
def v4(spark, d):
    found = VEC.grounded(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d).select("doc_id", "vector"), 0.35)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "pick")


@query("f16_usable_predictions", PRED.rstrip() + ", p AS (SELECT model, true_label, CASE WHEN review_id % 7 = 0 THEN NULL WHEN review_id % 11 = 0 THEN 'error' ELSE pred END AS pred FROM predictions) SELECT model, pred, count(*) AS n FROM p WHERE pred IS NOT NULL AND pred <> 'error' GROUP BY ALL")
def f16(spark, d):
    i = F.col("review_id")
    p = V.predictions(spark, d).withColumn("pred", F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, "error").otherwise(F.col("pred")))
    return E.usable(p).groupBy("model", "pred").agg(F.count("*").alias("n"))


@query("a27_retrieval_metrics", TOP.format(k=5) + ", r AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id FROM v q JOIN v x ON q.label = x.label AND q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0), n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), g AS (SELECT t.query_id, rank, CASE WHEN r.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.doc_id = t.doc_id), b AS (SELECT query_id, sum(rel) AS hits, max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END) AS rr, sum(rel / log2(rank + 1)) AS dcg FROM g GROUP BY 1) SELECT n.query_id, round(coalesce(hits, 0) / 5::DOUBLE, 6) AS precision, round(coalesce(hits, 0) / n::DOUBLE, 6) AS recall, round(coalesce(rr, 0), 6) AS mrr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(n, 5) AS BIGINT) + 1) x(i)), 6) AS ndcg FROM n LEFT JOIN b USING (query_id)")
def a27(spark, d):
    q, docs = question_vectors(spark, d), docs_vectors(spark, d)
    ranked = VEC.top_k(q.select("query_id", "vector"), docs, 5)
    judged = q.join(docs, (F.col("query_label") == F.col("label")) & (F.col("query_id") != F.col("doc_id"))).select("query_id", "doc_id")
    return E.retrieval_metrics(ranked, judged, 5)


THRESHOLDS = (0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7)


@query("a28_threshold_sweep", TOP.format(k=20) + f", h AS (SELECT query_id, threshold, count(*) FILTER (score >= threshold) AS kept FROM t, (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]::DOUBLE[]) AS threshold) GROUP BY ALL) SELECT threshold, count(*) FILTER (kept > 0) AS answered, count(*) FILTER (kept = 0) AS refused, round(avg(least(kept, 5)), 6) AS mean_kept FROM h GROUP BY 1")
def a28(spark, d):
    return E.threshold_sweep(VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 20), THRESHOLDS)


@query("a29_outcomes", TOP.format(k=20) + ", h AS (SELECT query_id, query_id % 60 <> 0 AS in_scope, count(*) FILTER (score >= 0.4 AND query_id <> doc_id) AS kept FROM t GROUP BY 1, 2) SELECT query_id % 3 AS kind, CASE WHEN NOT in_scope THEN 'refused_out_of_scope' WHEN kept = 0 THEN 'refused_no_evidence' ELSE 'answered' END AS outcome, count(*) AS n FROM h GROUP BY ALL")
def a29(spark, d):
    t = VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 20)
    h = t.groupBy("query_id", (F.col("query_id") % 60 != 0).alias("in_scope")).agg(F.count_if((F.col("score") >= 0.4) & (F.col("query_id") != F.col("doc_id"))).alias("kept"))
    return A.counts_by(h.select((F.col("query_id") % 3).alias("kind"), E.outcome().alias("outcome")), "kind", "outcome")


@query("a31_retrieval_summary", TOP.format(k=3) + ", b AS (SELECT query_id, avg(score) AS a, min(score) AS lo, max(score) AS hi FROM t WHERE query_id <> doc_id GROUP BY 1) SELECT count(*) AS queries, round(avg(a), 6) AS mean_similarity, round(min(lo), 6) AS lowest, round(max(hi), 6) AS highest, round(100.0 * avg(CASE WHEN hi >= 0.35 THEN 1 ELSE 0 END), 2) AS success_pct FROM b")
def a31(spark, d):
    t = VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 3).where("query_id <> doc_id")
    by = t.groupBy("query_id").agg(F.avg("score").alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    return by.agg(F.count("*").alias("queries"), F.round(F.avg("a"), 6).alias("mean_similarity"), F.round(F.min("lo"), 6).alias("lowest"), F.round(F.max("hi"), 6).alias("highest"), F.round(100.0 * F.avg((F.col("hi") >= 0.35).cast("int")), 2).alias("success_pct"))


CEN = "WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM x) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY 1), k AS (SELECT vec_id, x.label, list_cosine_similarity(e, c) AS cosine FROM x JOIN c USING (label)) "


@query("v5_centroids", CEN + "SELECT label, len(c) AS dims, round(list_sum(list_transform(c, lambda v: v * v)), 9) AS squared FROM c")
def v5(spark, d):
    c = VEC.centroids(docs_vectors(spark, d), "label", "vector")
    return c.select("label", F.size("centroid").cast("long").alias("dims"), F.round(VEC.dot("centroid", "centroid"), 9).alias("squared"))


@query("a15_coherence", CEN + "SELECT label, count(*) AS n, round(avg(cosine), 6) AS mean, round(min(cosine), 6) AS lowest, round(max(cosine), 6) AS highest, round(stddev_pop(cosine), 6) AS spread FROM k GROUP BY 1")
def a15(spark, d):
    return VEC.coherence_summary(VEC.coherence(docs_vectors(spark, d), "label", "vector"), "label")


@query("w9_w10_representatives", CEN + "SELECT label, vec_id AS doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM k) WHERE rank <= 5")
def w9(spark, d):
    return VEC.nearest_members(VEC.coherence(docs_vectors(spark, d), "label", "vector"), "label", "doc_id", 5).select("label", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("v6_j11_separation", CEN + "SELECT count(*) AS pairs, round(avg(list_cosine_similarity(a.c, b.c)), 6) AS mean_cosine FROM c a JOIN c b ON a.label < b.label")
def v6(spark, d):
    return VEC.separation(VEC.centroids(docs_vectors(spark, d), "label", "vector"), "label")
