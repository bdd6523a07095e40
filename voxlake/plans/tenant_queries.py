"""Queries over the corpus and tenant views: filters, joins, aggregates, windows, listings, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import sampling as S
from . import views as V
from .registry import query
from .views import with_

ORG = 1


def base(spark, d, org=ORG):
    return P.base_frame(V.feedback(spark, d), V.results(spark, d), V.categories(spark), organisation_id=org)


BASE = with_("feedback", "results", "categories") + f""", base AS (
  SELECT f.*, r.label, r.category_id, c.key AS category_key, r.confidence, r.is_unclassified, r.feedback_id IS NOT NULL AS has_result, c.name AS category_name
  FROM feedback f LEFT JOIN results r ON r.feedback_id = f.feedback_id AND r.organisation_id = {ORG} AND r.is_current
  LEFT JOIN categories c ON c.id = r.category_id AND (c.organisation_id IS NULL OR c.organisation_id = {ORG}) WHERE f.organisation_id = {ORG}) """
LABELS = ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in ("negative", "neutral", "positive"))
PCT = lambda part, whole, k=1: f"coalesce(round({part} * 100.0::DOUBLE / nullif({whole}, 0), {k}), 0.0)"


@query("a8_category_breakdown", BASE + f"SELECT category_key, category_name, count(*) AS n, {LABELS}, round(avg(confidence), 3) AS avg_confidence, {PCT('count(*)', '(SELECT count(*) FROM base WHERE has_result)')} AS share_pct FROM base WHERE has_result GROUP BY category_key, category_name")
def a8(spark, d):
    return A.category_breakdown(base(spark, d))


@query("a7_trend_day", BASE + f"SELECT date_trunc('day', coalesce(feedback_at, created_at))::TIMESTAMP AS period, count(*) AS n, {LABELS}, round(avg(rating), 2) AS avg_rating FROM base GROUP BY 1 ORDER BY 1 LIMIT 400")
def a7_day(spark, d):
    return A.trend(base(spark, d), "day")


@query("a7_trend_week", BASE + f"SELECT date_trunc('week', coalesce(feedback_at, created_at))::TIMESTAMP AS period, count(*) AS n, {LABELS}, round(avg(rating), 2) AS avg_rating FROM base GROUP BY 1 ORDER BY 1 LIMIT 400")
def a7_week(spark, d):
    return A.trend(base(spark, d), "week")


@query("a7_trend_month", BASE + f"SELECT date_trunc('month', coalesce(feedback_at, created_at))::TIMESTAMP AS period, count(*) AS n, {LABELS}, round(avg(rating), 2) AS avg_rating FROM base GROUP BY 1 ORDER BY 1 LIMIT 400")
def a7_month(spark, d):
    return A.trend(base(spark, d), "month")


JOBS = with_("jobs") + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisation_id, import_id ORDER BY created_at DESC, id DESC) AS k FROM jobs) WHERE k = 1) "
STATE = "CASE WHEN status IN ('queued', 'running') OR (status = 'failed' AND attempts < max_attempts) THEN 'pending' WHEN status = 'failed' THEN 'failed' ELSE 'done' END"


@query("w1_latest_jobs", JOBS + f"SELECT organisation_id, import_id, status, attempts, created_at, {STATE} AS state FROM latest")
def w1(spark, d):
    return P.latest_jobs(V.jobs(spark, d)).withColumn("state", P.job_state()).select("organisation_id", "import_id", "status", "attempts", "created_at", "state")


@query("a6_tenant_summary", BASE + JOBS.replace("WITH ", ", ", 1) + f""", j AS (SELECT import_id, {STATE} AS state FROM latest WHERE organisation_id = {ORG}),
x AS (SELECT b.*, j.state FROM base b LEFT JOIN j ON j.import_id = b.import_batch_id::VARCHAR)
SELECT count(*) AS total, count(*) FILTER (has_result) AS analysed, count(*) FILTER (NOT has_result) AS not_analysed, count(*) FILTER (NOT has_result AND state = 'pending') AS pending, count(*) FILTER (NOT has_result AND state = 'failed') AS failed,
{LABELS}, """ + ", ".join(f"{PCT(f'count(*) FILTER (label = {chr(39)}{x}{chr(39)})', 'count(*) FILTER (has_result)')} AS {x}_pct" for x in ("negative", "neutral", "positive")) + """,
count(*) FILTER (is_unclassified) AS unclassified, round(avg(rating), 2) AS avg_rating, min(feedback_at) AS first_at, max(feedback_at) AS last_at FROM x""")
def a6(spark, d):
    return A.tenant_summary(base(spark, d), P.latest_jobs(V.jobs(spark, d), organisation_id=ORG))


FILTERS = {
    "f2_sentiment": (P.FeedbackFilters(sentiment="Negative"), "label = 'negative'"),
    "f3_category": (P.FeedbackFilters(category_key="service_quality"), "category_key = 'service_quality'"),
    "f4_unclassified_true": (P.FeedbackFilters(unclassified=True), "is_unclassified IS TRUE"),
    "f4_unclassified_false": (P.FeedbackFilters(unclassified=False), "is_unclassified IS FALSE"),
    "f5_platform": (P.FeedbackFilters(platform="click"), "metadata->>'platform' = 'click'"),
    "f6_search": (P.FeedbackFilters(search=' {"K": '), "contains(lower(text), '{\"k\":')"),
    "f7_dates": (P.FeedbackFilters(date_from="2024-01-05 00:00:00", date_to="2024-01-20 00:00:00"), "feedback_at >= TIMESTAMP '2024-01-05' AND feedback_at <= TIMESTAMP '2024-01-20'"),
    "f8_rating": (P.FeedbackFilters(rating_min=2, rating_max=4), "rating BETWEEN 2 AND 4"),
    "f9_analysed": (P.FeedbackFilters(analysed=True), "has_result"),
    "f9_not_analysed": (P.FeedbackFilters(analysed=False), "NOT has_result"),
    "f10_all": (P.FeedbackFilters(sentiment="negative", rating_max=2, analysed=True, unclassified=False), "label = 'negative' AND rating <= 2 AND has_result AND is_unclassified IS FALSE"),
}
for _name, (_f, _where) in FILTERS.items():
    query(_name, BASE + f"SELECT feedback_id, label, category_key, rating, feedback_at FROM base WHERE {_where}")(lambda spark, d, f=_f: P.apply_filters(base(spark, d), f).select("feedback_id", "label", "category_key", "rating", "feedback_at"))


@query("f1_tenant_scope", BASE + "SELECT count(*) AS n, min(organisation_id) AS lo, max(organisation_id) AS hi FROM base")
def f1(spark, d):
    return base(spark, d).agg(F.count("*").alias("n"), F.min("organisation_id").alias("lo"), F.max("organisation_id").alias("hi"))


@query("j1_base_frame", BASE + "SELECT feedback_id, label, category_id, category_key, category_name, confidence, has_result FROM base")
def j1(spark, d):
    return base(spark, d).select("feedback_id", "label", "category_id", "category_key", "category_name", "confidence", F.coalesce("has_result", F.lit(False)).alias("has_result"))


OWN = "own AS (SELECT DISTINCT event_type AS key, upper(event_type) AS name, user_id % 4 AS organisation_id, event_type <> 'signup' AS is_active FROM events), every AS (SELECT key, name, organisation_id, is_active FROM categories UNION ALL SELECT * FROM own UNION ALL SELECT DISTINCT 'service_quality', 'Service of ' || (user_id % 4), user_id % 4, true FROM events WHERE event_type = 'error')"


@query("f15_w11_available_categories", with_("categories").rstrip() + f", {OWN} SELECT key, arg_max(name, organisation_id IS NOT NULL) AS name, max(organisation_id IS NOT NULL) AS own FROM every WHERE is_active AND (organisation_id IS NULL OR organisation_id = {ORG}) GROUP BY key")
def f15(spark, d):
    """The defaults with an organisation's own categories, which stand before them: one for each of its kinds of event."""
    e = V.table(spark, d, "events").withColumn("organisation_id", F.col("user_id") % 4)
    own = e.select(F.col("event_type").alias("key"), F.upper("event_type").alias("name"), "organisation_id", (F.col("event_type") != "signup").alias("is_active")).distinct()
    over = e.where("event_type = 'error'").select(F.lit("service_quality").alias("key"), F.concat(F.lit("Service of "), F.col("organisation_id").cast("string")).alias("name"), "organisation_id", F.lit(True).alias("is_active")).distinct()
    return P.available_categories(V.categories(spark).drop("id").union(own).union(over), organisation_id=ORG)


ROW = "feedback_id, text, rating, feedback_at, created_at, metadata->>'platform' AS platform, label, category_key, category_name, is_unclassified, label IS NOT NULL OR is_unclassified IS NOT NULL AS analysed"


@query("o1_p14_listing", BASE + f"SELECT {ROW} FROM base ORDER BY base.feedback_at DESC NULLS LAST, feedback_id LIMIT 50 OFFSET 50")
def o1(spark, d):
    return P.listing_rows(P.listing(base(spark, d), sort="feedback_at", page=2))


@query("o1_keyset_listing", BASE + f"SELECT {ROW} FROM base WHERE rating > 2 OR (rating = 2 AND feedback_id > 100) OR rating IS NULL ORDER BY base.rating ASC NULLS LAST, feedback_id LIMIT 20")
def o1_key(spark, d):
    return P.listing_rows(P.listing(base(spark, d), sort="rating", descending=False, page_size=20, after=(2.0, 100)))


@query("o2_page_totals", BASE + "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM base WHERE rating >= 3")
def o2(spark, d):
    return P.page_totals(P.apply_filters(base(spark, d), P.FeedbackFilters(rating_min=3)))


@query("o3_one_item", BASE + f"SELECT {ROW} FROM base WHERE feedback_id = (SELECT max(feedback_id) FROM base)")
def o3(spark, d):
    rows = base(spark, d)
    last = rows.agg(F.max("feedback_id").alias("last"))
    return P.listing_rows(rows.join(F.broadcast(last), F.col("feedback_id") == F.col("last")))


@query("o4_imports_newest_first", with_("feedback", "jobs") + f""", i AS (SELECT import_batch_id, count(*) AS n, max(created_at) AS newest FROM feedback WHERE organisation_id = {ORG} GROUP BY 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organisation_id, import_id ORDER BY created_at DESC, id DESC) AS k FROM jobs) WHERE k = 1 AND organisation_id = {ORG})
SELECT i.import_batch_id, n, newest, status FROM i LEFT JOIN l ON l.import_id = i.import_batch_id::VARCHAR ORDER BY newest DESC, import_batch_id LIMIT 50""")
def o4(spark, d):
    imports = V.feedback(spark, d).where(F.col("organisation_id") == ORG).groupBy("import_batch_id").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))
    latest = P.latest_jobs(V.jobs(spark, d), organisation_id=ORG).select("import_id", "status")
    return imports.join(latest, F.col("import_batch_id").cast("string") == F.col("import_id"), "left").drop("import_id").orderBy(F.desc("newest"), "import_batch_id").limit(50)


@query("s11_feedback_of_import", with_("feedback") + f"SELECT feedback_id, created_at FROM feedback WHERE organisation_id = {ORG} AND import_batch_id = 7")
def s11(spark, d):
    return V.feedback(spark, d).where((F.col("organisation_id") == ORG) & (F.col("import_batch_id") == 7)).select("feedback_id", "created_at").orderBy("created_at", "feedback_id")


R = with_("reviews")


@query("a1_corpus_summary", R + f"SELECT count(*) AS total, count(DISTINCT platform) AS platforms, round(avg(rating), 2) AS avg_rating, {', '.join(PCT(f'count(*) FILTER (sentiment_label = {chr(39)}{x}{chr(39)})', 'count(*)') + f' AS {x}_pct' for x in ('negative', 'neutral', 'positive'))} FROM reviews")
def a1(spark, d):
    return A.corpus_summary(V.reviews(spark, d))


@query("a2_label_by_platform", R + "SELECT platform, sentiment_label, count(*) AS n FROM reviews GROUP BY ALL")
def a2(spark, d):
    return A.counts_by(V.reviews(spark, d), "platform", "sentiment_label")


@query("a3_rating_histogram", R + "SELECT rating, count(*) AS n FROM reviews GROUP BY ALL")
def a3(spark, d):
    return A.counts_by(V.reviews(spark, d), "rating").orderBy("rating")


@query("a4_p26_month_trend", R + "SELECT strftime(date, '%Y-%m') AS month, sentiment_label, count(*) AS n FROM reviews GROUP BY ALL")
def a4(spark, d):
    return A.month_trend(V.reviews(spark, d))


@query("a5_platforms", R + "SELECT DISTINCT platform FROM reviews")
def a5(spark, d):
    return V.reviews(spark, d).select("platform").distinct().orderBy("platform")


@query("a11_distributions", R + "SELECT 'platform' AS kind, platform AS value, count(*) AS n FROM reviews GROUP BY ALL UNION ALL SELECT 'category', product_category, count(*) FROM reviews GROUP BY ALL UNION ALL SELECT 'label', sentiment_label, count(*) FROM reviews GROUP BY ALL")
def a11(spark, d):
    r = V.reviews(spark, d)
    kinds = F.explode(F.create_map(F.lit("platform"), F.col("platform"), F.lit("category"), F.col("product_category"), F.lit("label"), F.col("sentiment_label"))).alias("kind", "value")
    return A.counts_by(r.select(kinds), "kind", "value")


@query("a12_category_frequency", with_("results") + "SELECT category_key, count(*) AS n FROM results WHERE is_current GROUP BY ALL")
def a12(spark, d):
    return A.counts_by(V.results(spark, d).where("is_current"), "category_key").orderBy(F.desc("n"), "category_key")


LANGS = ["de", "en", "es", "fr"]


@query("a13_category_by_platform", R + "SELECT sentiment_label, " + ", ".join(f"count(*) FILTER (product_category = '{x}') AS {x}" for x in LANGS) + ", count(*) FILTER (product_category IN ('de', 'en', 'es', 'fr')) AS total FROM reviews GROUP BY 1")
def a13(spark, d):
    return A.crosstab(V.reviews(spark, d), "sentiment_label", "product_category", LANGS)


@query("a14_o7_category_by_sentiment", with_("results") + f"SELECT category_key, {LABELS}, count(*) FILTER (label IS NOT NULL) AS total FROM results GROUP BY 1")
def a14(spark, d):
    return A.crosstab(V.results(spark, d), "category_key", "label", ["negative", "neutral", "positive"])


@query("a16_category_roll_up", with_("results") + ", c AS (SELECT category_key, count(*) AS n FROM results WHERE category_key IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS categories, (SELECT category_key FROM c ORDER BY n DESC, category_key LIMIT 1) AS largest, (SELECT category_key FROM c ORDER BY n, category_key LIMIT 1) AS smallest, round(avg(n), 3) AS mean_size FROM c")
def a16(spark, d):
    return A.category_roll_up(V.results(spark, d))


@query("a18_taxonomy_comparison", with_("results") + ", c AS (SELECT run_id, category_key, count(*) AS n FROM results GROUP BY ALL) SELECT run_id, round(100.0 * sum(n) FILTER (category_key IS NULL)::DOUBLE / sum(n)::DOUBLE, 2) AS unclassified_pct, 13 - count(category_key) AS unused, round(100.0 * max(n) FILTER (category_key IS NOT NULL)::DOUBLE / sum(n)::DOUBLE, 2) AS largest_pct, (SELECT round(avg(confidence), 4) FROM results r WHERE r.run_id = c.run_id) AS mean_score FROM c GROUP BY run_id")
def a18(spark, d):
    by = V.results(spark, d).groupBy("run_id", "category_key").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    none = F.col("category_key").isNull()
    return by.groupBy("run_id").agg(
        F.round(100.0 * F.sum(F.when(none, F.col("n"))) / F.sum("n"), 2).alias("unclassified_pct"), (13 - F.count("category_key")).alias("unused"),
        F.round(100.0 * F.max(F.when(~none, F.col("n"))) / F.sum("n"), 2).alias("largest_pct"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_score"),
    )


@query("a32_p25_length_profile", R + ", w AS (SELECT platform, len(regexp_extract_all(text, '\\S+')) AS n FROM reviews) SELECT platform, round(quantile_cont(n, 0.5), 3) AS median_words, round(avg(n), 3) AS mean_words, round(quantile_cont(n, 0.95), 3) AS p95_words FROM w GROUP BY 1")
def a32(spark, d):
    return A.length_profile(V.reviews(spark, d))


@query("a30_describe", "SELECT event_type, count(value) AS n, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY 1")
def a30(spark, d):
    return A.describe(V.table(spark, d, "events"), "value", "event_type")


@query("a33_usage_sums", "SELECT event_type, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS calls, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def a33(spark, d):
    e = V.table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query("a35_run_counters", with_("results") + "SELECT run_id, count(*) AS items, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status <> 'ok') AS failed, count(*) FILTER (status = 'ok') = 0 AS all_failed FROM results GROUP BY 1")
def a35(spark, d):
    return A.run_counters(V.results(spark, d))


@query("a40_label_roll_up", R + "SELECT sentiment_label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT platform, sentiment_label, count(*) AS n FROM reviews GROUP BY ALL) WHERE platform IN ('src0', 'src1') GROUP BY 1")
def a40(spark, d):
    return A.counts_by(V.reviews(spark, d), "platform", "sentiment_label").where(F.col("platform").isin("src0", "src1")).groupBy("sentiment_label").agg(F.sum("n").alias("n"))


@query("a7_facts_trend", with_("facts") + f"SELECT date_trunc('month', happened_at)::TIMESTAMP AS period, count(*) AS n, {LABELS}, round(avg(rating), 2) AS avg_rating FROM facts GROUP BY 1 ORDER BY 1 LIMIT 400")
def a7_facts(spark, d):
    return A.trend(V.facts(spark, d), "month", F.col("happened_at"))


@query("w12_supersede", with_("results") + "SELECT feedback_id, run_id, row_number() OVER (PARTITION BY feedback_id ORDER BY run_id DESC) = 1 AS is_current FROM results")
def w12(spark, d):
    r = V.results(spark, d)
    newest = r.groupBy("feedback_id").agg(F.max("run_id").alias("newest"))
    return r.join(newest, "feedback_id").select("feedback_id", "run_id", (F.col("run_id") == F.col("newest")).alias("is_current"))


@query("w17_share_of_total", R + "SELECT platform, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS share_pct FROM reviews GROUP BY 1")
def w17(spark, d):
    from pyspark.sql import Window

    by = A.counts_by(V.reviews(spark, d), "platform")
    return by.withColumn("share_pct", A.share(F.col("n"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


@query("w15_chat_pairs", "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def w15(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = V.table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("w4_balanced_sample", R + "SELECT review_id, sentiment_label FROM (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5('42:' || review_id), review_id) AS k FROM reviews) WHERE k <= 100")
def w4(spark, d):
    return S.balanced_sample(V.reviews(spark, d), ["sentiment_label"], 100, "review_id").select("review_id", "sentiment_label")


@query("w5_cell_sample", R + "SELECT review_id, platform, sentiment_label FROM (SELECT *, row_number() OVER (PARTITION BY platform, sentiment_label ORDER BY md5('7:' || review_id), review_id) AS k FROM reviews) WHERE k <= 5")
def w5(spark, d):
    return S.balanced_sample(V.reviews(spark, d), ["platform", "sentiment_label"], 5, "review_id", "7").select("review_id", "platform", "sentiment_label")


RANKED = lambda seed, name: f"""{name} AS (
  SELECT review_id, row_number() OVER (PARTITION BY sentiment_label ORDER BY md5('{seed}:' || review_id), review_id) AS k, count(*) OVER (PARTITION BY sentiment_label) AS n
  FROM reviews)"""  # noqa: E731


@query("w13_split", R.rstrip() + f""", {RANKED('42', 'ranked')}, cut AS (SELECT *, CAST(floor(n * 0.7::DOUBLE + 0.5) AS BIGINT) AS first FROM ranked)
SELECT review_id, CASE WHEN k <= first THEN 'train' WHEN k - first <= floor((n - first) * 0.5::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM cut""")
def w13(spark, d):
    """70 / 15 / 15 as it is made in two steps: the rest is halved."""
    shares = {"train": 0.7, "rest": (0.3, {"val": 0.5, "test": 0.5})}
    return S.split(V.reviews(spark, d), shares, "review_id", "sentiment_label").select("review_id", "split")


@query("w14_folds", R + "SELECT review_id, CAST(ntile(5) OVER (PARTITION BY sentiment_label ORDER BY md5('fold:42:' || review_id), review_id) - 1 AS INTEGER) AS fold FROM reviews")
def w14(spark, d):
    return S.folds(V.reviews(spark, d), 5, "review_id", "sentiment_label").select("review_id", "fold")


@query("j7_a38_u3_split_overlap", R.rstrip() + f""", {RANKED('42', 'one')}, {RANKED('7', 'two')}, t AS (SELECT review_id FROM one WHERE k > floor(n * 0.8::DOUBLE + 0.5)),
a AS (SELECT review_id FROM two WHERE k <= floor(n * 0.7::DOUBLE + 0.5)), v AS (SELECT review_id FROM two WHERE k > floor(n * 0.7::DOUBLE + 0.5) AND k <= floor(n * (0.7::DOUBLE + 0.15) + 0.5)),
u AS (SELECT * FROM a UNION SELECT * FROM v), c AS (SELECT 'train' AS part, count(*) AS n_shared FROM t SEMI JOIN a USING (review_id) UNION ALL SELECT 'val', count(*) FROM t SEMI JOIN v USING (review_id) UNION ALL SELECT 'either', count(*) FROM t SEMI JOIN u USING (review_id))
SELECT part, (SELECT count(*) FROM t) AS n_test, n_shared, {PCT('n_shared', '(SELECT count(*) FROM t)', 4)} AS pct FROM c""")
def j7(spark, d):
    r = V.reviews(spark, d).select("review_id", "sentiment_label")
    test = S.split(r, {"train": 0.8, "test": 0.2}, "review_id", "sentiment_label").where("split = 'test'").select("review_id")
    other = S.split(r, {"train": 0.7, "val": 0.15, "test": 0.15}, "review_id", "sentiment_label", "7")
    train, val = (other.where(F.col("split") == x).select("review_id") for x in ("train", "val"))
    return S.overlap(test, {"train": train, "val": val, "either": train.union(val).distinct()}, "review_id")


TXT = "review_id, length(x) AS n, md5(x) AS h"
CLEAN = "lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http\\S+|www\\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '#([A-Za-z0-9_]+)', '\\1', 'g'), '<.*?>', ' ', 'g'), '_', ' '), '[^\\x00-\\x7F]+', ' ', 'g'), '\\s+', ' ', 'g')))"


@query("p2_clean_review", R + f"SELECT {TXT} FROM (SELECT review_id, {CLEAN} AS x FROM reviews)")
def p2(spark, d):
    r = V.reviews(spark, d).select("review_id", X.clean_review("text").alias("x"))
    return r.select("review_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("h"))


@query("p2_clean_pages", "SELECT page_id AS review_id, length(x) AS n, md5(x) AS h FROM (SELECT page_id, " + CLEAN.replace("(text,", "(html,") + " AS x FROM pages)")
def p2_pages(spark, d):
    r = V.table(spark, d, "pages").select(F.col("page_id").alias("review_id"), X.clean_review("html").alias("x"))
    return r.select("review_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("h"))


@query("p1_p6_content_hash", R + "SELECT review_id, sha256(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g'))) AS h FROM reviews")
def p1(spark, d):
    return V.reviews(spark, d).select("review_id", X.content_hash("text").alias("h"))


@query("p4_p5_p17_labels", "SELECT event_id, CASE WHEN r <= 2 THEN 'negative' WHEN r = 3 THEN 'neutral' ELSE 'positive' END AS label, CASE WHEN r <= 2 THEN 1.0 WHEN r = 3 THEN 3.0 ELSE 5.0 END::DOUBLE AS back, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS banded FROM (SELECT event_id, 1 + (event_id % 9) / 2.0 AS r, (event_id % 41 - 20) / 200.0 AS c FROM events)")
def p4(spark, d):
    e = V.table(spark, d, "events").select("event_id", (1 + (F.col("event_id") % 9) / 2.0).alias("r"), ((F.col("event_id") % 41 - 20) / 200.0).alias("c"))
    e = e.withColumn("label", X.rating_label("r"))
    return e.select("event_id", "label", X.label_rating("label").alias("back"), X.banded("c").alias("banded"))


@query("p19_capped_text", R + "SELECT review_id, md5(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '…' ELSE text END) AS full_h, md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END) AS preview_h FROM reviews")
def p19(spark, d):
    return V.reviews(spark, d).select("review_id", F.md5(X.capped("text", 1000)).alias("full_h"), F.md5(X.capped("text", 200)).alias("preview_h"))


@query("p20_evidence_block", R.rstrip() + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id AS doc_id, list_dot_product(q.e, x.e) AS score FROM v q, v x WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5)
SELECT query_id, md5(string_agg('[Source: ' || coalesce(platform, 'unknown') || ' | Rating: ' || coalesce(rating::VARCHAR, 'N/A') || ' | Sentiment: ' || coalesce(sentiment_label, 'unknown') || ' | Id: ' || review_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS block
FROM t JOIN reviews ON review_id = doc_id GROUP BY query_id""")
def p20(spark, d):
    """The evidence block of every twentieth review: the five reviews nearest to it, whole."""
    from ..operators import vectors as VEC

    docs = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    found = VEC.top_k(docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), docs, 5)
    line = F.struct("rank", X.evidence_line("platform", "rating", "sentiment_label", "review_id", "text").alias("line"))
    rows = found.join(V.reviews(spark, d), F.col("doc_id") == F.col("review_id"))
    return rows.groupBy("query_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n\n")).alias("block"))


@query("p21_p22_question_guard", "SELECT item_id, NOT regexp_matches(text, '(?i)\\b(weather|politics|sports|recipe|coding|write code|poem|story|joke)\\b') AS in_scope, CASE WHEN contains(lower(text), 'amazon') THEN 'amazon' WHEN contains(lower(text), 'yelp') THEN 'yelp' WHEN contains(lower(text), 'twitter') OR contains(lower(text), 'airline') THEN 'twitter_airline' END AS platform FROM (SELECT item_id, text || CASE item_id % 4 WHEN 0 THEN ' any Joke on Amazon?' WHEN 1 THEN ' about Airline food' WHEN 2 THEN ' storyboard' ELSE '' END AS text FROM benchmark)")
def p21(spark, d):
    tail = F.when(F.col("item_id") % 4 == 0, " any Joke on Amazon?").when(F.col("item_id") % 4 == 1, " about Airline food").when(F.col("item_id") % 4 == 2, " storyboard").otherwise("")
    q = V.table(spark, d, "benchmark").withColumn("text", F.concat("text", tail))
    return q.select("item_id", X.in_scope("text").alias("in_scope"), X.named_platform("text").alias("platform"))


@query("p8_p9_p13_parse", """SELECT event_id, CASE event_id % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE date_trunc('day', ts)::TIMESTAMP END AS day, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 3.5 ELSE 5.0 END::DOUBLE AS rating, props->>'k' AS k FROM events""")
def p8(spark, d):
    e = V.table(spark, d, "events")
    shown = F.element_at(F.array(F.date_format("ts", "yyyy-MM-dd"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 00:00:00")), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")), F.date_format("ts", "yyyy/MM/dd"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00")), F.lit("yesterday"), F.lit("2026-13-45")), (F.col("event_id") % 7 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ("nine", "0", "NaN", "-3", "3.5", "5"))), (F.col("event_id") % 6 + 1).cast("int"))
    e = e.withColumn("said", said).withColumn("shown", shown)
    return e.select("event_id", X.parse_time("shown").cast("timestamp_ntz").alias("day"), X.parse_rating("said").alias("rating"), F.get_json_object("props", "$.k").alias("k"))


@query("p24_word_root", """WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT w, CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN w[:-4] WHEN w LIKE '%tion' AND length(w) >= 7 THEN w[:-5] WHEN w LIKE '%ed' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%er' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%es' AND length(w) >= 5 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 4 THEN w[:-2] ELSE w END AS root FROM w""")
def p24(spark, d):
    w = V.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return w.select("w", X.word_root("w").alias("root"))


@query("f11_corpus_quality", R + f"SELECT count(*) AS n, count(*) FILTER (c > 15) AS build, count(*) FILTER (c > 5) AS training, count(*) FILTER (c >= 15) AS discovery FROM (SELECT length({CLEAN}) AS c FROM reviews WHERE text IS NOT NULL AND sentiment_label IS NOT NULL)")
def f11(spark, d):
    c = V.reviews(spark, d).dropna(subset=["text", "sentiment_label"]).select(F.length(X.clean_review("text")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("c") > 15).alias("build"), F.count_if(F.col("c") > 5).alias("training"), F.count_if(F.col("c") >= 15).alias("discovery"))


@query("f13_sentiment_gate", with_("results") + "SELECT feedback_id, run_id, label IN ('negative', 'neutral') AS gated_in, CASE WHEN label NOT IN ('negative', 'neutral') THEN 'sentiment ' || label END AS skipped FROM results")
def f13(spark, d):
    inside = F.col("label").isin("negative", "neutral")
    return V.results(spark, d).select("feedback_id", "run_id", inside.alias("gated_in"), F.when(~inside, F.concat(F.lit("sentiment "), F.col("label"))).alias("skipped"))
