"""The tables of a feedback product, derived from the driver's: as DataFrames, and as DuckDB CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import CATEGORIES


#: Ids of the retired default and of organisation 1's own categories; the renamed one is the seventh default.
RETIRED, RENAMED, RENAMED_ID, OWN_THEME = 14, 7, 101, 102
OTHER_CATEGORIES = [(RETIRED, "old_theme", "Old Theme", None, False), (RENAMED_ID, "billing_and_payments", "Invoices", 1, True), (OWN_THEME, "own_theme", "Our Theme", 1, True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    rating = (1 + F.col("n_chars") % 5).cast("double")
    return t.select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("platform"), F.col("lang").alias("product_category"), "text", rating.alias("rating"),
        X.rating_label(rating).alias("sentiment_label"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
    )


def feedback(spark, d) -> DataFrame:
    return feedback_of(table(spark, d, "events"))


def feedback_of(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    text = F.concat("event_type", F.lit(" "), "props", F.lit(" "), (i % 997).cast("string"))
    return e.select(
        i.alias("feedback_id"), (F.col("user_id") % 4).alias("organisation_id"), (i % 50).alias("import_batch_id"), text.alias("text"),
        F.when(i % 10 != 3, F.concat(F.lit("ext"), (i % 5000).cast("string"))).alias("external_id"), (1 + F.least(F.lit(4), F.floor(F.col("value") / 50))).cast("double").alias("rating"),
        F.when(i % 20 != 0, F.col("ts")).alias("feedback_at"), F.col("ts").alias("created_at"), F.col("event_type").alias("platform"),
        F.concat(F.lit('{"platform":"'), "event_type", F.lit('"}')).alias("metadata"),
    )


def results(spark, d) -> DataFrame:
    """Analysis results: none for a tenth of the feedback, a superseded one more for a seventh."""
    e, i = table(spark, d, "events").where("event_id % 10 <> 0"), F.col("event_id")
    rating = 1 + F.least(F.lit(4), F.floor(F.col("value") / 50))
    run = F.explode(F.when(i % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    keys = F.array(*[F.lit(k) for k, _ in CATEGORIES])
    e = e.select("*", run.alias("run_id"))
    nth, first = i % 14 + 1, F.col("user_id") % 4 == 1
    own_theme = first & (i % 28 == 12)
    category_id = F.when(own_theme, OWN_THEME).when(first & (nth == RENAMED), RENAMED_ID).when(nth <= len(CATEGORIES), nth)
    return e.select(
        i.alias("feedback_id"), (F.col("user_id") % 4).alias("organisation_id"), "run_id", (F.col("run_id") == 2).alias("is_current"),
        X.rating_label(F.when(F.col("run_id") == 1, 6 - rating).otherwise(rating)).alias("label"), F.when(own_theme, "own_theme").otherwise(F.try_element_at(keys, nth.cast("int"))).alias("category_key"), category_id.cast("long").alias("category_id"),
        F.round(F.col("value") / 500, 4).alias("confidence"), (i % 14 == 13).alias("is_unclassified"), F.when(i % 97 == 0, "failed").otherwise("ok").alias("status"),
    )


def categories(spark) -> DataFrame:
    """The 13 defaults, a retired key, and organisation 1's own: a default renamed, and a theme of its own."""
    rows = [(n, key, name, None, True) for n, (key, name) in enumerate(CATEGORIES, 1)] + OTHER_CATEGORIES
    return spark.createDataFrame(rows, "id long, key string, name string, organisation_id long, is_active boolean")


def jobs(spark, d) -> DataFrame:
    """One to three status events for each import batch."""
    b = table(spark, d, "events").select((F.col("event_id") % 50).alias("batch")).distinct()
    b = b.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("batch") % 3)))
    states = F.array(*map(F.lit, ("queued", "running", "succeeded", "failed")))
    return b.select(
        (F.col("batch") * 10 + F.col("n")).alias("id"), (F.col("batch") % 4).alias("organisation_id"), F.lit("analyse").alias("kind"), F.element_at(states, ((F.col("batch") + F.col("n")) % 4 + 1).cast("int")).alias("status"),
        F.col("n").alias("attempts"), F.lit(3).cast("long").alias("max_attempts"), F.timestamp_seconds(F.lit(1704067200) + 3600 * F.col("n")).cast("timestamp_ntz").alias("created_at"),
        F.concat(F.lit('{"import_batch_id":"'), F.col("batch").cast("string"), F.lit('"}')).alias("payload"),
    )


def facts(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "N", "neutral").otherwise("positive")
    return t.select("l_orderkey", (1 + F.col("l_quantity").cast("long") % 5).alias("rating"), label.alias("label"), F.col("l_shipdate").alias("happened_at"), F.col("l_linestatus").alias("platform"))


def predictions(spark, d) -> DataFrame:
    """Long predictions of three rule models with scores: review_id, platform, true_label, model, pred, compound, scores."""
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    truth = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    t = t.select(F.col("doc_id").alias("review_id"), F.col("source").alias("platform"), "n_chars", truth.alias("true_label"))
    t = t.withColumn("m", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(k).alias("k")) for n, k in (("length", 7), ("parity", 3), ("truthful", 0))])))
    c = (F.when(F.col("m.k") == 0, F.when(F.col("true_label") == "positive", 80).when(F.col("true_label") == "negative", -80).otherwise(0) + (F.col("review_id") * 37 % 101 - 50)).otherwise((F.col("n_chars") * F.col("m.k") + F.col("review_id")) % 201 - 100) / 130).alias("compound")
    t = t.select("review_id", "platform", "true_label", F.col("m.model").alias("model"), c)
    scores = F.create_map(F.lit("negative"), F.round((1 - F.col("compound")) / 3, 6), F.lit("neutral"), F.round((1 - F.abs("compound")) / 3 + 0.1, 6), F.lit("positive"), F.round((1 + F.col("compound")) / 3, 6))
    return t.withColumn("pred", X.banded("compound", 0.3)).withColumn("scores", scores)


_RATING = "(1 + least(4, CAST(floor(value / 50) AS BIGINT)))"
_LABEL = lambda r: f"CASE WHEN {r} <= 2 THEN 'negative' WHEN {r} = 3 THEN 'neutral' WHEN {r} IS NOT NULL THEN 'positive' END"
CTE = {
    "reviews": f"""reviews AS (SELECT doc_id AS review_id, source AS platform, lang AS product_category, text, (1 + n_chars % 5)::DOUBLE AS rating,
      {_LABEL("(1 + n_chars % 5)")} AS sentiment_label, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS date FROM documents)""",
    "feedback": f"""feedback AS (SELECT event_id AS feedback_id, user_id % 4 AS organisation_id, event_id % 50 AS import_batch_id, event_type || ' ' || props || ' ' || (event_id % 997) AS text,
      CASE WHEN event_id % 10 <> 3 THEN 'ext' || (event_id % 5000) END AS external_id, {_RATING}::DOUBLE AS rating, CASE WHEN event_id % 20 <> 0 THEN ts END AS feedback_at,
      ts AS created_at, event_type AS platform, '{{"platform":"' || event_type || '"}}' AS metadata FROM events)""",
    "results": f"""results AS (SELECT event_id AS feedback_id, user_id % 4 AS organisation_id, run_id, run_id = 2 AS is_current,
      {_LABEL(f"(CASE WHEN run_id = 1 THEN 6 - {_RATING} ELSE {_RATING} END)")} AS label,
      CASE WHEN user_id % 4 = 1 AND event_id % 28 = 12 THEN 'own_theme' ELSE ([{", ".join(f"'{k}'" for k, _ in CATEGORIES)}])[event_id % 14 + 1] END AS category_key,
      CASE WHEN user_id % 4 = 1 AND event_id % 28 = 12 THEN {OWN_THEME} WHEN user_id % 4 = 1 AND event_id % 14 + 1 = {RENAMED} THEN {RENAMED_ID}
        WHEN event_id % 14 < 13 THEN event_id % 14 + 1 END AS category_id, round(value / 500, 4) AS confidence, event_id % 14 = 13 AS is_unclassified,
      CASE WHEN event_id % 97 = 0 THEN 'failed' ELSE 'ok' END AS status
      FROM (SELECT *, unnest(CASE WHEN event_id % 7 = 0 THEN [1, 2] ELSE [2] END) AS run_id FROM events WHERE event_id % 10 <> 0))""",
    "categories": "categories AS (SELECT * FROM (VALUES "
    + ", ".join(f"({n}, '{k}', '{v}', NULL, true)" for n, (k, v) in enumerate(CATEGORIES, 1))
    + "".join(f", ({n}, '{k}', '{v}', {org or 'NULL'}, {str(on).lower()})" for n, k, v, org, on in OTHER_CATEGORIES)
    + ") AS t(id, key, name, organisation_id, is_active))",
    "jobs": """jobs AS (SELECT batch * 10 + n AS id, batch % 4 AS organisation_id, 'analyse' AS kind, (['queued', 'running', 'succeeded', 'failed'])[(batch + n) % 4 + 1] AS status, n AS attempts, 3 AS max_attempts,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(n AS INTEGER)) AS created_at, batch::VARCHAR AS import_id FROM (SELECT batch, unnest(range(1, batch % 3 + 2)) AS n FROM (SELECT DISTINCT event_id % 50 AS batch FROM events)))""",
    "facts": "facts AS (SELECT l_orderkey, 1 + CAST(l_quantity AS BIGINT) % 5 AS rating, CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'N' THEN 'neutral' ELSE 'positive' END AS label, l_shipdate AS happened_at, l_linestatus AS platform FROM lineitem)",
    "predictions": """predictions AS (SELECT *, CASE WHEN compound >= 0.3 THEN 'positive' WHEN compound <= -0.3 THEN 'negative' ELSE 'neutral' END AS pred,
      round((1 - compound) / 3, 6) AS s_neg, round((1 - abs(compound)) / 3 + 0.1, 6) AS s_neu, round((1 + compound) / 3, 6) AS s_pos
      FROM (SELECT doc_id AS review_id, source AS platform, true_label, model,
        (CASE WHEN k = 0 THEN CASE true_label WHEN 'positive' THEN 80 WHEN 'negative' THEN -80 ELSE 0 END + (doc_id * 37 % 101 - 50) ELSE (n_chars * k + doc_id) % 201 - 100 END) / 130::DOUBLE AS compound
        FROM (SELECT l.doc_id, d.source, d.n_chars, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS true_label FROM labels l JOIN documents d USING (doc_id)),
        (VALUES ('length', 7), ('parity', 3), ('truthful', 0)) AS m(model, k)))""",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names) + " "
