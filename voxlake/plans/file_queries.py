"""Queries over files: the given tables written in a raw form into the warehouse, read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as N
from ..operators import features as T
from ..operators import ingest as I
from ..operators import vectors as VEC
from ..sources import files as S
from ..sources.scratch import fresh_path
from . import views as V
from .evaluation_queries import TOP, docs_vectors, question_vectors
from .registry import query
from .text_queries import KEYWORDS, sentiment_sql
from .tenant_queries import CLEAN
from .views import with_


def place(spark, name: str) -> str:
    return fresh_path(spark, f"files-{name}")


@query("s1_product_reviews", """SELECT platform, product_category, md5(text) AS h, rating, sentiment_label, date FROM (SELECT 'amazon' AS platform, 'home' AS product_category, trim(trim(source || '. ' || text, '. '), chr(10) || chr(9) || ' ') AS text, (1 + n_chars % 5)::DOUBLE AS rating,
CASE WHEN 1 + n_chars % 5 <= 2 THEN 'negative' WHEN 1 + n_chars % 5 = 3 THEN 'neutral' ELSE 'positive' END AS sentiment_label, CAST(CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS VARCHAR) AS date FROM documents WHERE length(text) > 10)""")
def s1(spark, d):
    docs, path = V.table(spark, d, "documents"), place(spark, "products")
    rows = docs.select(F.col("source").alias("title"), "text", (1 + F.col("n_chars") % 5).cast("double").alias("rating"), ((F.lit(19723) + F.col("doc_id") % 300) * 86_400_000).alias("timestamp"), F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("asin"))
    rows.write.option("compression", "gzip").json(path)
    r = I.standard_product_reviews(S.read_product_reviews(spark, path), "home")
    return r.select("platform", "product_category", F.md5("text").alias("h"), "rating", "sentiment_label", F.col("date").cast("string").alias("date"))


@query("s2_business_reviews", "SELECT doc_id::VARCHAR AS review_id, CASE WHEN doc_id % 4 = 0 THEN 3.0 ELSE 1 + doc_id % 5 END::DOUBLE AS rating, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2020-05-06' END AS date FROM documents WHERE length(text) >= 10")
def s2(spark, d):
    docs, path = V.table(spark, d, "documents"), place(spark, "business")
    i = F.col("doc_id")
    docs.select("text", F.when(i % 4 > 0, (1 + i % 5).cast("double")).alias("stars"), F.when(i % 7 == 0, "no date").otherwise("2020-05-06 10:11:12").alias("date"), i.cast("string").alias("review_id")).write.json(path)
    return I.standard_business_reviews(S.read_business_reviews(spark, path)).select("review_id", "rating", F.col("date").cast("string").alias("date"))


@query("s3_tweets", "SELECT doc_id::VARCHAR AS review_id, md5(text) AS h, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 ELSE 5.0 END::DOUBLE AS rating, '2015-02-24' AS date FROM documents")
def s3(spark, d):
    docs, path = V.table(spark, d, "documents"), place(spark, "tweets")
    i = F.col("doc_id")
    label = F.element_at(F.array(*map(F.lit, ("negative", "neutral", "positive"))), (i % 3 + 1).cast("int"))
    docs.select("text", label.alias("airline_sentiment"), F.lit("2015-02-24 11:35:52 -0800").alias("tweet_created"), i.cast("string").alias("tweet_id")).write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", S.NULL_CELL).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    r = I.standard_tweets(S.read_tweets(spark, path))
    return r.select("review_id", F.md5("text").alias("h"), "rating", F.col("date").cast("string").alias("date"))


@query("s4_s5_w16_p3_upload_file", """
WITH sent AS (
  SELECT event_id, event_id // 5000 AS part, CASE WHEN event_id % 7 = 0 THEN chr(10) ELSE '' END || event_type || CASE WHEN event_id % 5 = 0 THEN ' "x",' || chr(10) ELSE ' ' END || props AS text FROM events
), numbered AS (
  SELECT *, CAST(2 + coalesce(sum(1 + length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY part ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS source_row
  FROM sent
)
SELECT source_row, event_id::VARCHAR AS external_id, trim(text, ' ' || chr(10)) AS text, CASE WHEN event_id % 9 = 0 THEN 'rating' END AS field FROM numbered""")
def s4(spark, d):
    """Files of 5,000 records, of which some cells hold quotes, commas and line feeds: rows have the lines that they begin at."""
    e, path, i = V.table(spark, d, "events"), place(spark, "upload"), F.col("event_id")
    text = F.concat(F.when(i % 7 == 0, "\n").otherwise(""), "event_type", F.when(i % 5 == 0, ' "x",\n').otherwise(" "), "props")
    sent = e.select(F.floor(i / 5000).alias("part"), text.alias("Feedback"), i.cast("string").alias("Ticket_ID"), F.when(i % 9 == 0, "ten").otherwise("4").alias("Stars"), i.alias("nth"))
    dealt = sent.repartition("part").sortWithinPartitions("part", "nth").drop("nth")
    dealt.write.partitionBy("part").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows, extra = S.read_upload(spark, path)
    return I.validated(rows, extra=extra).select("source_row", "external_id", "text", F.col("error.field").alias("field"))


@query("s6_s7_corpus_files", with_("reviews") + f"SELECT platform, count(*) AS n, round(avg(rating), 4) AS rating FROM (SELECT *, {CLEAN} AS c FROM reviews) WHERE length(c) > 15 GROUP BY platform")
def s7(spark, d):
    from ..functions import text as X

    path = place(spark, "corpus")
    r = V.reviews(spark, d)
    S.write_corpus(r.where(F.length(X.clean_review("text")) > 15), path)
    return S.read_corpus(spark, path, "platform", "rating").groupBy("platform").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 4).alias("rating"))


@query("s8_s12_report_files", with_("reviews") + "SELECT platform, sentiment_label, count(*) AS n FROM reviews GROUP BY ALL")
def s8(spark, d):
    path = place(spark, "report")
    S.write_report(V.reviews(spark, d).groupBy("platform", "sentiment_label").agg(F.count("*").alias("n")), path, "csv")
    return S.read_report(spark, path, "platform string, sentiment_label string, n long", "csv")


@query("s9_keyword_files", "SELECT *, 2 AS filter_version FROM (" + KEYWORDS + "20)")
def s9(spark, d):
    path = place(spark, "keywords")
    S.write_keywords(T.keyword_counts(V.reviews(spark, d), 20), path)
    return S.read_keywords(spark, path)


@query("s10_feedback_store", with_("feedback") + "SELECT organisation_id, count(*) AS n, count(DISTINCT text) AS texts FROM feedback WHERE organisation_id = 2 GROUP BY 1")
def s10(spark, d):
    path = place(spark, "store")
    f = V.feedback(spark, d)
    for half in (0, 1):
        S.append_feedback(f.where(F.col("feedback_id") % 2 == half), path)
    return spark.read.parquet(path).where("organisation_id = 2").groupBy(F.col("organisation_id").cast("long").alias("organisation_id")).agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query("x5_item_evidence", TOP.format(k=4) + "SELECT query_id, doc_id, round(score, 6) AS score FROM t WHERE query_id <> doc_id AND score >= 0.35")
def x5(spark, d):
    """Evidence for items: they are the queries, in blocks, against all rows."""
    t = VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 4)
    return t.where((F.col("query_id") != F.col("doc_id")) & (F.col("score") >= 0.35)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


EVENT_LEXICON = (("error", -2.0), ("purchase", 1.5), ("signup", 0.1), ("click", -0.3))
FEED = with_("feedback") + ", src AS (SELECT feedback_id AS id, text FROM feedback{where}), " + sentiment_sql(EVENT_LEXICON)


@query("x6_analyse_import", FEED.replace("{where}", " WHERE organisation_id = 1 AND import_batch_id = 7") + """ SELECT 'import-7' AS run_id, count(*) AS item_count, count(*) FILTER (NOT contains(text, '"k": 3')) AS succeeded, count(*) FILTER (contains(text, '"k": 3')) AS failed,
count(*) AS stored_rows, count(*) FILTER (se.label = 'negative' AND NOT contains(text, '"k": 3')) AS negative FROM src JOIN se USING (id)""")
def x6(spark, d):
    """One import analysed as a stored run of models that get 50 texts at a time, one of which fails for some; read back from its stores."""
    path = place(spark, "import")
    score = N.sentiment_udf(N.failing_on(N.lexicon_model(dict(EVENT_LEXICON)), '"k": 3'), "lexicon-1")
    run = N.analyse_import(
        V.feedback(spark, d), f"{path}/results", f"{path}/runs", lambda rows: N.analyse(rows, score), organisation_id=1, import_batch_id=7, run_id="import-7", run_at="2026-01-01",
        versions={"sentiment": "lexicon-1"}, thresholds={"category": 0.35},
    )
    rows = spark.read.parquet(f"{path}/results").agg(F.count("*").alias("stored_rows"), F.count_if(F.col("label") == "negative").alias("negative"))
    return run.select("run_id", "item_count", "succeeded", "failed").join(F.broadcast(rows))


@query("a29_leaks", TOP.format(k=5) + "SELECT count(DISTINCT query_id) FILTER (query_id % 60 = 0 AND score >= 0.35 AND query_id <> doc_id) AS leaks, count(DISTINCT query_id) FILTER (query_id % 60 = 0) AS guarded FROM t")
def a29(spark, d):
    t = VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs_vectors(spark, d), 5)
    out = F.col("query_id") % 60 == 0
    return t.agg(F.countDistinct(F.when(out & (F.col("score") >= 0.35) & (F.col("query_id") != F.col("doc_id")), F.col("query_id"))).alias("leaks"), F.countDistinct(F.when(out, F.col("query_id"))).alias("guarded"))


@query("j13_search_side_by_side", TOP.format(k=3) + ", m AS (SELECT 'mean' AS metric, round(avg(score), 6) AS exact FROM t UNION ALL SELECT 'best', round(max(score), 6) FROM t), n AS (SELECT 'mean' AS metric, round(avg(score), 6) AS filtered FROM t WHERE dl <= 4 UNION ALL SELECT 'best', round(max(score), 6) FROM t WHERE dl <= 4) SELECT * FROM m JOIN n USING (metric)")
def j13(spark, d):
    """Two searches' summaries joined by the metric's name."""
    docs = docs_vectors(spark, d)
    t = VEC.top_k(question_vectors(spark, d).select("query_id", "vector"), docs, 3)
    few = t.join(docs.where("label <= 4").select("doc_id"), "doc_id", "left_semi")
    pair = lambda df, name: df.agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("best")).select(F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("best"), F.col("best"))).alias("metric", name))
    return pair(t, "exact").join(pair(few, "filtered"), "metric")
