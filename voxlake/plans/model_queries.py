"""Queries over the composite analysis, the taxonomy, the classical models and the streams."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.tokenizers import Terms
from ..operators import analysis as N
from ..operators import models as M
from ..operators import sampling as S
from ..operators import taxonomy as Y
from ..operators import vectors as VEC
from ..streaming import jobs as J
from . import views as V
from ..sources.known import KnownStore
from ..sources.scratch import fresh_path, spread, stored
from .evaluation_queries import CEN, TOP, docs_vectors, mmr_sql
from .file_queries import EVENT_LEXICON, FEED
from .registry import query
from .text_queries import LEXICON, UPLOAD, known, sentiment_sql, upload_of
from .views import with_

R = with_("reviews")
#: The sentiment stage over all reviews.
SRC = R.rstrip() + ", src AS (SELECT review_id AS id, text FROM reviews), " + sentiment_sql()


def lexicon_score():
    return N.sentiment_udf(N.lexicon_model(dict(LEXICON)), "lexicon-1")


# analysis


@query("x2_k1_sentiment_stage", SRC + " SELECT id, label, confidence, 'lexicon-1' AS model_version, NULL::VARCHAR AS error FROM se")
def x2(spark, d):
    score = lexicon_score()
    r = V.reviews(spark, d).select(F.col("review_id").alias("id"), "text")
    return r.select("id", score("text").alias("s")).select("id", "s.label", "s.confidence", "s.model_version", "s.error")


def taxonomy_vectors(spark, d):
    """The label centroids stand for the categories' embeddings."""
    c = VEC.normalised(VEC.centroids(docs_vectors(spark, d), "label", "vector"), "centroid")
    return c.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("key"), F.col("centroid").alias("vector"))


CAT = CEN + ", n AS (SELECT label, list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c), s AS (SELECT x.vec_id AS id, 'c' || n.label AS key, list_dot_product(x.e, n.c) AS score FROM x, n), kk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, key) AS rank FROM s) "


@query("x3_w7_j10_categorise", CAT + "SELECT id, max(CASE WHEN score >= 0.35 THEN key END) FILTER (rank = 1) AS category_key, round(max(score) FILTER (rank = 1), 6) AS score, string_agg(key, ',' ORDER BY rank) FILTER (rank <= 3) AS candidates, max(score) < 0.35 AS is_unclassified FROM kk GROUP BY id")
def x3(spark, d):
    items = docs_vectors(spark, d).select(F.col("doc_id").alias("id"), "vector")
    c = N.categorise(items, taxonomy_vectors(spark, d))
    return c.select("id", "category_key", "score", F.array_join(F.transform("candidates", lambda x: x["key"]), ",").alias("candidates"), "is_unclassified")


KEPT = SRC + ", " + CAT[5:] + """, kc AS (SELECT id, max(key) FILTER (rank = 1) AS key, round(max(score), 6) AS score FROM kk GROUP BY id),
a AS (SELECT se.id, se.label, se.confidence, kc.key, kc.score, contains(src.text, '###') AS bad, CASE WHEN label = 'positive' THEN 'sentiment positive' WHEN kc.id IS NULL THEN 'no vector' END AS skipped FROM se JOIN src USING (id) LEFT JOIN kc ON kc.id = se.id) """
CATEGORY = "CASE WHEN score < 0.35 THEN 'Unclassified / Emerging Complaint' ELSE key END"


@query("x1_x4_x8_analyse", KEPT + f"""SELECT id, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status, CASE WHEN bad THEN 'ValueError: the text can''t be scored' END AS error, CASE WHEN NOT bad THEN label END AS label, CASE WHEN NOT bad THEN confidence END AS confidence,
CASE WHEN NOT bad AND skipped IS NULL THEN {CATEGORY} END AS category, CASE WHEN NOT bad AND skipped IS NULL THEN score END AS score, CASE WHEN NOT bad AND skipped IS NULL THEN score < 0.35 END AS is_unclassified, CASE WHEN bad THEN 'no sentiment' ELSE skipped END AS skipped FROM a""")
def x1(spark, d):
    """Every review: the model fails for some texts, whose rows stay as failed ones beside their neighbours."""
    score = N.sentiment_udf(N.failing_on(N.lexicon_model(dict(LEXICON)), "###"), "lexicon-1")
    r = V.reviews(spark, d).join(V.table(spark, d, "embeddings"), F.col("review_id") == F.col("vec_id"), "left")
    items = r.select(F.col("review_id").alias("id"), "text", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    out = N.analyse(items, score, taxonomy_vectors(spark, d), "vector")
    return out.select("id", "status", "error", "label", "confidence", "category", "score", "is_unclassified", "skipped")


@query("m7_batch_predictions", SRC + " SELECT id, CASE WHEN contains(src.text, '###') THEN 'error' ELSE label END AS pred, CASE WHEN NOT contains(src.text, '###') THEN confidence END AS confidence FROM se JOIN src USING (id)")
def m7(spark, d):
    score = N.sentiment_udf(N.failing_on(N.lexicon_model(dict(LEXICON)), "###"), "lexicon-1")
    return N.batch_predict(V.reviews(spark, d).select(F.col("review_id").alias("id"), "text"), score)


@query("k2_single_texts", SRC + " SELECT id, label FROM se")
def k2(spark, d):
    """A function over one text in the place of a batch model."""
    score = N.sentiment_udf(N.one_by_one(lambda t: N.lexicon_model(dict(LEXICON))()([t])[0]), "lexicon-1")
    return V.reviews(spark, d).select(F.col("review_id").alias("id"), score("text")["label"].alias("label"))


NAMES = ("the", "and", "la", "der", "el")


@query("k3_k5_batch_categoriser", SRC + ", cat AS (SELECT unnest(['" + "', '".join(NAMES) + "']) AS key), wt AS (SELECT id, regexp_extract_all(lower(regexp_replace(text, '\\s+', ' ', 'g')), '\\S+') AS ws FROM src), cs AS (SELECT id, key, round(len(list_filter(ws, lambda w: w = key)) / greatest(len(ws), 1)::DOUBLE, 6) AS score FROM wt, cat), cr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, key) AS rank FROM cs) SELECT id, CASE WHEN label <> 'positive' AND score >= 0.05 THEN key END AS category_key, CASE WHEN label <> 'positive' THEN score END AS score FROM se JOIN cr USING (id) WHERE rank = 1")
def k3(spark, d):
    """A categoriser of one's own, over batches of texts and a taxonomy of one's own: the share of the words that are the key."""

    def make():
        def run(texts, taxonomy):
            split = [t.lower().split() for t in texts]
            return [[(c["key"], w.count(c["key"]) / max(1, len(w))) for c in taxonomy] for w in split]

        return run

    own = spark.createDataFrame([(k, k.title()) for k in NAMES], "key string, name string")
    items = V.reviews(spark, d).select(F.col("review_id").alias("id"), "text")
    return N.analyse(items, lexicon_score(), own, categoriser=N.batch_categoriser(make, threshold=0.05)).select("id", "category_key", "score")


#: Scores have six decimals, and are shown with four, halves away from zero in decimals (as doubles 0.36265 would fall to 0.3626).
NEAR = SRC + ", " + TOP.format(k=4)[5:] + ", n AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM t WHERE query_id <> doc_id AND score >= 0.35), ev AS (SELECT query_id, string_agg(doc_id || ':' || round(score::DECIMAL(18, 6), 4)::DOUBLE, ',' ORDER BY r) AS found FROM n WHERE r <= 3 GROUP BY 1) "


@query("k4_x5_retriever", NEAR + "SELECT id, CASE WHEN vec_id IS NULL OR id % 100 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN id % 100 = 0 THEN 'the retriever gave no answer' WHEN vec_id IS NULL THEN 'no vector to search with' END AS error, CASE WHEN vec_id IS NOT NULL AND id % 100 <> 0 THEN coalesce(found, '') END AS found FROM se LEFT JOIN v ON vec_id = id LEFT JOIN ev ON query_id = id WHERE id % 20 = 0")
def k4(spark, d):
    """Evidence from the corpus for every twentieth review. Items without a vector, and those that the search leaves out, are failed."""
    items = V.reviews(spark, d).where("review_id % 20 = 0").join(docs_vectors(spark, d), F.col("review_id") == F.col("doc_id"), "left").select(F.col("review_id").alias("id"), "text", F.col("vector").cast("array<double>").alias("vector"))
    corpus = N.CorpusRetriever(docs_vectors(spark, d).select("doc_id", "vector"), 0.35, 3)
    out = N.analyse(items, lexicon_score(), vector="vector", retriever=lambda x: corpus(x).where("id % 100 <> 0"))
    show = F.array_join(F.transform("evidence", lambda e: F.concat(e["doc_id"].cast("string"), F.lit(":"), F.round(e["score"], 4).cast("string"))), ",")
    return out.select("id", "status", "error", show.alias("found"))


@query("k4_no_retriever", SRC + " SELECT id, 'ok' AS status, CAST(0 AS INTEGER) AS found FROM se")
def k4_none(spark, d):
    out = N.analyse(V.reviews(spark, d).select(F.col("review_id").alias("id"), "text"), lexicon_score(), retriever=N.no_retriever)
    return out.select("id", "status", F.size("evidence").alias("found"))


@query("x7_a35_run_row", SRC + """ SELECT 'run-1' AS run_id, count(*) AS item_count, count(*) AS succeeded, CAST(0 AS BIGINT) AS failed, '{"sentiment": "lexicon-1"}' AS versions, '{"category": 0.35}' AS thresholds, 'default' AS taxonomy_source FROM se""")
def x7(spark, d):
    a = N.analyse(V.reviews(spark, d).select(F.col("review_id").alias("id"), "text"), lexicon_score())
    return N.run_row(N.result_rows(a, organisation_id=1, run_id="run-1", run_at="2026-01-01"), {"sentiment": "lexicon-1"}, {"category": 0.35})


@query("x12_top_category_of_sample", CAT + "SELECT id, key AS category_key FROM kk WHERE rank = 1 AND score >= 0.35")
def x12(spark, d):
    items = docs_vectors(spark, d).select(F.col("doc_id").alias("id"), "vector")
    return N.categorise(items, taxonomy_vectors(spark, d)).where("category_key IS NOT NULL").select("id", "category_key")


@query("j8_resolve_categories", with_("categories") + ", c AS (SELECT * FROM categories), v AS (SELECT DISTINCT CASE event_id % 5 WHEN 0 THEN 'billing_and_payments' WHEN 1 THEN 'Invoices' WHEN 2 THEN '3' WHEN 3 THEN 'Service Quality' ELSE event_type END AS value FROM events), f AS (SELECT id, 0 AS rk, id::VARCHAR AS face, organisation_id FROM c UNION ALL SELECT id, 1, key, organisation_id FROM c UNION ALL SELECT id, 2, name, organisation_id FROM c) SELECT value, (SELECT id FROM f WHERE face = value AND (organisation_id IS NULL OR organisation_id = 1) ORDER BY rk, organisation_id IS NULL, id LIMIT 1)::VARCHAR AS category_id FROM v")
def j8(spark, d):
    c = V.categories(spark)
    i = F.col("event_id") % 5
    value = F.when(i == 0, "billing_and_payments").when(i == 1, "Invoices").when(i == 2, "3").when(i == 3, "Service Quality").otherwise(F.col("event_type"))
    found = N.resolve_categories(V.table(spark, d, "events").select(value.alias("value")), c, organisation_id=1)
    return found.withColumn("category_id", F.col("category_id").cast("string"))


# taxonomy


@query("tx1_least_topic_size", "SELECT source, count(*) AS n, CAST(greatest(30, least(300, floor(count(*) * 700 * 0.0015))) AS BIGINT) AS least FROM documents GROUP BY 1")
def tx1(spark, d):
    n = V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", "n", Y.least_topic_size(F.col("n") * 700).alias("least"))


@query("tx2_tx3_discover")
def tx2(spark, d):
    v = docs_vectors(spark, d).select("doc_id", "vector")
    return Y.discover(v, 12, 60, least_cosine=0.1).groupBy("topic").agg(F.count("*").alias("n"))


@query("tx2_density_topics", """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
), near AS (
  SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) <= 8
), core AS (
  SELECT a AS id FROM near GROUP BY a HAVING count(*) = 8 AND min(score) >= 0.5
), links AS (
  SELECT a, b FROM near WHERE score >= 0.5 AND a IN (FROM core) AND b IN (FROM core)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT id, id AS other FROM core UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), parts AS (
  SELECT id, min(other) AS label FROM reach GROUP BY id
), edge AS (
  SELECT a AS id, arg_max(b, (score, -b)) AS nearest FROM near WHERE score >= 0.5 AND a NOT IN (FROM core) AND b IN (FROM core) GROUP BY a
), placed AS (
  SELECT id, label, true AS core FROM parts UNION ALL SELECT edge.id, label, false FROM edge JOIN parts ON parts.id = nearest
), sized AS (
  SELECT *, count(*) OVER (PARTITION BY label) AS size FROM placed
)
SELECT v.id AS doc_id, coalesce(core, false) AS core, CASE WHEN size >= 5 THEN label ELSE -1 END AS topic FROM v LEFT JOIN sized USING (id)""")
def tx2_density(spark, d):
    return Y.density_topics(docs_vectors(spark, d))


@query("tx2_by_platform", "SELECT label % 3 AS platform, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def tx2_by_platform(spark, d):
    """Every platform's documents on their own, each row in one of its topics or none (-1)."""
    v = docs_vectors(spark, d).select("doc_id", "vector", (F.col("label") % 3).alias("platform"))
    found = Y.discover_by_platform(v, 6, wanted=3, least_cosine=0.1)
    return found.where("topic >= -1 AND topic < 6").groupBy("platform").agg(F.count("*").alias("n"))


@query("tx10_taxonomy_files", "WITH t AS (SELECT source, lang, count(*) AS count FROM documents GROUP BY ALL) SELECT upper(lang) AS name, CAST(sum(count) AS BIGINT) AS count, string_agg(source, ',' ORDER BY source) AS merged_from FROM t GROUP BY lang")
def tx10(spark, d):
    """A discovered taxonomy and what it was merged from, written and read back."""
    t = V.table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("count"))
    clusters, members = t.groupBy(F.upper("lang").alias("name")).agg(F.sum("count").alias("count")), t.select(F.upper("lang").alias("cluster"), "source")
    path = fresh_path(spark, "taxonomy")
    Y.write_taxonomy(clusters, members, path)
    taxonomy, merged = Y.read_taxonomy(spark, path, clusters.schema, members.schema)
    merged = merged.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("merged_from"))
    return taxonomy.join(merged, taxonomy["name"].eqNullSafe(merged["cluster"])).select("name", "count", "merged_from")


KW = f"WITH w AS (SELECT source, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents), t AS (SELECT source, unnest(w) AS term FROM w UNION ALL SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w), tf AS (SELECT source, term, count(*) AS tf FROM t WHERE NOT regexp_matches(term, '(^| )(the|of|and)( |$)') GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1 HAVING sum(tf) >= 2), s AS (SELECT source, term, round(tf * ln(1 + (SELECT sum(tf)::DOUBLE / count(DISTINCT source) FROM tf) / f::DOUBLE), 6) AS weight FROM tf JOIN f USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM s QUALIFY rank <= 10) "


def keywords(spark, d):
    return Y.topic_keywords(V.table(spark, d, "documents"), "source", stop_words=["the", "of", "and"])


@query("tx4_topic_keywords", KW + "SELECT source, term, rank FROM k")
def tx4(spark, d):
    return keywords(spark, d).select("source", "term", F.col("rank").cast("long").alias("rank"))


@query("k7_topic_tokeniser", KW + "SELECT source, term, rank FROM k")
def k7(spark, d):
    kw = Y.topic_keywords(V.table(spark, d, "documents"), "source", stop_words=["the", "of", "and"], tokenizer=Terms)
    return kw.select("source", "term", F.col("rank").cast("long").alias("rank"))


def topics(spark, d):
    kw = keywords(spark, d).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    n = V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("count"))
    t = kw.join(n, "source").withColumn("topic", F.regexp_extract("source", r"(\d+)", 1).cast("long"))
    v = VEC.centroids(docs_vectors(spark, d).withColumn("topic", (F.col("doc_id") % 20)), "topic", "vector")
    t = t.join(v, "topic")
    return t.select("topic", F.concat(F.lit("p"), (F.col("topic") % 3).cast("string")).alias("platform"), "keywords", "count", F.array("source", F.lit("shared")).alias("example_docs"), "centroid")


TOPICS = KW + ", tp AS (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS topic, list(term ORDER BY rank) AS kws FROM k GROUP BY source HAVING topic IN (SELECT vec_id % 20 FROM embeddings))"


@query("tx5_drop_noise", TOPICS + """, u AS (SELECT topic, lower(unnest(kws)) AS kw FROM tp), nz AS (SELECT kw AS w FROM u GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM tp) * 0.5), h AS (SELECT topic, count(*) AS size, count(*) FILTER (EXISTS (SELECT 1 FROM nz WHERE contains(kw, w))) AS held FROM u GROUP BY 1),
p AS (SELECT topic, word, count(*) AS c FROM (SELECT topic, unnest(string_split(kw, ' ')) AS word FROM u) WHERE length(word) > 2 GROUP BY ALL), m AS (SELECT topic, arg_max(word, (c, word)) AS word, max(c) AS c FROM p GROUP BY 1)
SELECT tp.topic, array_to_string(kws, '|') AS keywords FROM tp JOIN h USING (topic) LEFT JOIN m USING (topic) WHERE (SELECT count(*) FROM tp) < 3 OR held < 0.6 * greatest(size, 1) AND coalesce(m.c < 0.7 * size OR m.word NOT IN (SELECT w FROM nz), true)""")
def tx5(spark, d):
    return Y.drop_noise(stored(topics(spark, d))).select("topic", F.array_join("keywords", "|").alias("keywords"))


@query("tx6_p24_labels")
def tx6(spark, d):
    return stored(topics(spark, d)).select("topic", Y.clean_label("keywords", ["the", "of", "and", "to", "is"]).alias("label"))


@query("tx7_merge_topics")
def tx7(spark, d):
    return Y.merge_topics(stored(topics(spark, d).select("topic", "centroid")), 6)


@query("tx8_merged_clusters")
def tx8(spark, d):
    t = stored(topics(spark, d))
    m = Y.merged_clusters(t, Y.merge_topics(t.select("topic", "centroid"), 6))
    return m.select("cluster", "count", F.array_join("platforms", ",").alias("platforms"), F.array_join(F.transform("source_topics", lambda x: x.cast("string")), ",").alias("topics"), F.array_join("keywords", "|").alias("keywords"), F.array_join("example_docs", ",").alias("docs"))


NAMED = "WITH t AS (SELECT source, lang, count(*) AS count FROM documents GROUP BY ALL) "


@query("tx9_u4_merge_same_names", NAMED + "SELECT upper(lang) AS name, CAST(sum(count) AS BIGINT) AS count, string_agg(source, ',' ORDER BY -count, upper(lang), source) AS k FROM (SELECT * FROM t) GROUP BY lang")
def tx9(spark, d):
    t = V.table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("count"))
    c = t.select(F.upper("lang").alias("name"), "count", F.array("source").alias("keywords"), F.array("source").alias("exemplars"), F.array(F.lit("p")).alias("platforms"))
    m = Y.merge_same_names(c, 100, 5)
    return m.select("name", "count", F.array_join("keywords", ",").alias("k"))


@query("a17_discovery_stats", "WITH t AS (SELECT lang AS platform, source, count(*) AS count FROM documents GROUP BY ALL), m AS (SELECT source, sum(count) AS count FROM t GROUP BY 1) SELECT platform, count(*) AS topics, CAST(sum(count) AS BIGINT) AS docs, min(count) AS smallest FROM t GROUP BY 1 UNION ALL SELECT 'merged', count(*), CAST(sum(count) AS BIGINT), CAST(min(count) AS BIGINT) FROM m")
def a17(spark, d):
    t = V.table(spark, d, "documents").groupBy(F.col("lang").alias("platform"), "source").agg(F.count("*").alias("count"))
    return Y.discovery_stats(t, t.groupBy("source").agg(F.sum("count").alias("count")))


DIM = "WITH c AS (SELECT DISTINCT source AS key, upper(source) AS name, 'old' AS description, source <> 'src3' AS is_active FROM documents), i AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN source END AS key, 'New ' || lang AS name FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'), n AS (SELECT DISTINCT coalesce(key, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_')) AS key, name FROM i) "


def dimension(spark, d):
    docs = V.table(spark, d, "documents")
    c = docs.select(F.col("source").alias("key"), F.upper("source").alias("name"), F.lit("old").alias("description"), (F.col("source") != "src3").alias("is_active")).distinct()
    i = docs.where("source IN ('src1', 'src2') AND lang = 'en'").select(F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("key"), F.concat(F.lit("New "), F.col("lang")).alias("name"), F.lit(None).cast("string").alias("description")).distinct()
    i = i.withColumn("key", F.coalesce("key", Y.category_key("name"))).distinct()
    return c, i


@query("tx11_upsert", DIM + "SELECT coalesce(c.key, n.key) AS key, coalesce(n.name, c.name) AS name, c.description, coalesce(is_active, true) AS is_active FROM c FULL JOIN n ON c.key = n.key")
def tx11(spark, d):
    return Y.upsert(*dimension(spark, d))


@query("tx12_retire", DIM + "SELECT key, name, is_active AND key NOT IN ('src1', 'src7') AS is_active FROM c")
def tx12(spark, d):
    c, _ = dimension(spark, d)
    gone = V.table(spark, d, "documents").where("source IN ('src1', 'src7')").select(F.col("source").alias("key")).distinct()
    return Y.retire(c, gone).select("key", "name", "is_active")


@query("tx11_violations", "WITH x AS (SELECT source AS key, CASE WHEN lang = 'de' THEN ' ' ELSE lang END AS name FROM documents), g AS (SELECT key, count(*) AS n, count(*) FILTER (trim(name) = '') AS blank FROM x GROUP BY 1) SELECT * FROM g WHERE n > 1 OR blank > 0 OR trim(key) = ''")
def tx11_violations(spark, d):
    return Y.violations(V.table(spark, d, "documents").select(F.col("source").alias("key"), F.when(F.col("lang") == "de", " ").otherwise(F.col("lang")).alias("name")))


@query("u6_unused_categories", with_("results", "categories") + "SELECT DISTINCT key FROM categories c WHERE organisation_id IS NULL AND key NOT IN (SELECT category_key FROM results WHERE category_key IS NOT NULL AND label = 'neutral')")
def u6(spark, d):
    used = V.results(spark, d).where("label = 'neutral'").select(F.col("category_key").alias("key")).distinct()
    return V.categories(spark).where("organisation_id IS NULL").select("key").distinct().join(used, "key", "left_anti")


@query("p23_target_text", "SELECT source, 'Reviews of ' || source || ' ' || string_agg(lang, '; ' ORDER BY lang) AS target FROM (SELECT source, lang FROM (SELECT DISTINCT source, lang FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang) <= 3) GROUP BY source")
def p23(spark, d):
    c = V.table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("exemplars"))
    return c.withColumn("description", F.concat(F.lit("Reviews of "), F.col("source"))).select("source", Y.target_text("description", "exemplars").alias("target"))


# classical models: the language stands for the label, so that there is something to learn


def texts_with_labels(spark, d):
    label = F.when(F.col("lang") == "en", "negative").when(F.col("lang") == "fr", "neutral").otherwise("positive")
    return V.table(spark, d, "documents").select("doc_id", "text", label.alias("sentiment_label"))


def labelled(spark, d):
    return M.prepared(texts_with_labels(spark, d)).drop("text")


@query("m1_t1_prepared", "SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END::DOUBLE AS label FROM documents")
def m1(spark, d):
    label = F.when(F.col("lang") == "en", "negative").when(F.col("lang") == "fr", "neutral").otherwise("positive")
    return V.table(spark, d, "documents").select("doc_id", label.alias("sentiment_label")).select("doc_id", M.encode("sentiment_label").alias("label"))


def parted(spark, d, folds: int):
    """The train rows with their folds and features, and the test rows with features: the vocabulary is the train rows'."""
    dealt = S.split(spread(texts_with_labels(spark, d)), {"train": 0.8, "test": 0.2}, "doc_id", "sentiment_label")
    train, test = (dealt.where(F.col("split") == x).drop("split") for x in ("train", "test"))
    # texts are read again for each step: their terms, which are several times as large, are neither shuffled nor stored
    train, test = (M.prepared(rows).drop("text") for rows in (S.folds(train, folds, "doc_id", "sentiment_label"), test))
    steps = M.features(train)
    return stored(M.featured(train, steps)), stored(M.featured(test, steps))


def judged(scored, value):
    from ..operators.evaluation import overall

    seen = stored(scored.select(F.col("sentiment_label").alias("true_label"), M.decode("prediction").alias("pred"), F.array_max(vector_to_array("rawPrediction")).alias("joint")))
    joint = seen.agg(F.round(F.avg("joint"), 4).alias("mean_joint"))
    return overall(seen).select("n", "accuracy", "macro_f1").withColumn("value", F.lit(value)).join(joint)


@query("m2_m6_logistic_regression")
def m2(spark, d):
    train, test = parted(spark, d, 3)
    c, _ = M.tuned(train, "lr")
    return judged(M.logistic_regression(c, train.count()).fit(M.gathered(train)).transform(test), c).drop("mean_joint")


#: Multinomial Naive Bayes over T3 weights as sums. ``g`` names a part left out of training: a fold, or -1 (the test rows).
BAYES = """
WITH labelled AS (
  SELECT doc_id AS doc, CASE lang WHEN 'en' THEN 'negative' WHEN 'fr' THEN 'neutral' ELSE 'positive' END AS label FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc), doc) AS k, count(*) OVER (PARTITION BY label) AS n FROM labelled
), train AS (
  SELECT doc, label, CAST(ntile({folds}) OVER (PARTITION BY label ORDER BY md5('fold:42:' || doc), doc) - 1 AS INTEGER) AS g
  FROM ranked WHERE k <= floor(n * {train}::DOUBLE + 0.5)
), parts AS (
  SELECT * FROM train UNION ALL SELECT doc, label, -1 FROM ranked WHERE {test}
), words AS (
  SELECT doc_id AS doc, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents
), tf AS (
  SELECT doc, term, 1 + ln(count(*)) AS tf, count(*) AS n FROM (
    SELECT doc, unnest(w) AS term FROM words UNION ALL SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  ) GROUP BY ALL
), vocabulary AS (
  SELECT term, count(*) AS df FROM tf SEMI JOIN train USING (doc) GROUP BY term HAVING count(*) >= 2 ORDER BY sum(n) DESC, term LIMIT 50000
), raw AS (
  SELECT doc, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM train)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN vocabulary USING (term)
), weights AS (
  SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM raw
), alphas AS (
  SELECT unnest([{alphas}])::DOUBLE AS alpha
), runs AS (
  SELECT DISTINCT g FROM parts
), class_sums AS (
  SELECT r.g, t.label, term, sum(w) AS s FROM runs r JOIN train t ON t.g <> r.g JOIN weights USING (doc) GROUP BY ALL
), class_totals AS (
  SELECT g, label, sum(s) AS total FROM class_sums GROUP BY ALL
), class_sizes AS (
  SELECT *, sum(n) OVER (PARTITION BY g) AS n_all, count(*) OVER (PARTITION BY g) AS n_labels
  FROM (SELECT r.g, t.label, count(*) AS n FROM runs r JOIN train t ON t.g <> r.g GROUP BY r.g, t.label)
), cells AS (
  SELECT p.g, p.doc, p.label AS truth, c.label, alpha, sum(w * ln(coalesce(s, 0) + alpha)) AS gain, sum(w) AS mass
  FROM parts p JOIN weights USING (doc) JOIN class_totals c ON c.g = p.g CROSS JOIN alphas
  LEFT JOIN class_sums x ON x.g = p.g AND x.label = c.label AND x.term = weights.term GROUP BY ALL
), scores AS (
  SELECT l.g, l.doc, l.truth, z.label, a.alpha,
    ln(z.n + a.alpha) - ln(z.n_all + z.n_labels * a.alpha) + coalesce(gain, 0) - coalesce(mass, 0) * ln(total + a.alpha * (SELECT count(*) FROM vocabulary)) AS joint
  FROM (SELECT g, doc, label AS truth FROM parts) l JOIN class_sizes z ON z.g = l.g JOIN class_totals t ON t.g = z.g AND t.label = z.label CROSS JOIN alphas a
  LEFT JOIN cells c ON c.g = l.g AND c.doc = l.doc AND c.label = z.label AND c.alpha = a.alpha
), predicted AS (
  SELECT g, alpha, doc, truth, label AS pred, joint FROM scores QUALIFY row_number() OVER (PARTITION BY g, alpha, doc ORDER BY joint DESC, label) = 1
), by_class AS (
  SELECT g, alpha, label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth = label) AS support, count(*) FILTER (pred = label) AS found
  FROM predicted, (VALUES ('negative'), ('neutral'), ('positive')) AS l(label) GROUP BY ALL
), judged AS (
  SELECT g, alpha, CAST(sum(support) AS BIGINT) AS n, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy, round(avg(2.0 * tp / (support + found)), 6) AS macro_f1
  FROM by_class WHERE support + found > 0 GROUP BY ALL
)
"""


def bayes_sql(folds: int, alphas, train: str = "0.8", test: str = "k > floor(n * 0.8::DOUBLE + 0.5)") -> str:
    values = {"folds": folds, "alphas": ", ".join(map(str, alphas)), "train": train, "test": test}
    return reduce(lambda sql, name: sql.replace("{" + name + "}", str(values[name])), values, BAYES)


@query("m3_m6_naive_bayes", bayes_sql(3, M.ALPHA_GRID) + """, best AS (
  SELECT alpha FROM judged WHERE g >= 0 GROUP BY alpha ORDER BY round(avg(macro_f1), 12) DESC, alpha LIMIT 1
)
SELECT n, accuracy, macro_f1, alpha AS value, (SELECT round(avg(joint), 4) FROM predicted p WHERE p.g = -1 AND p.alpha = best.alpha) AS mean_joint
FROM judged JOIN best USING (alpha) WHERE g = -1""")
def m3(spark, d):
    train, test = parted(spark, d, 3)
    means = M.class_means(train)
    alpha, _ = M.tuned(train, "nb", means=means)
    return judged(M.fitted(train, [("nb", alpha, None)], means)[0].transform(test), alpha)


@query("m4_w14_cross_validation")
def m4(spark, d):
    """Both classifiers at their tuned values, over five folds of the train rows and one vocabulary."""
    train, _ = parted(spark, d, 5)
    tuning = stored(S.folds(train.drop("fold"), 3, "doc_id", "sentiment_label", "tune"))
    best = {"lr": M.tuned(tuning, "lr")[0], "nb": M.tuned(tuning, "nb", means=M.class_means(tuning))[0]}
    return M.fold_summary(M.cross_validated(train, best, 5, means=M.class_means(train)))


@query("m4_naive_bayes_folds", bayes_sql(5, [0.1]) + "SELECT 'nb' AS model, g AS fold, macro_f1 FROM judged WHERE g >= 0")
def m4_nb(spark, d):
    train = parted(spark, d, 5)[0]
    return M.cross_validated(train, {"nb": 0.1}, 5, means=M.class_means(train))


@query("m5_model_files", bayes_sql(5, [0.1], "1.0", "true") + """
SELECT pred, count(*) AS n, CAST(0 AS BIGINT) AS different, round(avg(joint), 4) AS mean_joint FROM predicted WHERE g = -1 GROUP BY pred""")
def m5(spark, d):
    """A fitted model written, read back and used: no row is scored otherwise, and the rows are scored as the sums say."""
    rows = stored(labelled(spark, d))
    model, path = M.fit(rows, M.naive_bayes(0.1)), fresh_path(spark, "model")
    M.save(model, path)
    one, two = (M.score(m, rows).select("doc_id", "pred", "confidence", F.map_entries("scores").alias("scores")) for m in (model, M.load(path)))
    two = two.select(F.col("doc_id").alias("id"), F.struct("pred", "confidence", "scores").alias("again"))
    joint = M.load(path).transform(rows).select(F.col("doc_id").alias("key"), F.array_max(vector_to_array("rawPrediction")).alias("joint"))
    both = one.join(two, F.col("doc_id") == F.col("id")).join(joint, F.col("doc_id") == F.col("key"))
    same = F.struct("pred", "confidence", "scores") == F.col("again")
    return both.groupBy("pred").agg(F.count("*").alias("n"), F.count_if(~same).alias("different"), F.round(F.avg("joint"), 4).alias("mean_joint"))


# streams over the events table, each held against its batch form


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    path, name = f"{d}/events.parquet", None
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm).isFile():
        path, name = d, "events.parquet"
    rows = spark.readStream.schema(schema)
    return (rows.option("pathGlobFilter", name) if name else rows).parquet(path)


def fresh(prefix: str) -> str:
    return re.sub(r"\W", "_", f"{prefix}_{uuid.uuid4().hex}")


DAY = 86_400
#: How events arrive: three groups in order of time, then a fiftieth of them again out of order, of which some are days too late.
ARRIVAL = f"""edges AS (
  SELECT lo, hi, lo + (hi - lo) * 6 // 10 AS t1, lo + (hi - lo) * 9 // 10 AS t2
  FROM (SELECT CAST(floor(min(epoch(ts))) AS BIGINT) AS lo, CAST(floor(max(epoch(ts))) AS BIGINT) AS hi FROM events)
), arrived AS (
  SELECT events.*, event_id % 50 = 0 AND epoch(ts) < t1 - 5 * {DAY} AS too_late FROM events, edges
)"""


def arrivals(spark, d):
    """The events with ``arrival`` from 1 to 4, as ARRIVAL says."""
    e, s = V.table(spark, d, "events"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    lo, hi = e.agg(F.min(s), F.max(s)).first()
    t1, t2 = lo + (hi - lo) * 6 // 10, lo + (hi - lo) * 9 // 10
    again = (F.col("event_id") % 50 == 0) & ((s < t1 - 5 * DAY) | (s > hi - DAY // 2))
    return e.withColumn("arrival", F.when(again, 4).when(s < t1, 1).when(s < t2, 2).otherwise(3))


def updated(spark, d, make, keys):
    """A stream in update mode over events that arrive in four groups, each read by a run of its own from the checkpoint:
    what its readers see at the end, and the lateness."""
    e, path = stored(arrivals(spark, d)), fresh_path(spark, "updates")
    e.where("false").drop("arrival").write.parquet(f"{path}-in")  # a stream's folder has to be there
    rows = spark.readStream.schema(e.drop("arrival").schema).parquet(f"{path}-in")
    for n in range(1, 5):
        e.where(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(f"{path}-in")
        J.merged(make(rows), path)
    out = J.served(spark, path, make(rows).schema, keys)
    return out, J.lateness(spark.read.parquet(f"{path}-in"), "ts", out)


def labelled_events(rows):
    i = F.col("event_id") % 3
    return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.when(i == 0, "negative").when(i == 1, "neutral").otherwise("positive").alias("label"))


LIVE = "WITH " + ARRIVAL + """, live AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS negative, count(*) FILTER (event_id % 3 = 1) AS neutral,
    count(*) FILTER (event_id % 3 = 2) AS positive
  FROM arrived WHERE NOT too_late GROUP BY 1
)
"""


@query("st4_live_trend", LIVE + "SELECT *, (SELECT count(*) FROM arrived WHERE too_late) AS late FROM live")
def st4(spark, d):
    out, late = updated(spark, d, lambda rows: J.live_trend(labelled_events(rows), "ts"), ["period"])
    return out.withColumn("period", F.col("period").cast("timestamp_ntz")).join(late.select("late"))


@query("st4_month_roll_up", LIVE + "SELECT date_trunc('month', period)::TIMESTAMP AS month, CAST(sum(n) AS BIGINT) AS n, CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(neutral) AS BIGINT) AS neutral, CAST(sum(positive) AS BIGINT) AS positive FROM live GROUP BY 1")
def st4_month(spark, d):
    days, _ = updated(spark, d, lambda rows: J.live_trend(labelled_events(rows), "ts"), ["period"])
    return J.month_roll_up(days).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("st2_distinct_feedback", "SELECT organisation_id, sha256(text) AS content_hash FROM (SELECT user_id % 4 AS organisation_id, event_type || ' ' || (event_id % 40) AS text FROM events) GROUP BY ALL")
def st2(spark, d):
    rows = event_stream(spark, d).select((F.col("user_id") % 4).alias("organisation_id"), F.concat("event_type", F.lit(" "), (F.col("event_id") % 40).cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("ts"))
    return J.drained(J.distinct_feedback(rows, "ts", "400 days"), fresh_path(spark, "distinct")).select("organisation_id", "content_hash")


STATES = "WITH " + ARRIVAL + """, e AS (
  SELECT event_id AS id, user_id % 4 AS organisation_id, (event_id % 30)::VARCHAR AS import_id, (['queued', 'running', 'succeeded', 'failed'])[event_id % 4 + 1] AS status, event_id % 4 AS attempts, ts AS created_at
  FROM arrived WHERE NOT too_late
), n AS (
  SELECT *, count(*) OVER (PARTITION BY organisation_id, import_id) AS n FROM e QUALIFY row_number() OVER (PARTITION BY organisation_id, import_id ORDER BY created_at DESC, id DESC) = 1
)
SELECT organisation_id, import_id, n, status, CASE WHEN status IN ('queued', 'running') OR (status = 'failed' AND attempts < 3) THEN 'pending' WHEN status = 'failed' THEN 'failed' ELSE 'done' END AS state,
  (SELECT count(*) FROM arrived WHERE too_late) AS late
FROM n"""


def status_events(rows):
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed"))), (i % 4 + 1).cast("int")).alias("status")
    payload = F.concat(F.lit('{"import_batch_id":"'), (i % 30).cast("string"), F.lit('"}')).alias("payload")
    return rows.select(i.alias("id"), (F.col("user_id") % 4).alias("organisation_id"), status, (i % 4).alias("attempts"), F.lit(3).cast("long").alias("max_attempts"), F.col("ts").cast("timestamp").alias("created_at"), payload)


@query("st5_import_states", STATES)
def st5(spark, d):
    out, late = updated(spark, d, lambda rows: J.import_state_changes(status_events(rows)), J.STATE_KEYS)
    return J.newest_states(out).select("organisation_id", "import_id", "n", "status", "state").join(late.select("late"))


@query("st3_analysis_stream", FEED.replace("{where}", "") + " SELECT id, label, confidence FROM se")
def st3(spark, d):
    """New feedback analysed as a stream, its results appended to a store."""
    score = N.sentiment_udf(N.lexicon_model(dict(EVENT_LEXICON)), "lexicon-1")
    rows, store = V.feedback_of(event_stream(spark, d)).select(F.col("feedback_id").alias("id"), "text"), fresh_path(spark, "results")
    J.analysis_stream(rows, lambda x: N.analyse(x, score), lambda x: x.write.mode("append").parquet(store), f"{store}-checkpoint").awaitTermination()
    return spark.read.parquet(store).select("id", "label", "confidence")


#: The default embedding from its definition: each word's crc32 (over its bytes) names a place and a sign.
@query("v1_embed", """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM documents
), coded AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)
), hashed AS (
  SELECT word, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda p: CAST('0x' || substr(x, CAST(2 * p + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS h
  FROM coded, crc_table
), sums AS (
  SELECT doc_id, h % 64 AS pos, CAST(sum(CASE WHEN h & 65536 > 0 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM words JOIN hashed USING (word) GROUP BY ALL
), lengths AS (
  SELECT doc_id, sqrt(sum(x * x)) AS length, sum((pos + 1) * x) AS mix FROM sums GROUP BY 1
)
SELECT doc_id, CASE WHEN coalesce(length, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length, CAST(64 AS BIGINT) AS dims, round(coalesce(CASE WHEN length > 0 THEN mix / length END, 0.0), 6) AS mix
FROM documents LEFT JOIN lengths USING (doc_id)""")
def v1(spark, d):
    e = VEC.embed(V.table(spark, d, "documents"), "doc_id")
    mix = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("doc_id", F.round(VEC.norm("vector"), 6).alias("length"), F.size("vector").cast("long").alias("dims"), F.round(mix, 6).alias("mix"))


@query("v8_approximate_neighbours")
def v8(spark, d):
    x = docs_vectors(spark, d).select("doc_id", "vector")
    return VEC.approximate_neighbours(x.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), x, 5, 1.2).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: Reviews that have a vector, a third of them of one platform that questions can name; every twentieth is a question.
CORPUS = R.rstrip() + ", v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT reviews.* REPLACE (CASE WHEN review_id % 3 = 0 THEN 'amazon' ELSE platform END AS platform), e FROM reviews JOIN v ON vec_id = review_id), q AS (SELECT review_id AS query_id, e, substr(text, 1, 200) || CASE review_id % 3 WHEN 0 THEN ' any joke?' WHEN 1 THEN ' on Amazon' ELSE '' END AS text FROM r WHERE review_id % 20 = 0), "


def corpus_with_vectors(spark, d):
    r = V.reviews(spark, d).withColumn("platform", F.when(F.col("review_id") % 3 == 0, "amazon").otherwise(F.col("platform")))
    e = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return r.join(e, F.col("review_id") == F.col("doc_id")).drop("review_id")


def asked(spark, d):
    """Questions: the beginnings of every twentieth review, some of which name a platform or aren't in scope."""
    i = F.col("doc_id") % 3
    tail = F.when(i == 0, " any joke?").when(i == 1, " on Amazon").otherwise("")
    return corpus_with_vectors(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.concat(F.substring("text", 1, 200), tail).alias("text"), "vector")


SCORED = CORPUS + "s AS (SELECT query_id, review_id AS doc_id, list_dot_product(q.e, r.e) AS score, r.e AS e, r.platform FROM q, r), "
LINE = "'[Source: ' || coalesce(r.platform, 'unknown') || ' | Rating: ' || coalesce(rating::VARCHAR, 'N/A') || ' | Sentiment: ' || coalesce(sentiment_label, 'unknown') || ' | Id: ' || review_id || ']' || chr(10) || r.text"


@query("v9_p20_answer_table", SCORED + """qq AS (SELECT *, NOT regexp_matches(text, '(?i)\\b(weather|politics|sports|recipe|coding|write code|poem|story|joke)\\b') AS in_scope, CASE WHEN contains(lower(text), 'amazon') THEN 'amazon' WHEN contains(lower(text), 'yelp') THEN 'yelp' WHEN contains(lower(text), 'twitter') OR contains(lower(text), 'airline') THEN 'twitter_airline' END AS named FROM q),
cand AS (SELECT s.query_id, doc_id, score, s.e FROM s JOIN qq USING (query_id) WHERE in_scope AND (named IS NULL OR named = s.platform) QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, doc_id) <= CASE WHEN named IS NULL THEN 20 ELSE 50 END), """ + mmr_sql() + f""",
b AS (SELECT query_id, count(*) AS kept, md5(string_agg({LINE}, chr(10) || chr(10) ORDER BY pick)) AS evidence FROM mmr JOIN r ON r.review_id = mmr.doc_id WHERE score >= 0.35 GROUP BY 1)
SELECT query_id, in_scope, named AS platform, coalesce(kept, 0) AS kept, evidence, CASE WHEN NOT in_scope THEN 'refused_out_of_scope' WHEN coalesce(kept, 0) = 0 THEN 'refused_no_evidence' ELSE 'answered' END AS outcome FROM qq LEFT JOIN b USING (query_id)""")
def v9(spark, d):
    return VEC.answer_table(asked(spark, d), corpus_with_vectors(spark, d), 0.35).withColumn("evidence", F.md5("evidence"))


CUT = "CASE WHEN length(r.text) > {n} THEN substr(r.text, 1, {n}) || '…' ELSE r.text END"


@query("v7_v10_evidence_rows", SCORED + f"t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5) SELECT query_id, doc_id::VARCHAR AS id, md5({CUT.format(n=1000)}) AS text, md5({CUT.format(n=200)}) AS preview, round(score, 4) AS score FROM t JOIN r ON review_id = doc_id WHERE score >= 0.35")
def v7(spark, d):
    docs = corpus_with_vectors(spark, d)
    found = VEC.top_k(asked(spark, d).select("query_id", "vector"), docs.select("doc_id", "vector"), 5)
    return VEC.evidence_rows(found, docs, 0.35).select("query_id", "id", F.md5("text").alias("text"), F.md5("preview").alias("preview"), "score")


@query("x11_review_bundle", SRC + ", " + CAT[5:] + ", kc AS (SELECT id, max(key) FILTER (rank = 1) AS key, max(score) AS score FROM kk GROUP BY id), " + TOP.format(k=6)[5:].replace(" s AS (", " s2 AS (").replace("FROM s QUALIFY", "FROM s2 QUALIFY") + ", nr AS (SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS \"similar\" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM t WHERE query_id <> doc_id) WHERE k <= 5 GROUP BY 1) SELECT se.id, label, CASE WHEN label <> 'positive' AND kc.score >= 0.35 THEN kc.key ELSE 'General Feedback' END AS category, \"similar\" FROM se JOIN kc USING (id) JOIN nr ON query_id = se.id")
def x11(spark, d):
    """Sentiment, categories and similar reviews of every twentieth review."""
    docs = corpus_with_vectors(spark, d)
    some = docs.where("doc_id % 20 = 0")
    near = VEC.top_k(some.select(F.col("doc_id").alias("query_id"), "vector"), docs.select("doc_id", "vector"), 6).where("query_id <> doc_id")
    near = near.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("near"))
    a = N.analyse(some.select(F.col("doc_id").alias("id"), "text", "vector"), lexicon_score(), taxonomy_vectors(spark, d), "vector")
    return a.join(near, "id", "left").select("id", "label", F.coalesce("category_key", F.lit("General Feedback")).alias("category"), F.array_join(F.transform(F.slice("near", 1, 5), lambda x: x["doc_id"].cast("string")), ",").alias("similar"))


@query("tx13_single_source_audit")
def tx13(spark, d):
    """The topics of one source, without merging."""
    x = V.table(spark, d, "documents").where("source = 'src0'")
    topics_ = Y.discover(VEC.embed(x, "doc_id"), 6, 30).select("doc_id", "topic").where("topic >= 0")
    kw = Y.topic_keywords(x.join(topics_, "doc_id"), "topic", stop_words=["the", "of", "and"])
    return kw.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), "|").alias("keywords"))


@query("st1_x9_import_stream", UPLOAD + "SELECT source_row, text, external_id, h AS content_hash FROM s")
def st1(spark, d):
    """The upload read as a stream and imported by micro-batches, into a table and a store of keys of its own."""
    store, keys = fresh_path(spark, "feedback"), KnownStore(spark, fresh_path(spark, "known"), 64)
    keys.append(known(spark, d))

    def put(kept):
        kept.write.mode("append").parquet(store)
        keys.append(kept)

    J.import_stream(upload_of(event_stream(spark, d)), lambda: keys, put, f"{store}-checkpoint", organisation_id=1, data_source_id="s2").awaitTermination()
    return spark.read.parquet(store).select("source_row", "text", "external_id", "content_hash")
