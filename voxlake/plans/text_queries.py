"""Queries over text features, imports and the corpus build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokenizers import Phrases
from ..operators import features as T
from ..operators import ingest as I
from ..operators import search_index as SI
from ..schemas import DETERMINERS, KEYWORD_STOPWORDS
from ..sources.known import KnownStore
from ..sources.scratch import fresh_path, stored
from . import views as V
from .registry import query
from .tenant_queries import CLEAN
from .views import with_

R = with_("reviews")
TERMS = ", tok AS (SELECT doc_id AS doc, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), tm AS (SELECT doc, unnest(w) AS term FROM tok UNION ALL SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok), tf AS (SELECT doc, term, count(*) AS tf FROM tm GROUP BY ALL)"
UNI = TERMS.replace(" UNION ALL SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok", "")


def texts(spark, d) -> DataFrame:
    return V.table(spark, d, "documents")


@query("t1_term_counts", "WITH x AS (SELECT 1)" + TERMS + " SELECT doc, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most FROM tf GROUP BY doc")
def t1(spark, d):
    return T.term_counts(texts(spark, d), "doc_id").groupBy("doc").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


@query("t2_vocabulary", "WITH x AS (SELECT 1)" + TERMS + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 50000")
def t2(spark, d):
    return T.vocabulary(T.term_counts(texts(spark, d), "doc_id"))


IDF = UNI + ", n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), r AS (SELECT doc, term, {tf} * (ln((1.0::DOUBLE + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN v USING (term), n), wt AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM r)"


def weights(spark, d, sublinear=False, of=T.tf_idf):
    docs = texts(spark, d)
    counts = stored(T.term_counts(docs, "doc_id", bigrams=False))
    return of(counts, T.vocabulary(counts, size=None), docs.count(), sublinear)


@query("t3_tf_idf_sublinear", "WITH x AS (SELECT 1)" + IDF.replace("{tf}", "(1 + ln(tf))") + " SELECT doc, count(*) AS n, round(max(weight), 6) AS heaviest, round(sum(weight), 6) AS total FROM wt GROUP BY doc")
def t3(spark, d):
    return T.weight_digest(weights(spark, d, True, T.raw_tf_idf))


SEARCH = "WITH x AS (SELECT 1)" + IDF.replace("{tf}", "tf") + ", s AS (SELECT q.doc AS query_id, w.doc, round(sum(q.weight * w.weight), 9) AS score FROM wt q JOIN wt w USING (term) WHERE q.doc % 20 = 0{where} GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 5) SELECT query_id, k.doc, round(score, 5) AS score, rank FROM k"


@query("t4_j9_tf_idf_search", SEARCH.replace("{where}", " AND w.doc IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def t4(spark, d):
    w = stored(weights(spark, d))
    queries = w.where("doc % 20 = 0").withColumnRenamed("doc", "query_id")
    allowed = V.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return T.tf_idf_search(queries, w, 5, allowed).select("query_id", "doc", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t4_stored_index", SEARCH.replace("{where}", " AND w.doc IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def t4_index(spark, d):
    """The same answers from a stored index, by the blocks that can hold one of them."""
    w, path = stored(weights(spark, d)), fresh_path(spark, "index")
    SI.build(w, path)
    allowed = V.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    found, _ = SI.search(spark, path, w.where("doc % 20 = 0").withColumnRenamed("doc", "query_id"), 5, allowed)
    return found.select("query_id", "doc", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("t4_tf_idf_search_post_filter", SEARCH.replace("{where}", "") + " WHERE k.doc IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def t4_post(spark, d):
    w = stored(weights(spark, d))
    queries = w.where("doc % 20 = 0").withColumnRenamed("doc", "query_id")
    allowed = V.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return T.tf_idf_search(queries, w, 5, allowed, post_filter=True).select("query_id", "doc", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


LEXICON = (("the", 0.4), ("of", -0.3), ("and", 0.2), ("in", -0.6), ("no", -1.2), ("la", 0.7), ("le", -0.5), ("der", 0.3), ("die", -0.9), ("el", 0.8), ("moron", -2.0), ("scum", -2.5))


@query("t6_lexicon_sentiment", "WITH w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents), l AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON) + ") t(word, valence)), n AS (SELECT doc, word, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT d.doc_id AS doc, round(coalesce(sum(n * valence), 0), 9) AS s FROM documents d LEFT JOIN n ON n.doc = d.doc_id LEFT JOIN l USING (word) GROUP BY 1), c AS (SELECT doc, round(s / sqrt(s * s + 15.0), 6) AS compound FROM s) SELECT doc, round(compound, 5) AS compound, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, round(abs(compound), 5) AS confidence FROM c")
def t6(spark, d):
    lexicon = spark.createDataFrame(list(LEXICON), "word string, valence double")
    s = T.lexicon_sentiment(V.table(spark, d, "documents"), lexicon, "doc_id")
    return s.select("doc", F.round("compound", 5).alias("compound"), "label", F.round("confidence", 5).alias("confidence"))


#: The sentiment stage's model in SQL, over a table src (id, text) with distinct ids: se has id, label and confidence.
CONTROLS = r"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'"


def sentiment_sql(lexicon=LEXICON) -> str:
    values = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in lexicon)
    return f"""lx AS (SELECT * FROM (VALUES {values}) t(word, valence)), sw AS (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(text, {CONTROLS})), '[a-z'']+')) AS word FROM src),
sv AS (SELECT id, round(sum(valence), 9) AS s FROM sw JOIN lx USING (word) GROUP BY 1), sc AS (SELECT src.id, round(coalesce(s, 0) / sqrt(coalesce(s * s, 0) + 15.0::DOUBLE), 6) AS c FROM src LEFT JOIN sv USING (id)),
se AS (SELECT id, CASE WHEN c <= -0.05::DOUBLE THEN 'negative' WHEN c > 0.05::DOUBLE THEN 'positive' ELSE 'neutral' END AS label, round(greatest(abs(c), 0.05::DOUBLE), 4) AS confidence FROM sc)"""


STOPS = {"en": "the of and to in is that for with was", "fr": "le la les de et des une un dans que", "de": "der die und das von nicht ein mit den im", "es": "el los las y una por con del para su"}


@query("f12_stop_word_language", "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for k, ws in STOPS.items() for w in ws.split()) + ") t(word, language)), t AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents), h AS (SELECT doc, language, count(*) AS n FROM (SELECT doc, unnest(ws) AS word FROM t) JOIN s USING (word) GROUP BY ALL), b AS (SELECT doc, language FROM h QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, language) = 1) SELECT t.doc, language, len(ws) < 4 OR language IS NULL OR language = 'en' AS kept_as_english FROM t LEFT JOIN b USING (doc)")
def f12(spark, d):
    stops = spark.createDataFrame([(w, k) for k, ws in STOPS.items() for w in ws.split()], "word string, language string")
    return T.stop_word_language(V.table(spark, d, "documents"), stops, "doc_id")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(KEYWORD_STOPWORDS))
_DET = "|".join(DETERMINERS)


KEYWORDS = R + f""", w AS (SELECT review_id, sentiment_label, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM reviews),
g AS (SELECT sentiment_label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS raw FROM w),
p AS (SELECT sentiment_label, trim(regexp_replace(raw, '^(?:{_DET})\\s+', '')) AS word FROM g),
f AS (SELECT * FROM p WHERE length(word) >= 3 AND word NOT IN ({_STOP}) AND regexp_matches(word, '[a-z]')),
c AS (SELECT 'all' AS bucket, word, count(*) AS count FROM f GROUP BY word UNION ALL SELECT sentiment_label, word, count(*) FROM f GROUP BY ALL),
n AS (SELECT 'all' AS bucket, count(*) AS n_reviews FROM reviews UNION ALL SELECT sentiment_label, count(*) FROM reviews GROUP BY 1)
SELECT bucket, word, count, n_reviews, row_number() OVER (PARTITION BY bucket ORDER BY count DESC, word) AS rank FROM c JOIN n USING (bucket) QUALIFY rank <= """


@query("a9_p15_w6_keywords", KEYWORDS + "200")
def a9(spark, d):
    return T.keyword_counts(V.reviews(spark, d))


@query("k7_user_tokeniser", KEYWORDS + "200")
def k7(spark, d):
    return T.keyword_counts(V.reviews(spark, d), tokenizer=Phrases)


@query("a10_keyword_basis", "SELECT CASE WHEN count(*) <= 500 THEN 'full' ELSE 'sample' END AS basis, count(*) FILTER (CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 500.0::DOUBLE / (SELECT count(*) FROM documents)) AS n FROM documents")
def a10(spark, d):
    rows, basis = T.keyword_basis(V.reviews(spark, d), "review_id", 500)
    return rows.agg(F.count("*").alias("n")).withColumn("basis", F.lit(basis))


# imports: an upload made of the events table, with bad dates, ratings, empty texts and repeats


def upload(spark, d) -> DataFrame:
    return upload_of(V.table(spark, d, "events"))


def upload_of(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return e.select(
        i.alias("source_row"), F.when(i % 23 == 0, "  \x07 ").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\x00 "), (i % 701).cast("string"), F.lit("\n"))).alias("Comment"),
        F.when(i % 5 > 0, F.concat(F.lit("ext"), (i % 4000).cast("string"))).alias(" ID "), F.when(i % 29 == 0, "yesterday").when(i % 2 == 0, "2026/02/01").alias("Date"),
        F.when(i % 31 == 0, "nine").when(i % 37 == 0, "NaN").otherwise((1 + i % 5).cast("string")).alias("stars"), F.col("event_type").alias("Channel"),
    )


def known(spark, d) -> DataFrame:
    e, i = V.table(spark, d, "events").where("event_id % 11 = 0"), F.col("event_id")
    text = F.concat("event_type", F.lit(" "), (i % 701).cast("string"))
    return e.select((i % 2).alias("organisation_id"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("data_source_id"), F.concat(F.lit("ext"), (i % 4000).cast("string")).alias("external_id"), X.content_hash(text).alias("content_hash"))


UPLOAD = """WITH u AS (SELECT event_id AS source_row, CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type || ' ' || (event_id % 701) END AS text, CASE WHEN event_id % 5 > 0 THEN 'ext' || (event_id % 4000) END AS external_id,
CASE WHEN event_id % 29 = 0 THEN false ELSE true END AS date_ok, event_id % 31 <> 0 AND event_id % 37 <> 0 AS rating_ok FROM events),
e AS (SELECT *, CASE WHEN text = '' THEN 'text' WHEN NOT date_ok THEN 'created_at' WHEN NOT rating_ok THEN 'rating' END AS field FROM u),
g AS (SELECT *, sha256(text) AS h FROM e WHERE field IS NULL),
o AS (SELECT * FROM g WHERE external_id IS NULL UNION ALL SELECT * FROM g WHERE external_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY source_row) = 1),
k AS (SELECT event_id % 2 AS org, 's' || (event_id % 3) AS src, 'ext' || (event_id % 4000) AS ext, sha256(event_type || ' ' || (event_id % 701)) AS h FROM events WHERE event_id % 11 = 0),
s AS (SELECT * FROM o WHERE (external_id IS NULL OR external_id NOT IN (SELECT ext FROM k WHERE org = 1 AND src = 's2')) AND h NOT IN (SELECT h FROM k WHERE org = 1) QUALIFY row_number() OVER (PARTITION BY h ORDER BY source_row) = 1) """


def imported(spark, d) -> I.Import:
    return I.import_rows(I.validated(upload(spark, d)), known(spark, d), organisation_id=1, data_source_id="s2", import_batch_id="b1", max_rows=None)


@query("p7_p10_p11_rejects", UPLOAD + "SELECT source_row AS row, field FROM e WHERE field IS NOT NULL")
def p11(spark, d):
    return I.rejected(I.validated(upload(spark, d))).select("row", "field")


@query("x9_j3_j4_w2_w3_import_kept", UPLOAD + "SELECT source_row, text, external_id, h AS content_hash FROM s")
def x9(spark, d):
    return imported(spark, d).kept.select("source_row", "text", "external_id", "content_hash")


@query("x9_bucketed_store", UPLOAD + """SELECT source_row, text, external_id, h AS content_hash, false AS again FROM s""")
def x9_store(spark, d):
    """The import against a store of keys; what it keeps is then known, so that the same upload leaves nothing more."""
    store, rows = KnownStore(spark, fresh_path(spark, "known"), 64), stored(I.validated(upload(spark, d)))
    store.append(known(spark, d))
    put = lambda batch: I.import_rows(rows, store, organisation_id=1, data_source_id="s2", import_batch_id=batch, max_rows=None).kept
    kept = stored(put("b1"))
    store.append(kept)
    again = put("b2")
    return kept.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))).select("source_row", "text", "external_id", "content_hash", "again")


@query("a34_import_counters", UPLOAD + "SELECT (SELECT count(*) FROM u) AS received, (SELECT count(*) FROM e WHERE field IS NOT NULL) AS rejected, (SELECT count(*) FROM g) - (SELECT count(*) FROM o) AS duplicates_in_file, (SELECT count(*) FROM o) - (SELECT count(*) FROM s) AS duplicates_in_store, (SELECT count(*) FROM s) AS stored, CASE WHEN (SELECT count(*) FROM s) = 0 THEN 'failed' ELSE 'completed' END AS status")
def a34(spark, d):
    return imported(spark, d).counters


@query("p12_metadata", UPLOAD.split("e AS")[0].rstrip().rstrip(",") + " SELECT source_row, '{\"source_row\":' || source_row || CASE WHEN source_row % 4 = 0 THEN '' ELSE ',\"platform\":\"' || split_part(CASE WHEN text = '' THEN 'x' ELSE text END, ' ', 1) || '\"' END || '}' AS metadata FROM u WHERE text <> ''")
def p12(spark, d):
    rows = I.validated(upload(spark, d)).where("text <> ''")
    return rows.select("source_row", F.to_json(F.struct("source_row", F.when(F.col("source_row") % 4 != 0, F.col("platform")).alias("platform"))).alias("metadata"))


@query("j5_seen_file", "WITH b AS (SELECT event_id AS id, user_id % 4 AS organisation_id, md5((event_id % 40)::VARCHAR) AS source_hash, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'failed' END AS status, ts AS created_at FROM events) SELECT id, created_at FROM b WHERE organisation_id = 1 AND source_hash = md5('6') AND status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 1")
def j5(spark, d):
    i = F.col("event_id")
    b = V.table(spark, d, "events").select(i.alias("id"), (F.col("user_id") % 4).alias("organisation_id"), F.md5((i % 40).cast("string")).alias("source_hash"), F.when(i % 3 == 0, "completed").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))
    import hashlib

    return I.seen_file(b, hashlib.md5(b"6").hexdigest(), organisation_id=1).select("id", "created_at")


SOURCES = f""", s AS (SELECT 0 AS o, review_id::VARCHAR AS review_id, platform, text, CASE WHEN review_id % 9 > 0 THEN rating END AS rating, sentiment_label FROM reviews WHERE review_id % 3 < 2
UNION ALL SELECT 1, 'r' || review_id, 'second', text, rating, CASE WHEN review_id % 13 > 0 THEN sentiment_label END FROM reviews WHERE review_id % 3 > 0),
c AS (SELECT *, {CLEAN} AS cleaned FROM s), f AS (SELECT * FROM c WHERE sentiment_label IS NOT NULL AND length(cleaned) > 15 QUALIFY row_number() OVER (PARTITION BY sha256(cleaned) ORDER BY o, review_id) = 1)"""


@query("x10_u1_u2_corpus_build", R + SOURCES + " SELECT review_id, platform, md5(cleaned) AS h, coalesce(rating, 3.0) AS rating, sentiment_label FROM f")
def x10(spark, d):
    r = V.reviews(spark, d)
    one = r.where("review_id % 3 < 2").withColumn("rating", F.when(F.col("review_id") % 9 > 0, F.col("rating"))).withColumn("review_id", F.col("review_id").cast("string"))
    two = r.where("review_id % 3 > 0").withColumn("sentiment_label", F.when(F.col("review_id") % 13 > 0, F.col("sentiment_label"))).withColumn("review_id", F.concat(F.lit("r"), F.col("review_id").cast("string"))).withColumn("platform", F.lit("second")).drop("date")
    return I.build_corpus([one, two]).select("review_id", "platform", F.md5("cleaned_text").alias("h"), "rating", "sentiment_label")
