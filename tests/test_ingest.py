import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as X
from voxlake.operators import ingest as I
from voxlake.schemas import DATE_PATTERNS
from voxlake.sources import files as S


def upload(spark, tmp_path, content, name="a.csv"):
    (tmp_path / name).write_bytes(content)
    return S.read_upload(spark, str(tmp_path / name))


def known(spark, rows=()):
    return spark.createDataFrame(list(rows), "organisation_id long, data_source_id string, external_id string, content_hash string")


def put(spark, rows, extra, store=(), **kw):
    return I.import_rows(I.validated(rows, extra=extra), known(spark, store), organisation_id=1, data_source_id="s", import_batch_id="b", **kw)


def test_four_rows(spark, tmp_path):
    rows, extra = upload(spark, tmp_path, b"text,external_id,rating,created_at\ngood thing,1,5,2026-02-01\nbad thing,2,1,01/02/2026\n   ,3,2,\nplain,4,,\n")
    done = put(spark, rows, extra)
    c = done.counters.first()
    assert (c.received, c.stored, c.rejected, c.status) == (4, 3, 1, "completed")
    assert [r.asDict() for r in done.errors.collect()] == [{"row": 4, "field": "text", "message": "Feedback text is empty."}]


def test_aliases_bom_blank_rows_and_latin1(spark, tmp_path):
    rows, extra = upload(spark, tmp_path, "﻿Feedback, ID \nhello,7\n,\nworld,8\n".encode())
    got = I.validated(rows, extra=extra).orderBy("source_row").collect()
    assert [(r.text, r.external_id, r.source_row) for r in got] == [("hello", "7", 2), ("world", "8", 4)]
    rows, extra = upload(spark, tmp_path, "comment\ncafé crème\n".encode("latin-1"), "b.csv")
    assert I.validated(rows, extra=extra).first().text == "café crème"


def test_unusable_files(spark, tmp_path):
    with pytest.raises(I.UnusableFile):
        I.map_header(["a", "b"])
    rows, extra = upload(spark, tmp_path, b"text\na\nb\nc\n")
    with pytest.raises(I.UnusableFile):
        put(spark, rows, extra, max_rows=2)


@pytest.mark.parametrize(("value", "ok"), [("2026-02-01", True), ("2026-02-01 10:30:00", True), ("01/02/2026", True), ("2026/02/01", True), ("2026-02-01T09:00:00Z", True), ("not-a-date", False), ("2026-13-45", False), ("yesterday", False), ("01/02/26 maybe", False)])
def test_dates(spark, value, ok):
    rows = spark.createDataFrame([(2, "x", value)], "source_row int, text string, date string")
    r = I.validated(rows).first()
    assert (r.error is None) == ok and (r.created_at is not None) == ok
    if value == "01/02/2026":
        assert (r.created_at.month, r.created_at.day) == (2, 1)


@pytest.mark.parametrize(("value", "ok"), [("nine", False), ("0", False), ("6", False), ("-3", False), ("NaN", False), ("1", True), ("5", True), ("3.5", True)])
def test_ratings(spark, value, ok):
    r = I.validated(spark.createDataFrame([(2, "x", value)], "source_row int, text string, stars string")).first()
    assert (r.error is None) == ok and (ok or r.error.field == "rating")


def test_first_failing_rule_and_extra_cells(spark, tmp_path):
    rows, extra = upload(spark, tmp_path, b"text,rating\nfine,5,more\n,9\n" + b"x" * 20_001 + b",9\n")
    assert [(r.row, r.field) for r in I.rejected(I.validated(rows, extra=extra)).orderBy("row").collect()] == [(2, "row"), (3, "text"), (4, "text")]


def test_repeats_overlap_and_reformatting(spark, tmp_path):
    rows, extra = upload(spark, tmp_path, b"text,id\none,a\ntwo,a\nthree,\nthree ,\nfour,d\n five  six,e\n")
    store = [(1, "s", "d", "?"), (1, "t", "zz", hashed(spark, "five six")), (2, "s", "a", hashed(spark, "one"))]
    done = put(spark, rows, extra, store)
    assert sorted(r.text for r in done.kept.collect()) == ["one", "three"]
    c = done.counters.first()
    assert (c.received, c.duplicates_in_file, c.duplicates_in_store, c.stored) == (6, 1, 3, 2)
    again = put(spark, rows, extra, [(1, "s", r.external_id, r.content_hash) for r in done.kept.collect()] + store).counters.first()
    assert (again.stored, again.status) == (0, "failed")


def hashed(spark, t):
    return spark.range(1).select(X.content_hash(F.lit(t))).first()[0]


def test_normalise(spark):
    one = lambda f, t: spark.range(1).select(f(F.lit(t))).first()[0]
    assert one(X.normalise, "battery\x00 died\x07") == "battery died"
    assert one(X.normalise, "  the   battery \t\n died  ") == "the battery died"
    assert one(X.normalise, "a b \U0001f600 http://x.y") == "a b \U0001f600 http://x.y"
    assert one(X.clean_review, "See http://a.b @bob #Tag_one <b>Café</b>\n x") == "see tag one caf x"
    assert one(X.phrase, " The Wait Time") == "wait time" and one(X.phrase, "things") is None and one(X.phrase, "the 42") is None


def test_corpora(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"title":"Good","text":"works well enough.","rating":2.5,"timestamp":1704067200000,"asin":"A1"}\n\nnot json\n{"text":"short"}\n{"text":"no title but long enough","rating":1.0}\n')
    a = I.standard_product_reviews(S.read_product_reviews(spark, str(tmp_path / "a.jsonl.gz")), "home").orderBy("text").collect()
    assert [(r.text, r.sentiment_label, str(r.date)) for r in a] == [("Good. works well enough", "positive", "2024-01-01"), ("no title but long enough", "negative", "None")]
    (tmp_path / "y.json").write_text('{"text":"a fine place to eat","date":"2020-05-06 10:00:00","review_id":"y1"}\n{"text":"tiny"}\n')
    y = I.standard_business_reviews(S.read_business_reviews(spark, str(tmp_path / "y.json")))
    assert [(r.review_id, r.rating, str(r.date)) for r in y.collect()] == [("y1", 3.0, "2020-05-06")]
    (tmp_path / "t.csv").write_text('text,airline_sentiment,tweet_created,tweet_id\n"late, again",negative,2015-02-24 11:35:52 -0800,9\n')
    t = I.standard_tweets(S.read_tweets(spark, str(tmp_path / "t.csv")))
    assert [(r.rating, r.sentiment_label, str(r.date)) for r in t.collect()] == [(1.0, "negative", "2015-02-24")]
    corpus = I.build_corpus([y.union(y), t], least_chars=5)
    assert corpus.count() == 2 and [f.name for f in corpus.schema] == ["review_id", "platform", "product_category", "text", "cleaned_text", "rating", "sentiment_label", "date"]
    S.write_corpus(corpus, str(tmp_path / "corpus"))
    assert S.read_corpus(spark, str(tmp_path / "corpus"), "platform", "rating").count() == 2


def test_sinks(spark, tmp_path):
    S.write_keywords(spark.createDataFrame([("all", "wait", 3)], "bucket string, word string, count long"), str(tmp_path / "k"))
    assert S.read_keywords(spark, str(tmp_path / "k")).count() == 1
    spark.range(1).select(F.lit("w").alias("word"), F.lit(1).alias("filter_version")).write.parquet(str(tmp_path / "old"))
    assert S.read_keywords(spark, str(tmp_path / "old")).count() == 0
    for kind in ("json", "csv"):
        S.write_report(spark.range(3), str(tmp_path / kind), kind)
        assert S.read_report(spark, str(tmp_path / kind), "id long", kind).count() == 3
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "organisation_id long, text string")
    S.append_feedback(rows, str(tmp_path / "store"))
    S.append_feedback(rows, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("organisation_id = 1").count() == 2
    batches = spark.createDataFrame([(1, 1, "h", "completed", 1), (2, 1, "h", "completed", 2), (3, 1, "h", "failed", 3), (4, 2, "h", "completed", 4)], "id long, organisation_id long, source_hash string, status string, created_at long")
    assert [r.id for r in I.seen_file(batches, "h", organisation_id=1).collect()] == [2]


def test_dates_are_read_as_by_their_patterns_alone(spark):
    values = [a + b + c for a in ("2026/02/01", "2026-02-01", "01/02/2026", "13/02/2026", "02/13/2026", "31-12-2026", "2026-02-30", "12026-02-01", "+12026-02-01", "-2026-02-01", "+2026/02/01", "1/2/2026", "01/02/26", "2026-2-1", "٢٠٢٦-02-01", "yesterday", "") for b in ("", " 10:11:12", "T10:11:12Z", " 10:11", " 1:2:3") for c in ("", "x", " ")]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    plain = F.coalesce(F.when(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp("v")), *(F.try_to_timestamp("v", F.lit(p)) for p in DATE_PATTERNS))
    out = rows.select("v", X.parse_time("v").cast("string").alias("a"), plain.cast("string").alias("b")).collect()
    assert [(r.v, r.a) for r in out] == [(r.v, r.b) for r in out] and 10 < sum(r.a is not None for r in out) < len(out)


def test_tweets_and_their_sql_agree_on_empty_and_null_texts(spark, tmp_path):
    import hashlib

    from voxlake.plans import file_queries as Q

    texts = ["", None, " ", '"', ',"\n\r', "x,\n" * 700_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(str(i), None if t is None else hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(texts)}
    assert {(r.review_id, r.h) for r in Q.s3(spark, str(tmp_path)).collect()} == want
    (tmp_path / "raw.csv").write_text('text,airline_sentiment,tweet_id\n"",neutral,1\n,neutral,2\n')
    assert {(r.tweet_id, r.text) for r in S.read_tweets(spark, str(tmp_path / "raw.csv")).collect()} == {("1", ""), ("2", None)}
