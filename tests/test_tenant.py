"""The ten-row corpus with known answers, filters, listings and tenancy."""

from datetime import datetime

import pytest

from voxlake.operators import aggregates as A
from voxlake.operators import filters as P

D = datetime


@pytest.fixture(scope="module")
def tables(spark):
    texts = ["wait too long", "long queue", "overcharged", "fine", "love it", "great", "slow app", "rude", "cold food", "new"]
    labels = ["negative", "negative", "negative", "neutral", "positive", "positive", "negative", "negative", "negative", None]
    keys = ["wait_times", "wait_times", "billing", None, None, None, None, "service", "food", None]
    ratings = [1.0, 2.0, 1.0, 3.0, 5.0, 5.0, 2.0, 1.0, 2.0, 2.0]
    days = [D(2026, 1, 5), D(2026, 1, 5), D(2026, 1, 5), D(2026, 1, 20), D(2026, 1, 20), D(2026, 1, 20), D(2026, 2, 3), D(2026, 2, 3), D(2026, 2, 3), None]
    rows = [(i, 1, 7, texts[i], None, ratings[i], days[i], D(2026, 2, 3), '{"platform":"app store"}' if i in (6, 7, 8) else '{"platform":"web"}') for i in range(10)]
    rows.append((99, 2, 7, "other tenant", None, 5.0, D(2026, 1, 1), D(2026, 1, 1), '{"platform":"web"}'))
    feedback = spark.createDataFrame(rows, "feedback_id long, organisation_id long, import_batch_id long, text string, external_id string, rating double, feedback_at timestamp_ntz, created_at timestamp_ntz, metadata string")
    ids = {"wait_times": 1, "billing": 2, "service": 3, "food": 4, "old": 5, None: None}
    res = [(i, 1, labels[i], ids[keys[i]], 0.9, i == 6, True) for i in range(9)] + [(0, 1, "positive", 4, 0.1, False, False), (99, 2, "positive", None, 0.9, False, True)]
    results = spark.createDataFrame(res, "feedback_id long, organisation_id long, label string, category_id long, confidence double, is_unclassified boolean, is_current boolean")
    names = [(1, "wait_times", "Wait", None, True), (2, "billing", "Billing", None, True), (3, "service", "Service", None, True), (4, "food", "Food", None, True), (6, "food", "Our food", 1, True), (5, "old", "Old", None, False), (7, "ours", "Ours", 1, True), (8, "theirs", "Theirs", 2, True)]
    categories = spark.createDataFrame(names, "id long, key string, name string, organisation_id long, is_active boolean")
    jobs = spark.createDataFrame([(1, 1, "analyse", "failed", 3, 3, D(2026, 1, 1), '{"import_batch_id":"7"}'), (2, 1, "analyse", "failed", 1, 3, D(2026, 1, 2), '{"import_batch_id":"7"}'), (3, 2, "analyse", "failed", 3, 3, D(2026, 1, 9), '{"import_batch_id":"7"}')], "id long, organisation_id long, kind string, status string, attempts int, max_attempts int, created_at timestamp, payload string")
    return feedback, results, categories, jobs


@pytest.fixture(scope="module")
def base(tables):
    return P.base_frame(*tables[:3], organisation_id=1).cache()


def test_summary(base, tables):
    r = A.tenant_summary(base, P.latest_jobs(tables[3], organisation_id=1)).first()
    assert (r.total, r.analysed, r.not_analysed, r.pending, r.failed) == (10, 9, 1, 1, 0)
    assert (r.positive, r.neutral, r.negative, r.unclassified, r.avg_rating) == (2, 1, 6, 1, 2.4)
    assert r.negative_pct == 66.7


def test_given_up_job_is_failed(base, tables):
    jobs = tables[3].where("id = 1")
    r = A.tenant_summary(base, P.latest_jobs(jobs, organisation_id=1)).first()
    assert (r.pending, r.failed) == (0, 1)


def test_summary_of_nothing(base, tables):
    r = A.tenant_summary(base.where("false"), P.latest_jobs(tables[3], organisation_id=1)).first()
    assert r.total == 0 and r.negative_pct == 0.0 and r.avg_rating is None


@pytest.mark.parametrize(("interval", "periods"), [("day", 3), ("month", 2)])
def test_trend(base, interval, periods):
    rows = A.trend(base, interval).collect()
    assert len(rows) == periods and sum(r.n for r in rows) == 10 and [r.period for r in rows] == sorted(r.period for r in rows)


def test_trend_refuses_unknown_interval(base):
    with pytest.raises(ValueError):
        A.trend(base, "hour")


def test_breakdown(base):
    rows = {r.category_key: r for r in A.category_breakdown(base).collect()}
    assert (rows["wait_times"].n, rows["wait_times"].negative, rows["billing"].n, rows[None].n) == (2, 2, 1, 4)
    assert abs(sum(r.share_pct for r in rows.values()) - 100) < 0.5


@pytest.mark.parametrize(
    ("f", "ids"),
    [
        (P.FeedbackFilters(platform="app store"), {6, 7, 8}), (P.FeedbackFilters(sentiment="POSITIVE"), {4, 5}), (P.FeedbackFilters(unclassified=False), {0, 1, 2, 3, 4, 5, 7, 8}), (P.FeedbackFilters(unclassified=True), {6}),
        (P.FeedbackFilters(search=" LONG "), {0, 1}), (P.FeedbackFilters(search="%o"), set()), (P.FeedbackFilters(date_from="2026-01-20 00:00:00", date_to="2026-01-20 00:00:00"), {3, 4, 5}), (P.FeedbackFilters(rating_min=3), {3, 4, 5}),
        (P.FeedbackFilters(analysed=False), {9}), (P.FeedbackFilters(category_key="wait_times", rating_max=1), {0}),
    ],
)
def test_filters(base, f, ids):
    rows = P.apply_filters(base, f)
    assert {r.feedback_id for r in rows.collect()} == ids
    assert P.page_totals(rows).first().total == len(ids)


@pytest.mark.parametrize("bad", [{"sentiment": "angry"}, {"search": " x "}, {"date_from": "2026-02-01", "date_to": "2026-01-01"}, {"rating_min": 0}, {"rating_max": 6}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        P.FeedbackFilters(**bad)


def test_listing_pages_and_keyset_agree(base):
    pages = [r.feedback_id for p in (1, 2, 3, 4) for r in P.listing(base, sort="feedback_at", page=p, page_size=3).collect()]
    assert len(pages) == 10 and pages[-1] == 9
    seen, after = [], None
    while True:
        rows = P.listing(base, sort="feedback_at", page_size=3, after=after).collect()
        if not rows:
            break
        seen += [r.feedback_id for r in rows]
        after = (rows[-1].feedback_at, rows[-1].feedback_id)
    assert seen == pages
    with pytest.raises(ValueError):
        P.listing(base, sort="text")
    with pytest.raises(ValueError):
        P.listing(base, page_size=201)


def test_other_tenant_sees_its_own(tables):
    other = P.base_frame(*tables[:3], organisation_id=2)
    assert [r.feedback_id for r in other.collect()] == [99]


def test_own_category_shadows_default(tables):
    rows = {r.key: r.name for r in P.available_categories(tables[2], organisation_id=1).collect()}
    assert rows["food"] == "Our food" and "old" not in rows and len(rows) == 5
    assert {r.key: r.name for r in P.available_categories(tables[2], organisation_id=2).collect()}["food"] == "Food"


def test_results_name_their_category_by_id(spark, tables):
    """An override and a category of one's own have their own names; a default that a result was made with keeps its name;
    a retired one is still shown; another tenant's never is."""
    feedback, results, categories, _ = tables
    ids = {0: 6, 1: 4, 2: 7, 3: 5, 4: 8, 5: 77}
    rows = spark.createDataFrame([(i, 1, "negative", c, 0.5, False, True) for i, c in ids.items()] + [(99, 2, "negative", 6, 0.5, False, True)], results.schema)
    base = P.base_frame(feedback, rows, categories, organisation_id=1)
    shown = {r.feedback_id: (r.category_key, r.category_name) for r in P.listing_rows(P.listing(base)).collect()}
    assert [shown[i] for i in range(6)] == [("food", "Our food"), ("food", "Food"), ("ours", "Ours"), ("old", "Old"), (None, None), (None, None)] and len(shown) == 10
    by = {(r.category_key, r.category_name): r.n for r in A.category_breakdown(base).collect()}
    assert by == {("food", "Our food"): 1, ("food", "Food"): 1, ("ours", "Ours"): 1, ("old", "Old"): 1, (None, None): 2}
    assert {r.feedback_id for r in P.apply_filters(base, P.FeedbackFilters(category_key="food")).collect()} == {0, 1}
    assert P.base_frame(feedback, rows, categories, organisation_id=2).first().category_name is None


def test_summary_reads_feedback_once(spark, tmp_path, tables):
    tables[0].write.parquet(str(tmp_path / "feedback"))
    base = P.base_frame(spark.read.parquet(str(tmp_path / "feedback")), *tables[1:3], organisation_id=1)
    plan = A.tenant_summary(base, P.latest_jobs(tables[3], organisation_id=1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_layout_does_not_matter(spark, base, tables):
    want = A.category_breakdown(base).orderBy("category_key").collect()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        again = P.base_frame(tables[0].repartition(n), *tables[1:3], organisation_id=1)
        assert A.category_breakdown(again).orderBy("category_key").collect() == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
