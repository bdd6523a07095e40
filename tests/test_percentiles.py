"""Exact percentiles and the mean cosine by sums, against NumPy and all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import aggregates as A
from voxlake.operators import vectors as VEC
from voxlake.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_against_numpy(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(size=4000), "few": rng.integers(0, 4, 999).astype(float), "one": np.array([2.5]), "two": np.array([1.0, -4.0]), None: rng.exponential(size=50) * 1e9}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"lo": 0.0, "a": 0.05, "median": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r.k: r for r in exact_percentiles(df, F.col("v"), probs, "k").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose([got[k][name] for name in probs], np.quantile(vs, list(probs.values())), rtol=1e-12)
    whole = exact_percentiles(df, F.col("v"), {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_describe_and_lengths(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 4.0), ("b", None), (None, 2.0)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in A.describe(df, "v", "k").collect()}
    assert got == {"a": (2, 1.0, 2.5, 2.5, 4.0), "b": (0, None, None, None, None), None: (1, 2.0, 2.0, 2.0, 2.0)}
    reviews = spark.createDataFrame([("p", "a b c"), ("p", "a"), ("q", "")], "platform string, text string")
    assert {r.platform: (r.median_words, r.mean_words, r.p95_words) for r in A.length_profile(reviews).collect()} == {"p": (2.0, 2.0, 2.9), "q": (0.0, 0.0, 0.0)}
    assert A.describe(df.limit(0), "v", "k").count() == 0


def test_no_window_holds_a_group(spark):
    plan = exact_percentiles(spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v")), F.col("v"), {"m": 0.5}, "k")._jdf.queryExecution().optimizedPlan().toString()
    over_values = [line for line in plan.splitlines() if "Window" in line and "_v#" in line and "windowspecdefinition" in line]
    assert over_values and all("_part#" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in over_values)


def test_separation_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(12, 5))
    c[3] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "g long, centroid array<double>")
    unit = [v / np.linalg.norm(v) for v in c if v.any()]
    want = np.mean([unit[i] @ unit[j] for i in range(11) for j in range(i)])
    r = VEC.separation(df, "g").first()
    assert r.pairs == 55 and r.mean_cosine == pytest.approx(want, abs=1e-6)
    assert VEC.separation(df.limit(1), "g").first().mean_cosine is None and "Join" not in VEC.separation(df, "g")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
