"""Exact distributed quantile against numpy's linear-interpolation percentile."""

import numpy as np
import pytest

from salescope.functions.quantile import exact_quantile


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("accuracy", [2, 50, 10000])
def test_matches_numpy(spark, q, accuracy):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 500).round(2), np.full(400, 42.0), rng.integers(0, 5, 100)])
    df = spark.createDataFrame([(float(x),) for x in vals] + [(None,)], "x double")
    got = exact_quantile(df, "x", q, accuracy=accuracy).collect()[0]["value"]
    assert got == pytest.approx(float(np.percentile(vals, q * 100)), rel=0, abs=1e-9)


def test_empty_and_single(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5).collect()[0]["value"] is None
    assert exact_quantile(spark.createDataFrame([(3.5,)], "x double"), "x", 0.75).collect()[0]["value"] == 3.5


def test_several_quantiles_in_one_pass(spark):
    from salescope.functions.quantile import exact_quantiles

    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 300).round(3), rng.integers(0, 20, 300)
    df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(a, b)], "a double, b long")
    r = exact_quantiles(df, {"ma": ("a", 0.5), "qb": ("b", 0.75), "none": ("a", 0.1)}, accuracy=40).collect()[0]
    assert r["ma"] == pytest.approx(float(np.percentile(a, 50)), abs=1e-12)
    assert r["qb"] == pytest.approx(float(np.percentile(b, 75)), abs=1e-12)
    assert r["none"] == pytest.approx(float(np.percentile(a, 10)), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 997])
def test_small_and_odd_sizes(spark, n):
    """The ranks of a sketch and of an interpolated quantile differ by one: every size near a boundary."""
    vals = np.arange(n, dtype=float) ** 2
    df = spark.createDataFrame([(float(x),) for x in vals], "x double")
    qs = [0.0, 0.1, 1 / 3, 0.5, 0.75, 0.9, 0.999, 1.0]
    from salescope.functions.quantile import exact_quantiles

    r = exact_quantiles(df, {f"q{i}": ("x", q) for i, q in enumerate(qs)}).collect()[0]
    for i, q in enumerate(qs):
        assert r[f"q{i}"] == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.4, 0.999])
def test_many_rows_with_heavy_ties(spark, share):
    """More rows than the sketch holds, over several tasks: the bracket has to be narrow and right."""
    from pyspark.sql import functions as F

    n = 200_000
    x = F.when(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000), F.lit(42.0)).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10**9)) / F.lit(1e4))
    df = spark.range(n, numPartitions=6).select(x.alias("x"))
    vals = np.array([r.x for r in df.collect()])
    from salescope.functions.quantile import exact_quantiles

    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    r = exact_quantiles(df, {f"q{i}": ("x", q) for i, q in enumerate(qs)}, accuracy=1000).collect()[0]
    for i, q in enumerate(qs):
        assert r[f"q{i}"] == pytest.approx(float(np.percentile(vals, q * 100)), rel=1e-12)


def test_few_values_reach_the_running_sums(spark):
    """Of 100,000 different values only those inside the bracket are counted one by one."""
    from pyspark.sql import functions as F

    from salescope.functions.quantile import MARGIN

    df = spark.range(100_000, numPartitions=4).select(F.col("id").cast("double").alias("x"))
    q = exact_quantile(df, "x", 0.5, accuracy=1000)
    assert q.collect()[0]["value"] == 49999.5
    plan = q._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Exchange") - text.count("ReusedExchange") <= 2 * 6  # the final and the initial plan of AQE
    low = df.agg(F.percentile_approx("x", [0.5 - MARGIN / 1000, 0.5 + MARGIN / 1000], 1000).alias("a")).collect()[0].a
    assert low[0] <= 49999 and low[1] >= 50000 and low[1] - low[0] <= 100_000 * 2 * (MARGIN + 1) / 1000
