import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorwatch.operators import correlation, stats


def test_describe(make, frame):
    p = frame(a=[1.0, 2.0, np.nan, 10.0], b=[np.nan] * 4)
    got = {r.metric: r for r in stats.describe_stats(make(p), ["a", "b"]).collect()}
    a = p.a
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["median"]) == (3, round(a.mean(), 4), 2.0)
    assert got["a"]["std"] == round(a.std(), 4)
    assert got["b"]["count"] == 0 and got["b"]["mean"] is None


def test_before_after(make, frame):
    p = frame(v=[1.0, 3.0, 4.0, 8.0], z=[0.0, 0.0, 1.0, 1.0]).assign(period=["before"] * 2 + ["after"] * 2)
    got = {r.metric: r for r in stats.before_after_compare(make(p), ["v", "z"]).collect()}
    assert (got["v"].before_mean, got["v"].after_mean, got["v"]["diff"], got["v"].change_pct) == (2.0, 6.0, 4.0, 200.0)
    assert got["z"].change_pct is None
    short = stats.before_after_diff(stats.before_after_compare(make(p), ["v"])).first()
    assert (short.before, short.after) == (2.0, 6.0)


def test_trendlines(make, frame):
    x = np.arange(10.0)
    p = frame(minutes=60, x=x, y=2 * x + 1, flat=[3.0] * 10, few=[1.0] * 4 + [np.nan] * 6)
    got = {(r.x_name, r.y_name, r.period): r for r in stats.trendline_by_group(make(p), ["x", "flat", "few"], ["y"]).collect()}
    line = got["x", "y", "all"]
    assert math.isclose(line.slope, 2) and math.isclose(line.intercept, 1) and math.isclose(line.r, 1)
    assert got["flat", "y", "all"].slope is None
    assert ("few", "y", "all") not in got
    split = make(pd.DataFrame({"device_id": ["P1_M1"], "split_date": [p.datetime[9]]}))
    got = {r.period: r for r in stats.trendline_by_group(make(p), ["x"], ["y"], split=split).collect()}
    assert got["before"].n == 9 and got["after"].n == 1 and got["after"].slope is None


def test_early_and_late_lines_split_by_row_count(make, frame):
    x = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
    p = frame(current_A=x, accOA=x, Total_vRMS=[*x[:3], *(2 * x[3:])])
    got = {r.half: r for r in stats.early_late_trendline(make(p)).collect()}
    assert (got["early"].n, got["late"].n) == (3, 4)
    assert math.isclose(got["early"].slope, 1) and math.isclose(got["late"].slope, 2)
    assert got["early"].x_name == "current_A"
    other = stats.early_late_trendline(make(p.assign(current_A=np.nan))).collect()
    assert {r.x_name for r in other} == {"accOA"}
    assert stats.early_late_trendline(make(p.head(5))).count() == 0


def test_normalized_time(make, frame):
    got = [r.time_norm for r in stats.normalize_time(make(frame(v=[0, 0, 0]))).orderBy("row_id").collect()]
    assert got == [0.0, 0.5, 1.0]
    assert stats.normalize_time(make(frame(v=[0]))).first().time_norm == 0.0


def test_correlation_matrix(make, frame):
    rng = np.random.default_rng(4)
    n = 60
    p = frame(load=rng.integers(0, 5, n) * 1.0, const=[1.0] * n, few=[1.0, 2.0, 3.0] + [np.nan] * (n - 3), f=rng.random(n))
    p["g"] = p.load + p.f
    p.loc[3:8, "g"] = np.nan
    got = {(r.variable_type, r.vibration_feature): r for r in
           correlation.correlation_matrix(make(p), ["load", "const", "few"], ["f", "g"]).collect()}
    assert set(got) == {("load", "f"), ("load", "g")}
    q = p[["load", "g"]].dropna()
    assert got["load", "g"].n_samples == len(q)
    assert got["load", "g"].pearson_r == round(q.load.corr(q.g), 4)
    assert got["load", "g"].spearman_r == round(q.load.rank().corr(q.g.rank()), 4)


@pytest.fixture
def p_of(spark):
    """p-values of lists of r and n, by column expressions."""
    def run(r, n):
        rows = spark.createDataFrame(list(zip(map(float, r), map(float, n))), "r double, n double").coalesce(1)
        return np.array([x.p for x in rows.select(correlation.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()])

    return run


def test_p_values_match_closed_forms(p_of):
    r = np.array([0.3, 0.9, -0.5, 0.0, 1.0])
    np.testing.assert_allclose(p_of(r, np.full(5, 4.0)), 1 - np.abs(r), atol=1e-12)
    t = r[:4] * np.sqrt(4 / (1 - r[:4] ** 2))
    want = [1 - abs(x) / math.sqrt(4 + x * x) * (1 + 2 / (4 + x * x)) for x in t]
    np.testing.assert_allclose(p_of(r[:4], np.full(4, 6.0)), want, atol=1e-12)
    n = 4e6  # nearly normal
    assert math.isclose(p_of(np.array([3 / math.sqrt(n)]), np.array([n]))[0], math.erfc(3 / math.sqrt(2)), rel_tol=1e-4)


def test_p_values_match_spark_regression(make, frame, p_of):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(8)
    p = frame(x=rng.random(40), noise=rng.random(40))
    p["y"] = p.x + 2 * p.noise
    vec = VectorAssembler(inputCols=["x"], outputCol="v").transform(make(p))
    want = LinearRegression(featuresCol="v", labelCol="y", solver="normal").fit(vec).summary.pValues[0]
    got = p_of(np.array([p.x.corr(p.y)]), np.array([40.0]))[0]
    assert math.isclose(got, want, rel_tol=1e-6)
    text = correlation.with_p_values(correlation.correlation_matrix(make(p), ["x"], ["y"])).first()
    assert text.pearson_p == f"{want:.2e}"


@pytest.mark.parametrize("k", [1, 2])
def test_strongest_pairs(make, k):
    p = pd.DataFrame({"device_id": "a", "variable_type": ["u", "v", "w"], "vibration_feature": "f", "pearson_r": [0.1, -0.9, 0.5]})
    got = correlation.topk_correlations(make(p), k).orderBy("rank").collect()
    assert [r.variable_type for r in got] == ["v", "w"][:k]
