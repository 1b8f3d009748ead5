import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorwatch.functions.scoring import load_bin
from rotorwatch.operators import diagnosis, model

FEATURES = ["Total_vRMS", "accOA", "Crest_Factor"]


@pytest.fixture(scope="module")
def rows(frame):
    rng = np.random.default_rng(2)
    n = 300
    return frame(Total_vRMS=rng.normal(2, 0.2, n), accOA=rng.normal(1, 0.1, n), Crest_Factor=rng.normal(3, 0.3, n),
                 current_A=rng.uniform(5, 15, n))


def edges_of(make, values):
    p = pd.DataFrame({"device_id": "a", "bin_value": values})
    return model.quantile_bins(make(p)).first().edges


def test_bins_equal_qcut(make, rows):
    labels, edges = pd.qcut(rows.current_A, 3, labels=False, retbins=True, duplicates="drop")
    np.testing.assert_allclose(edges_of(make, rows.current_A), edges, rtol=1e-12)
    got = model.label_baseline(make(rows)).orderBy("row_id").toPandas()["bin_id"]
    assert list(got) == list(labels)


def test_fewer_bins_when_rows_are_few(make):
    assert len(edges_of(make, np.arange(44.0))) == 3      # 3 bins would leave 14 rows in one
    assert len(edges_of(make, np.arange(29.0))) == 2
    assert edges_of(make, np.arange(14.0)) is None
    assert len(edges_of(make, np.arange(45.0))) == 4


def test_merged_edges_and_constant_column(make):
    skewed = [40.0] * 50 + [55.0] * 10
    labels, edges = pd.qcut(pd.Series(skewed), 3, labels=False, retbins=True, duplicates="drop")
    np.testing.assert_allclose(edges_of(make, skewed), edges)
    assert edges_of(make, [50.0] * 40) == [50.0]
    assert edges_of(make, [np.nan] * 40) is None


def test_values_outside_the_edges_go_to_bin_zero(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (2.1,), (3.0,), (9.0,), (None,)], "v double")
    edges = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    got = [r.b for r in df.select(load_bin("v", edges).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 1, 0, 0]


def test_bin_column_choice(make, frame):
    full, few = [1.0] * 12, [1.0] * 9 + [np.nan] * 3
    a = frame(device="A_M1", accFreq=full, 頻率=few, current_A=full)
    b = frame(device="B_M1", accFreq=full, 頻率=full, current_A=full)
    c = frame(device="C_M1", accFreq=full, 頻率=few, current_A=few)
    got = {r.device_id: r.bin_col for r in model.resolve_bin_column(make(pd.concat([a, b, c]))).collect()}
    assert got == {"A_M1": "current_A", "B_M1": "頻率", "C_M1": None}


def test_moments_equal_numpy(make, rows):
    p = rows.assign(bin_id=0)
    p.loc[5, "accOA"] = np.nan
    m = model.fit_bin_moments(make(p)).first()
    x = p[FEATURES]
    np.testing.assert_allclose(m["mean"], np.nanmean(x, axis=0))
    np.testing.assert_allclose(m.cov_inv, np.linalg.pinv(np.cov(x.dropna(), rowvar=False)), rtol=1e-8)
    assert m.n_train == 300 and m.n_complete == 299


def test_singular_covariance_uses_the_pseudo_inverse(make, rows):
    p = rows.assign(bin_id=0, Crest_Factor=3.0)
    m = model.fit_bin_moments(make(p)).first()
    want = np.linalg.pinv(np.cov(p[FEATURES], rowvar=False))
    np.testing.assert_allclose(m.cov_inv, want, rtol=1e-8, atol=1e-12)


def test_bins_with_one_complete_row_are_left_out(make, rows):
    p = rows.assign(bin_id=[1] + [0] * 299)
    assert [r.bin_id for r in model.fit_bin_moments(make(p)).collect()] == [0]


def test_lambda(make):
    p = pd.DataFrame({"device_id": "a", "bin_id": [0] * 5 + [1] * 2 + [2], "distance": [1, 2, 3, 4, 5, 0, 0, np.nan]})
    got = {r.bin_id: r["lambda"] for r in model.calibrate_lambda(make(p)).collect()}
    assert math.isclose(got[0], -math.log(0.8) / np.percentile([1, 2, 3, 4, 5], 95))
    assert got[1] == 1.0 and got[2] == 1.0


def test_scores(make, rows):
    df = make(rows)
    m = model.train_model(df)
    out = model.predict_scores(df, m).toPandas()
    assert out.health_score.between(0, 100).all()
    assert set(out.alert_level) <= {"Normal", "Warning", "Critical"}
    for _, part in out.groupby("load_bin"):  # the anchor: p95 of the distance scores 80
        assert abs(np.percentile(part.health_score, 5) - 80) < 0.5
    assert m.agg(F.sum("n_train")).first()[0] == 300
    means = out.groupby("load_bin").health_score.mean()
    got = {r.bin_id: r.avg_score for r in m.collect()}
    assert all(abs(got[b] - v) < 1e-9 for b, v in means.items())


def test_scores_do_not_depend_on_partitioning(make, rows):
    df = make(rows)
    m = model.train_model(df)
    a, b = [model.predict_scores(d, m).select("row_id", "health_score", "health_score_smooth").toPandas()
            .sort_values("row_id").reset_index(drop=True) for d in (df, df.repartition(7))]
    pd.testing.assert_frame_equal(a, b)


def test_missing_features_and_untrained_bins(make, rows):
    df = make(rows)
    m = model.train_model(df)
    odd = rows.head(3).copy()
    odd.loc[0, "accOA"] = np.nan
    odd.loc[1, "current_A"] = 99.0  # outside: bin 0
    out = model.predict_scores(make(odd), m).orderBy("row_id").collect()
    assert out[0].health_score is None and out[0].alert_level == "Unknown"
    assert out[0].health_score_smooth is not None
    assert out[1].load_bin == 0
    last = m.orderBy(F.desc("bin_id")).first()
    only_last = m.where(F.col("bin_id") == last.bin_id)
    got = model.bin_params_fallback(make(odd), only_last).select(F.col("_p")["lambda"].alias("x")).collect()
    assert {r.x for r in got} == {last["lambda"]}


def test_single_bin_without_load_column(make, rows):
    df = make(rows.drop(columns="current_A"))
    m = model.train_model(df).collect()
    assert len(m) == 1 and m[0].edges is None and m[0].bin_col is None
    out = model.predict_scores(df, model.train_model(df))
    assert out.where("load_bin <> 0 OR health_score IS NULL").count() == 0


def test_latest_score_and_last_alert(make, frame):
    p = frame(health_score=[90.0, 70.0, np.nan], alert_level=["Normal", "Warning", "Unknown"])
    assert tuple(diagnosis.latest_score(make(p)).first()) == ("P1_M1", 70.0, "Unknown")


def test_rows_are_not_dealt_by_machine(spark, make, rows, frame):
    """A table with one row per machine goes to the rows, whatever size Spark expects of it."""
    from rotorwatch.operators import baseline, clean, mapping
    from rotorwatch.session import materialize

    df = make(rows)
    trained = materialize(model.train_model(df), "model")
    devices = make(pd.DataFrame({"devicename": ["P1"], "tagname": ["T"], "machine_id": ["P1"], "model_group": ["A"], "row_no": [1],
                                 "train_start": [pd.Timestamp("2024-01-01")], "train_end": [pd.Timestamp("2024-02-01")]}))
    best = df.groupBy("device_id").agg(F.min("datetime").alias("start_date"), F.max("datetime").alias("end_date"), F.lit(1).alias("rank"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        for out in (
            model.score_rows(df, trained), model.with_bin_value(df, model.resolve_bin_column(df)), baseline.baseline_slice(df, best, devices),
            baseline.sliding_windows(df), clean.filter_running(df.withColumn("current_A", F.lit(2.0))),
            mapping.map_devices(df, devices), diagnosis.bin_range_check(model.score_rows(df, trained), trained),
        ):
            plan = out._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "Join" in line]
            assert any("BroadcastHashJoin" in line for line in joins)
            # Two tables of a row per machine may still meet by a sort.
            assert not any("SortMergeJoin" in line and ("Inner" in line or "LeftOuter" in line) for line in joins), joins
    finally:
        spark.conf.set(limit, before)
