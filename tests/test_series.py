import numpy as np
import pandas as pd
import pytest

from rotorwatch.config import Settings
from rotorwatch.operators import series

SMALL = Settings(block_rows=37, range_parts=9)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    n = 1500
    p = pd.DataFrame({
        "k": rng.choice(list("ab"), n, p=[0.8, 0.2]),
        "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200 * 3600, n), unit="s"),
        "row_id": np.arange(n), "x": rng.random(n).round(2),
    })
    p.loc[rng.random(n) < 0.5, "x"] = np.nan
    p = p.sort_values(["datetime", "row_id"]).reset_index(drop=True)
    for k in "ab":  # a gap at the start, one inside, one at the end
        i = p.index[p.k == k]
        p.loc[[*i[:7], *i[50:70], *i[-9:]], "x"] = np.nan
    return p


def check(df, expected, col):
    got = df.select("row_id", col).toPandas().sort_values("row_id")[col].astype(float).to_numpy()
    want = expected.sort_values("row_id")[col].astype(float).to_numpy()
    np.testing.assert_allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("rows", [1, 3, 4, 5])
def test_rolling_median_equals_pandas(make, data, rows):
    want = data.assign(x=data.groupby("k")["x"].transform(
        lambda c: c.rolling(rows, center=True, min_periods=1).median().ffill().bfill()))
    check(series.rolling_median(make(data), ["k"], ["x"], rows, cfg=SMALL), want, "x")


def test_rolling_median_without_fill(make, data):
    want = data.assign(x=data.groupby("k")["x"].transform(
        lambda c: c.rolling(3, center=True, min_periods=1).median()))
    check(series.rolling_median(make(data), ["k"], ["x"], 3, fill=False, cfg=SMALL), want, "x")


def test_slices_do_not_change_results(make, data):
    a = series.rolling_median(make(data), ["k"], ["x"], 5, cfg=SMALL).toPandas()
    b = series.rolling_median(make(data), ["k"], ["x"], 5).repartition(3).toPandas()
    pd.testing.assert_frame_equal(*[f.sort_values("row_id").reset_index(drop=True) for f in (a, b)])


def test_column_that_is_always_null_stays_null(make, data):
    df = series.rolling_median(make(data.assign(x=np.nan)), ["k"], ["x"], 3, cfg=SMALL)
    assert df.where("x IS NOT NULL").count() == 0


def test_fill_previous_and_position(make, data):
    g = data.groupby("k")["x"]
    check(series.fill_gaps(make(data), ["k"], ["x"], cfg=SMALL), data.assign(x=g.transform(lambda c: c.ffill().bfill())), "x")
    check(series.with_previous(make(data), ["k"], ["x"], cfg=SMALL), data.assign(prev_x=g.shift()), "prev_x")
    check(series.with_position(make(data), ["k"], cfg=SMALL), data.assign(pos=data.groupby("k").cumcount()), "pos")


def test_equal_timestamps_are_ordered_by_row_id(make):
    p = pd.DataFrame({"k": "a", "datetime": pd.Timestamp("2024-01-01"), "row_id": [3, 1, 2], "x": [3.0, 1.0, 2.0]})
    df = series.with_previous(make(p), ["k"], ["x"])
    assert [(r.row_id, r.prev_x) for r in df.orderBy("row_id").collect()] == [(1, None), (2, 1.0), (3, 2.0)]


def test_no_row_is_lost_without_time_or_key(spark):
    from rotorwatch.operators.series import fill_gaps, rolling_median, with_position, with_previous

    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 00:00:00', 1L, 1.0D), ('a', NULL, 2L, 2.0D), "
                     "(NULL, timestamp_ntz'2024-01-01 00:00:00', 3L, 3.0D), (NULL, timestamp_ntz'2024-01-01 05:00:00', 4L, NULL) "
                     "AS t(device_id, datetime, row_id, x)")
    pos = {r.row_id: r.pos for r in with_position(rows, ["device_id"]).collect()}
    assert pos == {2: 0, 1: 1, 3: 0, 4: 1}
    assert {r.row_id: r.prev_x for r in with_previous(rows, ["device_id"], ["x"]).collect()} == {2: None, 1: 2.0, 3: None, 4: 3.0}
    assert {r.row_id: r.x for r in fill_gaps(rows, ["device_id"], ["x"]).collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0}
    assert {r.row_id: r.x for r in rolling_median(rows, ["device_id"], ["x"], 3).collect()} == {1: 1.5, 2: 1.5, 3: 3.0, 4: 3.0}


def crowded(n=6000):
    """One machine with 30 % of all rows in one hour, one with half of its times missing."""
    rng = np.random.default_rng(8)
    hour = rng.random(n) < 0.3
    seconds = np.where(hour, rng.integers(500 * 3600, 501 * 3600, n), rng.integers(0, 1000 * 3600, n))
    p = pd.DataFrame({"k": np.where(hour | (rng.random(n) < 0.3), "a", rng.choice(list("bc"), n)),
                      "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"),
                      "row_id": rng.permutation(n), "x": rng.random(n).round(2)})
    p.loc[(p.k == "b") & (p.row_id % 2 == 0), "datetime"] = pd.NaT
    p.loc[rng.random(n) < 0.3, "x"] = np.nan
    return p.sort_values(["datetime", "row_id"], na_position="first").reset_index(drop=True)


def test_parts_hold_equally_many_rows_and_results_stay(make):
    p, cfg = crowded(), Settings(block_rows=500, range_parts=12)
    df = make(p)
    sizes = [r["count"] for r in series.in_parts(df, ["k"], series.TIME_ORDER, cfg).groupBy("_part").count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * np.median(sizes)
    g = p.groupby("k")["x"]
    check(series.with_previous(df, ["k"], ["x"], cfg=cfg), p.assign(prev_x=g.shift()), "prev_x")
    check(series.with_position(df, ["k"], cfg=cfg), p.assign(pos=p.groupby("k").cumcount()), "pos")
    check(series.fill_gaps(df, ["k"], ["x"], cfg=cfg), p.assign(x=g.transform(lambda c: c.ffill().bfill())), "x")
    want = p.assign(x=g.transform(lambda c: c.rolling(5, center=True, min_periods=1).median().ffill().bfill()))
    check(series.rolling_median(df, ["k"], ["x"], 5, cfg=cfg), want, "x")


def test_source_is_read_once(make, data):
    df = make(data)
    source = df.inputFiles()[0].rsplit("/", 1)[1]
    for out in (series.with_previous(df, ["k"], ["x"]), series.with_position(df, ["k"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert source not in plan and not any(source in f for f in out.inputFiles())
        assert len(out.inputFiles()) >= 1 and plan.count("partitionBy") == 0
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_part" in line for line in windows)


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 7])
def test_frames_reach_over_parts_of_few_rows(make, rows):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"k": rng.choice(list("ab"), 60), "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(60), unit="h"),
                      "row_id": np.arange(60), "x": rng.random(60).round(2), "y": rng.random(60)})
    p.loc[rng.random(60) < 0.4, "x"] = np.nan
    df = make(p)
    for fill in (True, False):
        got = series.rolling_median(df, ["k"], ["x", "y"], rows, fill=fill, cfg=Settings(range_parts=40))
        for c in "xy":
            mid = p.groupby("k")[c].transform(lambda v: v.rolling(rows, center=True, min_periods=1).median())
            check(got, p.assign(**{c: mid.groupby(p.k).transform(lambda v: v.ffill().bfill()) if fill else mid}), c)


def test_frames_copy_no_row(make, data):
    plan = series.rolling_median(make(data), ["k"], ["x"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(x" in plan and "Generate" not in plan
