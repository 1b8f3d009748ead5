import numpy as np
import pandas as pd
import pytest

from rotorwatch.config import Settings
from rotorwatch.operators.asof import asof_nearest

T0 = pd.Timestamp("2024-01-01 12:00:00")


def sec(*s):
    return [T0 + pd.Timedelta(seconds=x) for x in s]


def run(make, left, right, tol=300, **kw):
    l = pd.DataFrame({"k": "a", "datetime": left, "row_id": range(len(left))})
    return [tuple(r) for r in asof_nearest(make(l), make(right), ["k"], ["v", "w"], tol, **kw)
            .orderBy("row_id").select("v", "w").collect()]


def right(times, v, w=None):
    return pd.DataFrame({"k": "a", "datetime": times, "v": v, "w": w if w is not None else v, "o": range(len(v))})


def test_equal_distance_takes_the_earlier_row(make):
    assert run(make, sec(10), right(sec(0, 20), [1.0, 2.0])) == [(1.0, 1.0)]


def test_tolerance_is_inclusive(make):
    r = right(sec(0), [1.0])
    assert run(make, sec(300, 301, -300, -301), r) == [(1.0, 1.0), (None, None), (1.0, 1.0), (None, None)]


def test_duplicates_last_behind_first_ahead(make):
    r = right(sec(0, 0, 0), [1.0, 2.0, 3.0])
    assert run(make, sec(0, 5, -5), r, right_order="o") == [(3.0, 3.0), (3.0, 3.0), (1.0, 1.0)]


def test_nulls_of_the_nearest_row_are_kept(make):
    r = right(sec(0, 60), [1.0, 2.0], [np.nan, 5.0])
    assert run(make, sec(10), r) == [(1.0, None)]


def test_other_keys_do_not_match(make):
    r = right(sec(0), [1.0]).assign(k="b")
    assert run(make, sec(0), r) == [(None, None)]


@pytest.mark.parametrize("tol", [30, 300, 20000])
@pytest.mark.parametrize("parts", [0, 13])
def test_equals_merge_asof(make, tol, parts):
    rng = np.random.default_rng(tol)
    n = 800
    l = pd.DataFrame({"k": rng.choice(["a", "b"], n), "datetime": T0 + pd.to_timedelta(rng.integers(0, 90000, n), unit="s"),
                      "row_id": range(n)}).sort_values("datetime")
    r = pd.DataFrame({"k": rng.choice(["a", "b"], n), "datetime": T0 + pd.to_timedelta(rng.integers(0, 90000, n), unit="s"),
                      "v": rng.random(n), "o": range(n)}).sort_values(["datetime", "o"])
    want = pd.merge_asof(l, r, on="datetime", by="k", direction="nearest", tolerance=pd.Timedelta(seconds=tol))
    got = asof_nearest(make(l), make(r), ["k"], ["v"], tol, right_order="o", cfg=Settings(range_parts=parts)).toPandas()
    np.testing.assert_allclose(got.sort_values("row_id")["v"].astype(float), want.sort_values("row_id")["v"], equal_nan=True)


def test_null_keys_match_nothing(spark):
    from rotorwatch.operators.asof import asof_nearest

    left = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp_ntz'2024-01-01 00:00:00'), (2, NULL, timestamp_ntz'2024-01-01 00:00:00'), "
                     "(3, 'a', NULL) AS t(n, k, datetime)")
    right = spark.sql("SELECT * FROM VALUES ('a', 1.0D, timestamp_ntz'2024-01-01 00:00:10'), (NULL, 5.0D, timestamp_ntz'2024-01-01 00:00:00'), "
                      "('a', 7.0D, NULL) AS t(k, x, datetime)")
    got = {r.n: r.x for r in asof_nearest(left, right, ["k"], ["x"]).collect()}
    assert got == {1: 1.0, 2: None, 3: None}


def test_a_dense_hour_spreads_over_parts(make, monkeypatch):
    """30 % of all rows in one hour of one key, many of them at one instant."""
    from rotorwatch.operators import asof

    rng = np.random.default_rng(6)
    n = 6000
    dense = rng.random(n) < 0.3

    def times(seconds):
        return T0 + pd.to_timedelta(np.where(dense, 400_000 + seconds % 3600, seconds), unit="s")

    at = rng.integers(0, 900_000, n)
    at[dense & (rng.random(n) < 0.5)] = 1800
    key = np.where(dense, "a", rng.choice(list("abc"), n))
    l = pd.DataFrame({"k": key, "datetime": times(at), "row_id": range(n)}).sort_values("datetime")
    r = pd.DataFrame({"k": key, "datetime": times(rng.integers(0, 900_000, n)), "v": rng.random(n), "o": range(n)}).sort_values(["datetime", "o"])
    sizes, deal = [], asof.in_parts

    def counted(*a):
        parts = deal(*a)
        sizes.extend(x["count"] for x in parts.groupBy("_part").count().collect())
        return parts

    monkeypatch.setattr(asof, "in_parts", counted)
    got = asof_nearest(make(l), make(r), ["k"], ["v"], 300, right_order="o", cfg=Settings(range_parts=10))
    windows = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("_part" in x for x in windows)
    want = pd.merge_asof(l, r, on="datetime", by="k", direction="nearest", tolerance=pd.Timedelta(seconds=300))
    np.testing.assert_allclose(got.toPandas().sort_values("row_id")["v"].astype(float), want.sort_values("row_id")["v"], equal_nan=True)
    assert len(sizes) == 10 and max(sizes) <= 2 * np.median(sizes)
