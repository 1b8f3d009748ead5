import numpy as np
import pandas as pd
import pytest

from rotorwatch.operators import baseline


@pytest.fixture(scope="module")
def month(frame):
    rng = np.random.default_rng(1)
    n = 30 * 24
    p = frame(minutes=60, accOA=rng.normal(1, 0.1, n), Total_vRMS=rng.normal(2, 0.1, n), Crest_Factor=rng.normal(3, 0.1, n))
    return p[rng.random(n) < 0.9]


def loop(p):
    """Windows by stepping through time, one at a time."""
    out, t0, t1 = [], p.datetime.min(), p.datetime.max()
    start, width, day = t0, pd.Timedelta(days=14), pd.Timedelta(days=1)
    while start + width <= t1 + day:
        w = p[(p.datetime >= start) & (p.datetime < start + width)]
        out.append((start, len(w), w.accOA.median(), w.accOA.std() / w.accOA.mean()))
        start += day
    return out


def test_windows_equal_a_loop(make, month):
    got = baseline.window_stability(make(month)).orderBy("start_date").toPandas()
    want = loop(month)
    assert list(got.start_date) == [w[0] for w in want]
    assert list(got.n_rows) == [w[1] for w in want]
    np.testing.assert_allclose(got.accOA_median, [w[2] for w in want], atol=1e-6)
    np.testing.assert_allclose(got.accOA_cv, [w[3] for w in want], atol=1e-6)


def test_rows_are_not_copied_into_windows(spark, make, month):
    """Only counts pass a generator below the one that lists columns."""
    plan = baseline.window_stability(make(month))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(CASE WHEN" not in plan.split("Aggregate")[-1]


def test_short_series_is_one_window_without_its_last_row(make, month):
    short = month[month.datetime < month.datetime.min() + pd.Timedelta(days=13.9)]
    df = make(short)
    w = baseline.window_stability(df).collect()
    assert len(w) == 1 and w[0].n_rows == len(short) and w[0].end_date == short.datetime.max()
    cut = baseline.baseline_slice(df, baseline.detect_baseline(df))
    assert cut.count() == len(short) - 1


def test_too_few_rows_give_no_candidate(make, month):
    assert baseline.detect_baseline(make(month.head(14))).count() == 0
    empty_acc = month.assign(accOA=np.nan)
    assert baseline.detect_baseline(make(empty_acc)).count() == 0


def windows(**cols):
    n = len(cols["stability_score"])
    p = pd.DataFrame({"device_id": "a", "start_date": pd.date_range("2024-01-01", periods=n), **cols})
    for c in ("accOA_cv", "vRMS_cv", "cf_cv"):
        p[c] = p.get(c, pd.Series([0.01] * n)).astype(float)
    return p


def test_relax_when_none_passes(make):
    df = make(windows(stability_score=[1.0, 2.0], accOA_cv=[0.5, 0.5]))
    assert baseline.cv_filter_relax(df).count() == 2


def test_limits_are_exclusive_and_absent_features_not_tested(make):
    df = make(windows(stability_score=[1.0, 2.0], accOA_cv=[0.2, 0.19], cf_cv=[np.nan, np.nan]))
    assert [r.stability_score for r in baseline.cv_filter_relax(df).collect()] == [2.0]


def test_a_null_variation_fails_when_others_have_one(make):
    df = make(windows(stability_score=[1.0, 2.0], vRMS_cv=[np.nan, 0.1]))
    assert [r.stability_score for r in baseline.cv_filter_relax(df).collect()] == [2.0]


def test_manual_period_wins_unless_empty(make, month):
    df = make(month)
    cands = baseline.detect_baseline(df)

    def dim(start):
        return make(pd.DataFrame({
            "devicename": ["P1"], "tagname": ["t"], "machine_id": ["m"], "model_group": ["g"],
            "train_start": [pd.Timestamp(start)], "train_end": [pd.Timestamp(start) + pd.Timedelta(days=2)], "row_no": [0],
        }))

    used = baseline.baseline_slice(df, cands, dim("2024-01-05"))
    assert used.where("NOT is_manual").count() == 0
    inside = (month.datetime >= "2024-01-05") & (month.datetime <= "2024-01-07")
    assert used.count() == inside.sum()
    auto = baseline.baseline_slice(df, cands, dim("2030-01-05"))
    assert auto.where("is_manual").count() == 0 and auto.count() == cands.where("rank = 1").first().n_rows


def test_few_values_are_copied_into_windows(make, month, monkeypatch):
    copied, windows_of = [], baseline._windows_of

    def counted(df, cfg):
        if "_v" in df.columns:
            copied.append(df.count())
        return windows_of(df, cfg)

    monkeypatch.setattr(baseline, "_windows_of", counted)
    got = baseline.window_stability(make(month)).orderBy("start_date").toPandas()
    np.testing.assert_allclose(got.accOA_median, [w[2] for w in loop(month)], atol=1e-6)
    assert 0 < sum(copied) < 0.4 * 2 * len(month)
    copied.clear()
    tied = month.assign(accOA=(month.accOA * 5).round(), Total_vRMS=month.Total_vRMS.where(month.index % 3 > 0))
    got = baseline.window_stability(make(tied)).orderBy("start_date").toPandas()
    np.testing.assert_allclose(got.accOA_median, [w[2] for w in loop(tied)], atol=1e-6)
