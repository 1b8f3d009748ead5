import numpy as np
import pandas as pd

from rotorwatch.operators import fleet


def test_zero_and_null_scores_do_not_count(make, frame):
    p = frame(HealthScore=[80.0, 0.0, np.nan, 90.0])
    got = fleet.device_health_stats(make(p)).first()
    assert (got.n_total, got.n_valid, got.n_excluded, got.excluded_pct, got.mean) == (4, 2, 2, 50.0, 85.0)
    assert fleet.device_health_stats(make(p.assign(HealthScore=0.0))).count() == 0


def test_trend(make, frame):
    up = frame(minutes=1440, device="A_M1", HealthScore=[80 + 0.1 * k for k in range(10)])
    flat = frame(minutes=1440, device="B_M1", HealthScore=[80 + 0.01 * k for k in range(10)])
    few = frame(minutes=1440, device="C_M1", HealthScore=[80.0, 1.0, 2.0, 3.0])
    same = frame(minutes=0, device="D_M1", HealthScore=[80.0] * 6)
    got = {r.device_id: r for r in fleet.health_trend(make(pd.concat([up, flat, few, same]))).collect()}
    assert got["A_M1"].slope_per_month == 3.0 and got["A_M1"].trend_label == "rising"
    assert abs(got["A_M1"].intercept - 80) < 1e-9
    assert got["B_M1"].trend_label == "flat"
    assert got["C_M1"].trend_label == "insufficient" and got["D_M1"].trend_label == "insufficient"


def test_halves_and_recent(make, frame):
    p = frame(minutes=1440, HealthScore=[50.0, 50.0, 100.0, 100.0, 100.0])
    half = fleet.half_period_change(make(p)).first()
    assert (half.first_half_mean, half.second_half_mean, half.half_change_pct) == (50.0, 100.0, 100.0)
    recent = fleet.recent_window_mean(make(p), days=3).first()
    assert (recent.recent_mean, recent.recent_n) == (87.5, 4)


def test_fleet_average_weighs_machines_equally(make, frame):
    a = frame(minutes=60, device="A_M1", HealthScore=[90.0] * 10)
    b = frame(minutes=60, device="B_M1", HealthScore=[70.0])
    got = fleet.daily_fleet_average(fleet.daily_device_scores(make(pd.concat([a, b])))).collect()
    assert [(r.avg_score, r.n_devices) for r in got] == [(80.0, 2)]


def records(**kw):
    base = dict(machine_id="m", model_group="g", position="M1", latest_score=90.0, baseline_start=pd.Timestamp("2024-01-01").date(),
                baseline_end=pd.Timestamp("2024-01-15").date(), data_count=5)
    return {**base, **kw}


def test_machine_summary(make):
    later = pd.Timestamp("2024-02-01").date()
    p = pd.DataFrame([records(), records(position="M2", latest_score=55.0, baseline_start=later),
                      records(machine_id="single", position="M2", latest_score=75.0, baseline_start=later),
                      records(machine_id="none", latest_score=np.nan)])
    got = {r.machine_id: r for r in fleet.device_summary(make(p)).collect()}
    assert (got["m"].overall_score, got["m"].alert_level, got["m"].data_count) == (55.0, "Critical", 10)
    assert got["m"].baseline_start == pd.Timestamp("2024-01-01").date()
    assert got["single"].latest_score_M1 is None and got["single"].alert_level == "Warning"
    assert got["single"].baseline_start == later
    assert got["none"].alert_level == "Unknown"


def test_validation(make, frame):
    a = frame(device="A_M1", current_A=[1.0] * 12)
    b = frame(device="A_M2", current_A=[np.nan] * 3)
    rows = make(pd.concat([a, b]))
    got = {r.device_id: r for r in fleet.validation_summary(rows, rows.where("device_id = 'A_M1'")).collect()}
    assert got["A_M1"].passed and got["A_M1"].has_current and got["A_M1"].has_m2
    assert (got["A_M2"].row_count, got["A_M2"].passed, got["A_M2"].has_current) == (0, False, False)


def test_halves_and_recent_equal_rows(make, monkeypatch):
    """Borders within days, on day borders, single rows, missing times and scores."""
    rng = np.random.default_rng(11)
    parts = []
    for k, (n, hours) in enumerate([(500, 900), (40, 20), (1, 1), (7, 24 * 7), (300, 24 * 60)]):
        p = pd.DataFrame({"device_id": f"P{k}_M1", "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, hours * 60, n), unit="min"),
                          "HealthScore": rng.integers(0, 100, n) * 1.0})
        p.loc[rng.random(n) < 0.1, "HealthScore"] = np.nan
        p.loc[0, "HealthScore"] = 55.0
        parts.append(p)
    p = pd.concat(parts, ignore_index=True)
    p.loc[[3, 9, 505], "datetime"] = pd.NaT
    valid = p[p.HealthScore.notna() & (p.HealthScore != 0)]
    read, write = [], fleet.materialize

    def counted(df, name):
        read.append(write(df, name))
        return read[-1]

    monkeypatch.setattr(fleet, "materialize", counted)
    halves = fleet.half_period_change(make(p))
    got = {r.device_id: r for r in halves.collect()}
    recent = {r.device_id: r for r in fleet.recent_window_mean(make(p), days=9).collect()}
    for d, g in valid.groupby("device_id"):
        t = g.datetime.dropna()
        middle = t.min() + ((t.max() - t.min()) // 2).floor("us")
        first, second, last = g[g.datetime < middle], g[g.datetime >= middle], g[g.datetime >= t.max() - pd.Timedelta(days=9)]
        for have, want in ((got[d].first_half_mean, first), (got[d].second_half_mean, second), (recent[d].recent_mean, last)):
            assert (have is None and want.empty) or abs(have - want.HealthScore.mean()) <= 0.00501
        assert recent[d].recent_n == len(last)
    # Only rows of the cut days are read again: the join is by machine and day.
    joins = [x for x in halves._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and all("_day#" in x for x in joins) and read[0].count() < len(valid)
