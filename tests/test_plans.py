"""Whole analyses over data with the columns of the input files."""

import numpy as np
import pandas as pd
import pytest

from rotorwatch.config import Settings
from rotorwatch.plans.correlation_report import correlation_report
from rotorwatch.plans.health_scoring import score_machines
from rotorwatch.plans.maintenance_effect import export_rows, maintenance_report
from rotorwatch.plans.specific_power import energy_report
from rotorwatch.plans.validation import validate_inputs


@pytest.fixture(scope="module")
def plant(make, frame):
    rng = np.random.default_rng(11)
    n = 20 * 48  # 20 days, every half hour
    vib = pd.concat([frame(minutes=30, device=d, velRMS_x=rng.normal(1, 0.1, n), velRMS_y=rng.normal(1, 0.1, n),
                           velRMS_z=rng.normal(1, 0.1, n), velPEAK=rng.normal(3, 0.3, n), velRMS=rng.normal(1, 0.05, n),
                           accOA=rng.normal(0.5, 0.03, n), velOA=rng.random(n), accRMS=rng.random(n), HealthScore=rng.uniform(50, 90, n))
                     for d in ("P1_M1", "P1_M2", "P2_M1")])
    vib["row_id"] = range(len(vib))

    def tag(name, values, shift):
        return pd.DataFrame({"tagname": name, "datetime": frame(minutes=30, v=values).datetime + pd.Timedelta(minutes=shift), "value": values})

    tele = pd.concat([tag("C1", rng.uniform(5, 15, n), 2), tag("F1", rng.choice([40.0, 45.0, 50.0, 55.0], n), 2),
                      tag("K1", np.arange(n) * 2.0, 4), tag("W1", np.arange(n) * 5.0, 4)])
    tele["row_id"] = range(len(tele))
    dims = pd.DataFrame({"tagname": ["C1"], "devicename": ["P1"], "machine_id": ["Unit 1"], "model_group": ["g"],
                         "train_start": [pd.NaT], "train_end": [pd.NaT], "row_no": [0]})
    tags = pd.DataFrame({"tagname": ["C1", "F1", "K1", "W1"], "variable_type": ["電流", "頻率", "用電量", "流量"],
                         "device_id": "P1", "unit": "", "row_no": range(4)})
    log = pd.DataFrame({"device_id": ["P1"], "event_ts": [pd.Timestamp("2024-01-11")], "event_name": ["x"]})
    return {k: make(v) for k, v in dict(vib=vib, tele=tele, dims=dims, tags=tags, log=log).items()}


def scores(plant, cfg):
    run = score_machines(plant["vib"], plant["tele"], plant["dims"], plant["tele"], plant["tags"], cfg=cfg)
    return run, run.scored.toPandas().sort_values("row_id").reset_index(drop=True)


def test_scoring(plant):
    run, out = scores(plant, Settings())
    assert set(out.device_id) == {"P1_M1", "P1_M2", "P2_M1"}
    assert out.health_score.between(0, 100).all()
    bins = {(r.device_id, r.bin_id) for r in run.model.collect()}
    assert {d for d, b in bins if b > 0} == {"P1_M1", "P1_M2"}  # P2 has no load column
    summary = {r.machine_id: r for r in run.summary.collect()}
    assert set(summary) == {"Unit 1", "P2"} and summary["P2"].latest_score_M2 is None
    # Tiny slices give the same scores.
    _, split = scores(plant, Settings(block_rows=64, range_parts=6))
    np.testing.assert_allclose(split.health_score, out.health_score, rtol=1e-9)
    np.testing.assert_allclose(split.health_score_smooth, out.health_score_smooth, rtol=1e-9)


def test_maintenance(plant):
    rows = export_rows(plant["vib"], plant["tele"], plant["tags"])
    assert rows.columns[0] == "datetime" and "health_score" in rows.columns
    table = maintenance_report(rows, plant["log"]).collect()
    assert {r.device_id for r in table} == {"P1_M1", "P1_M2"}
    assert sum(r.n_before + r.n_after for r in table if r.device_id == "P1_M1") > 900


def test_energy(plant):
    report = energy_report(plant["tele"].select("tagname", "datetime", "value", "row_id"), plant["tags"], plant["log"], price=1.0)
    ratio = {round(r.specific_power, 9) for r in report.daily.collect()}
    assert ratio == {2.5}
    got = report.comparison.first()
    assert got.improve_pct == 0.0 and abs(got.kwh_saved) < 1e-6
    assert {r.tag for r in report.gaps.select("tag").distinct().collect()} == {"kwh", "flow"}


def test_correlation(plant):
    table = correlation_report(plant["vib"], plant["tele"], plant["tags"], with_score=True)
    rows = table.collect()
    assert {r.vibration_feature for r in rows} == {"Total_vRMS", "accOA", "Crest_Factor", "HealthScore"}
    assert all(0 <= float(r.pearson_p) <= 1 for r in rows)


def test_validation(plant):
    got = {r.device_id: r for r in validate_inputs(plant["vib"], plant["tele"], plant["dims"]).collect()}
    assert got["P1_M1"].has_current and got["P1_M1"].has_m2 and got["P1_M1"].passed
    assert not got["P2_M1"].has_current and not got["P2_M1"].has_m2
