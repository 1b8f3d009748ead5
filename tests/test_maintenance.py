import numpy as np
import pandas as pd
import pytest

from rotorwatch.operators import maintenance
from rotorwatch.plans.maintenance_effect import maintenance_report


@pytest.fixture(scope="module")
def log(make):
    return make(pd.DataFrame({"device_id": ["P1", "P1", "P2"], "event_ts": pd.to_datetime(["2024-01-02", "2030-01-01", "2024-01-02"]),
                              "event_name": "x"}))


def export(frame, n, **cols):
    base = dict(velRMS=[2.0] * (n // 2) + [1.0] * (n - n // 2), current=[10.0] * n, health_score=[60.0] * (n // 2) + [80.0] * (n - n // 2))
    return frame(minutes=int(2 * 1440 / n), **{**base, **cols})


def test_only_events_inside_the_data(make, frame, log):
    got = maintenance.maintenance_in_range(make(export(frame, 40)), log).collect()
    assert [(r.device_id, r.event_ts) for r in got] == [("P1_M1", pd.Timestamp("2024-01-02"))]


def test_effect_by_quartile(make, frame, log):
    p = export(frame, 40, 頻率=[float(k % 4) for k in range(40)])
    got = maintenance_report(make(p), log).orderBy("effect_bin").collect()
    assert sum(r.n_before + r.n_after for r in got) == 40
    assert all(r.velRMS_improve_pct == 50.0 and r.score_delta == 20.0 and r.load_comparable for r in got)
    edges = pd.qcut(p["頻率"], 4, duplicates="drop", retbins=True)[1]
    assert len(got) == len(edges) - 1
    np.testing.assert_allclose([r.bin_right for r in got], edges[1:])


def test_bins_with_one_side_are_dropped(make, frame, log):
    p = export(frame, 40, 頻率=[40.0] * 20 + [50.0] * 20)
    assert maintenance_report(make(p), log).count() == 0


def test_constant_frequency_is_one_bin(make, frame, log):
    got = maintenance_report(make(export(frame, 40, 頻率=[50.0] * 40)), log).collect()
    assert len(got) == 1 and (got[0].n_before, got[0].n_after) == (20, 20)


def test_too_few_rows(make, frame, log):
    assert maintenance_report(make(export(frame, 19, 頻率=[50.0] * 19)), log).count() == 0


def test_group_column_order(make, frame):
    ten, nine = [1.0] * 10, [1.0] * 9 + [np.nan]
    cases = [("A_M1", ten, ten), ("B_M1", nine, ten), ("C_M1", nine, nine)]
    p = pd.concat([frame(device=d, Freq=f, 輸入功率=w, current=nine) for d, f, w in cases])
    got = {r.device_id: r.group_col for r in maintenance.resolve_group_column(make(p), "current").collect()}
    assert got == {"A_M1": "Freq", "B_M1": "輸入功率", "C_M1": "current"}


def test_current_column(make):
    tags = make(pd.DataFrame({"device_id": ["A", "A", "B", "B", "C", "D"],
                              "variable_type": ["電流平均", "電流", "電流B", "Current", "amp", "Flow"], "row_no": range(6)}))
    got = {r.device_id: r.current_col for r in maintenance.resolve_current_column(tags).collect()}
    assert got == {"A": "電流", "B": "電流B", "C": "amp"}


def test_coverage(make, frame):
    p = frame(minutes=1440, current=[1.0, 1.0] + [np.nan] * 6)
    got = maintenance.alignment_coverage(make(p), "current").first()
    assert got.aligned_pct == 25.0 and got.ends_early
    assert not maintenance.alignment_coverage(make(p.head(5)), "current").first().ends_early
