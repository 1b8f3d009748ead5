import numpy as np
import pandas as pd
import pytest

from rotorwatch.operators import energy, mapping, telemetry


@pytest.fixture(scope="module")
def tags(make):
    return make(pd.DataFrame({
        "tagname": ["K", "F", "R", "C", "C2"], "variable_type": ["Total kWh", "Flow", "RunHour", "電流", "電流"],
        "device_id": "P1", "unit": "", "row_no": range(5),
    }))


def counter(tag, values, hours=6):
    n = len(values)
    return pd.DataFrame({"tagname": tag, "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * hours, unit="h"),
                         "value": values, "row_id": range(n)})


def test_resets_and_null_readings(make):
    df = make(counter("K", [1.0, 4.0, 2.0, np.nan, 5.0, 9.0]))
    got = [r.delta for r in telemetry.counter_delta(df).orderBy("row_id").collect()]
    assert got == [None, 3.0, None, None, None, 4.0]
    assert tuple(telemetry.counter_resets(df).first()) == ("K", 6, 1)


def test_a_day_without_increment_is_null(make):
    df = make(counter("K", [5.0, 3.0, 1.0], hours=24))
    assert [r.total for r in telemetry.counter_daily_sum(df).orderBy("date").collect()] == [None, None, None]


def test_gaps(make):
    p = counter("K", [0.0] * 4)
    p["datetime"] = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:06", "2024-01-01 00:12:01", "2024-01-01 03:12:01"], format="ISO8601")
    got = telemetry.topk_gaps(telemetry.detect_gaps(make(p)), "tagname", 5).orderBy("rank").collect()
    assert [r.gap_hours for r in got] == [3.0, 0.1]
    assert telemetry.detect_gaps(make(p), interval_min=60).count() == 0


def test_pivot_averages_and_drops_empty_timestamps(make, tags):
    p = pd.concat([counter("C", [2.0, np.nan]), counter("C2", [4.0]), counter("X", [9.0])])
    got = telemetry.pivot_scada(make(p), tags).collect()
    assert len(got) == 1 and got[0]["電流"] == 3.0 and got[0]["Flow"] is None


def test_specific_power(make, tags):
    p = pd.concat([counter("K", [0.0, 10.0, 10.0, 10.0, 10.0, 10.0]), counter("F", [0.0, 5.0, 20.0, 30.0, 40.0]),
                   counter("R", [1.0, 2.0])])
    daily = energy.daily_specific_power(energy.outer_join_daily(make(p), energy.role_tags(tags)))
    got = daily.orderBy("date").collect()
    assert (got[0].kwh_sum, got[0].flow_sum, got[0].specific_power, got[0].running_hours) == (10.0, 30.0, 3.0, 1.0)
    assert (got[1].kwh_sum, got[1].specific_power, got[1].running_hours) == (0.0, None, None)


def test_roles_need_energy_and_flow(make, tags):
    assert {r.role for r in energy.role_tags(tags).collect()} == {"kwh", "flow", "run"}
    assert energy.role_tags(tags.where("tagname <> 'F'")).count() == 0
    amb = {r.variable_type: r for r in energy.first_tag_for_variable(tags).collect()}["電流"]
    assert (amb.tagname, amb.ambiguous) == ("C", True)


def days(n, **cols):
    return pd.DataFrame({"device_id": "P1", "date": pd.date_range("2024-01-01", periods=n).date, **cols})


def test_energy_comparison(make):
    daily = make(days(4, kwh_sum=[10.0, 10.0, 10.0, np.nan], flow_sum=[20.0, 20.0, 40.0, 10.0],
                      running_hours=[5.0, 5.0, 7.0, 7.0], specific_power=[2.0, 2.0, 4.0, np.nan]))
    log = make(pd.DataFrame({"device_id": "P1", "event_ts": pd.to_datetime(["2024-01-02", "2024-01-03", "2025-01-01"]), "event_name": "x"}))
    cut = energy.energy_split(daily, log)
    assert cut.first().split_date == pd.Timestamp("2024-01-03")
    got = energy.energy_before_after(daily, cut, price=2.0).first()
    assert (got.n_pre, got.n_post, got.improve_pct) == (2, 2, 100.0)
    assert (got.kwh_saved, got.cost_saved) == (15.0, 30.0)
    flag = energy.run_hours_confound(energy.energy_before_after(daily, cut)).first()
    assert flag.runhr_diff == 2.0 and flag.confounded


def test_mapping_checks(make, tags):
    seen = make(pd.concat([counter("K", [1.0]), counter("Z", [1.0])]))
    want = {("F", "mapped_not_seen"), ("R", "mapped_not_seen"), ("C", "mapped_not_seen"), ("C2", "mapped_not_seen"), ("Z", "seen_not_mapped")}
    for f in (mapping.anti_join_tags, mapping.except_tags):
        assert {tuple(r) for r in f(seen, tags).collect()} == want


def test_alignment_status(make, frame):
    vib = make(pd.concat([frame(device=f"{d}_M1", v=[1.0]) for d in ("A", "B", "C", "D")]))
    dim = make(pd.DataFrame({"devicename": ["A", "A", "B", "D"], "tagname": ["old", "K", "none", "late"], "machine_id": "m",
                             "model_group": "g", "row_no": range(4)}))
    cur = make(pd.concat([counter("K", [1.0]), counter("late", [1.0]).assign(datetime=pd.Timestamp("2030-01-01"))]))
    got = {r.device_id: r.status for r in mapping.alignment_status(vib, cur, dim).collect()}
    assert got == {"A_M1": "aligned", "B_M1": "tag_absent", "C_M1": "not_mapped", "D_M1": "no_overlap"}
    rows, _ = mapping.align_with_diagnostics(vib, cur, dim)
    assert {r.device_id: r.current_A for r in rows.collect()} == {"A_M1": 1.0, "B_M1": None, "C_M1": None, "D_M1": None}
    assert {r.status for r in mapping.alignment_status(vib, cur.where("false"), dim).collect()} == {"no_current_data"}
