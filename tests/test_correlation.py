"""Correlations from counted cells."""

import numpy as np
import pandas as pd
import pytest

from rotorwatch.operators import quantiles
from rotorwatch.operators.correlation import correlation_matrix


@pytest.fixture
def table():
    """Set-point like telemetry: half of all rows hold one value, the features too few to differ often."""
    rng = np.random.default_rng(2)
    n = 4000
    p = pd.DataFrame({"device_id": rng.choice(["P1_M1", "P1_M1", "P2_M1"], n),
                      "hz": np.where(rng.random(n) < 0.5, 50.0, rng.integers(30, 60, n)), "amp": rng.normal(1e6, 1.0, n),
                      "flat": 3.0})
    p["accOA"] = (p.hz / 50 + rng.normal(size=n)).round(1)
    p["vRMS"] = (p.amp - 1e6 + rng.normal(size=n)).round(1)
    p.loc[rng.random(n) < 0.2, "accOA"] = np.nan
    p.loc[rng.random(n) < 0.1, "hz"] = np.nan
    return p


def test_equals_pandas(make, table):
    got = correlation_matrix(make(table), ["hz", "amp", "flat"], ["accOA", "vRMS"]).toPandas()
    assert set(got.variable_type) == {"hz", "amp"} and len(got) == 8
    for r in got.itertuples():
        both = table[table.device_id == r.device_id][[r.variable_type, r.vibration_feature]].dropna()
        a, b = both.iloc[:, 0], both.iloc[:, 1]
        assert r.n_samples == len(both)
        assert r.pearson_raw == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
        assert r.spearman_raw == pytest.approx(np.corrcoef(a.rank(), b.rank())[0, 1], abs=1e-12)


def test_rows_are_counted_first_and_no_join_has_a_value_for_a_key(make, table, monkeypatch):
    sizes, write = [], quantiles.materialize

    def counted(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(quantiles, "materialize", counted)
    out = correlation_matrix(make(table), ["hz"], ["accOA"])
    both = table[["device_id", "hz", "accOA"]].dropna()
    assert sizes == [len(both.drop_duplicates())] * 2 and sizes[0] < len(both) / 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("_p#" in line and "(x#" not in line and "(y#" not in line for line in joins)
