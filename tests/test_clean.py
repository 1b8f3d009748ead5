import numpy as np

from rotorwatch.operators import clean


def ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


def test_derived_columns(make, frame):
    p = frame(velRMS_x=[3.0, np.nan], velRMS_y=[4.0, 1.0], velRMS_z=[0.0, 1.0], velPEAK=[2.0, 2.0], velRMS=[1.0, 1.0])
    rows = clean.derive_features(make(p)).orderBy("row_id").collect()
    assert rows[0].Total_vRMS == 5.0 and rows[1].Total_vRMS is None
    assert abs(rows[0].Crest_Factor - 2.0 / 1.000001) < 1e-12


def test_existing_and_missing_inputs(make, frame):
    out = clean.derive_features(make(frame(Total_vRMS=[7.0], accOA=[1.0]))).first()
    assert out.Total_vRMS == 7.0 and out.Crest_Factor is None


def test_rows_without_crest_factor(make, frame):
    df = make(frame(Crest_Factor=[20.0, 20.01, np.nan]))
    assert ids(clean.filter_spikes(df)) == [0]
    assert ids(clean.filter_spikes(df, keep_null_crest=True)) == [0, 2]


def test_any_current_switches_the_whole_machine(make, frame):
    import pandas as pd

    a = frame(device="A_M1", Total_vRMS=[1.0, 1.0, 1.0], current_A=[2.0, 1.0, np.nan])
    b = frame(device="B_M1", Total_vRMS=[1.0, 0.1, 0.2], current_A=[np.nan] * 3).assign(row_id=[10, 11, 12])
    df = make(pd.concat([a, b]))
    assert ids(clean.filter_running(df)) == [0, 10, 12]
    assert ids(clean.filter_running(df.drop("current_A"))) == [0, 1, 2, 10, 12]


def test_hybrid_judges_row_by_row(make, frame):
    df = make(frame(Total_vRMS=[0.0, 1.0, 1.0, 0.0], cur=[2.0, 1.0, np.nan, np.nan]))
    assert ids(clean.filter_running_hybrid(df, "cur")) == [0, 2]
    assert ids(clean.filter_running_hybrid(df, None)) == [1, 2]
    assert ids(clean.filter_running_hybrid(df, "cur", threshold=0.5)) == [0, 1, 2]


def test_clean_smooths_over_kept_rows_only(make, frame):
    p = frame(velRMS_x=[1.0] * 4, velRMS_y=[0.0] * 4, velRMS_z=[0.0] * 4, velPEAK=[1.0, 99.0, 1.0, 1.0],
              velRMS=[1.0] * 4, accOA=[1.0, 50.0, 3.0, 2.0])
    out = clean.clean_vibration(make(p)).orderBy("row_id").collect()
    assert [(r.row_id, r.accOA) for r in out] == [(0, 2.0), (2, 2.0), (3, 2.5)]
