import os
import sys
import tempfile

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rotorwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="rotorwatch-tests-")},
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def make(spark):
    """pandas frame -> Spark frame; NaN becomes NULL, timestamps have no zone."""
    folder = tempfile.mkdtemp(prefix="rotorwatch-frames-")
    count = [0]

    def build(pdf: pd.DataFrame):
        pdf = pdf.copy().reset_index(drop=True)
        for c in pdf.columns:
            if pd.api.types.is_datetime64_any_dtype(pdf[c]):
                pdf[c] = pdf[c].astype("datetime64[us]")
        count[0] += 1
        path = f"{folder}/{count[0]}.parquet"
        pdf.to_parquet(path)
        return spark.read.parquet(path)

    return build


@pytest.fixture(scope="session")
def frame():
    """Evenly spaced rows of one machine from keyword columns."""

    def build(minutes=10, device="P1_M1", start="2024-01-01", **cols):
        n = len(next(iter(cols.values())))
        return pd.DataFrame({
            "device_id": device, "devicename": device[:-3], "position": device[-2:],
            "datetime": pd.Timestamp(start) + pd.to_timedelta([k * minutes for k in range(n)], unit="min"),
            "row_id": range(n), **cols,
        })

    return build
