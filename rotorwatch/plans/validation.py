"""Data checks before any model is trained."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.operators.clean import clean_vibration
from rotorwatch.operators.fleet import validation_summary
from rotorwatch.operators.mapping import asof_current
from rotorwatch.session import materialize


def validate_inputs(
    vib: DataFrame, current: DataFrame, device_dim: DataFrame, tolerance_s: int | None = None,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    aligned = materialize(asof_current(vib, current, device_dim, tolerance_s, cfg), "aligned")
    return validation_summary(aligned, clean_vibration(aligned, cfg=cfg))
