"""Correlation of telemetry with vibration features for every measuring point."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.operators.clean import clean_vibration
from rotorwatch.operators.correlation import correlation_matrix, with_p_values
from rotorwatch.operators.mapping import asof_scada_wide
from rotorwatch.operators.telemetry import pivot_scada, variable_types
from rotorwatch.session import materialize


def paired_rows(
    vib: DataFrame, telemetry: DataFrame, tag_dim: DataFrame, tolerance_s: int | None = None,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Clean vibration rows with the telemetry of the nearest timestamp."""
    wide = pivot_scada(telemetry, tag_dim)
    return asof_scada_wide(clean_vibration(vib, cfg=cfg), wide, tolerance_s, cfg)


def correlation_report(
    vib: DataFrame, telemetry: DataFrame, tag_dim: DataFrame, with_score=False,
    tolerance_s: int | None = None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """r, p and n of each pair. ``with_score`` adds the external HealthScore."""
    features = [*cfg.features, *(["HealthScore"] if with_score else [])]
    rows = materialize(paired_rows(vib, telemetry, tag_dim, tolerance_s, cfg), "paired")
    table = correlation_matrix(rows, variable_types(tag_dim), [f for f in features if f in rows.columns], cfg=cfg)
    return with_p_values(table)
