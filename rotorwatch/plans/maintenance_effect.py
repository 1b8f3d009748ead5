"""Aligned export rows and the maintenance effect at equal operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULT_CURRENT_TYPE, DEFAULTS, Settings
from rotorwatch.operators.clean import derive_features, filter_running_hybrid, filter_spikes
from rotorwatch.operators.maintenance import (
    effect_binning,
    label_period,
    maintenance_effect,
    maintenance_in_range,
    resolve_current_column,
    resolve_group_column,
    with_group_value,
)
from rotorwatch.operators.mapping import asof_scada_wide
from rotorwatch.operators.telemetry import pivot_scada
from rotorwatch.session import materialize


def export_rows(
    vib: DataFrame, telemetry: DataFrame, tag_dim: DataFrame, threshold: float | None = None,
    current_type: str = DEFAULT_CURRENT_TYPE, tolerance_s: int | None = None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Running rows with telemetry, one wide table for all measuring points.
    ``current`` is the device's own current variable; no smoothing here."""
    rows = filter_spikes(derive_features(vib), cfg=cfg)
    wide = pivot_scada(telemetry, tag_dim)
    variables = [c for c in wide.columns if c not in ("device_id", "datetime")]
    rows = asof_scada_wide(rows, wide, tolerance_s, cfg)
    chosen = resolve_current_column(tag_dim, current_type).withColumnRenamed("device_id", "devicename")
    value = F.coalesce(*[F.when(F.col("current_col") == v, F.col(v)) for v in variables])
    rows = rows.join(chosen, "devicename", "left").withColumn("current", value).drop("current_col")
    rows = filter_running_hybrid(rows, "current", threshold, cfg)
    if "HealthScore" in rows.columns and "health_score" not in rows.columns:
        rows = rows.withColumnRenamed("HealthScore", "health_score")
    first = ["datetime"]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def maintenance_report(exported: DataFrame, events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """The before/after table of every measuring point with an event in range."""
    # Both tables are read by a size check, an aggregate and the next step.
    rows = materialize(exported, "exported")
    inside = maintenance_in_range(rows, events)
    grouped = with_group_value(rows, resolve_group_column(rows, "current"))
    labelled = materialize(label_period(grouped, inside), "labelled")
    return maintenance_effect(effect_binning(labelled, cfg=cfg), current="current", cfg=cfg)
