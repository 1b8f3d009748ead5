"""Daily energy efficiency, its data gaps and the effect of maintenance."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.operators.energy import (
    daily_specific_power,
    energy_before_after,
    energy_split,
    outer_join_daily,
    role_tags,
)
from rotorwatch.operators.telemetry import detect_gaps
from rotorwatch.session import materialize


class EnergyReport(NamedTuple):
    daily: DataFrame
    gaps: DataFrame
    comparison: DataFrame


def energy_gaps(counters: DataFrame, tag_dim: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Gaps of the counters in use, each tag on its own clock."""
    used = counters.drop("device_id").join(F.broadcast(role_tags(tag_dim)), "tagname")
    return detect_gaps(used, ("device_id", "role", "tagname"), cfg=cfg).select(
        "device_id", F.col("role").alias("tag"), "gap_start", "gap_end", "gap_hours"
    )


def energy_report(
    counters: DataFrame, tag_dim: DataFrame, events: DataFrame, price: float | None = None,
    cfg: Settings = DEFAULTS,
) -> EnergyReport:
    # One row per device and day; read by the split, the medians and the caller.
    daily = materialize(
        daily_specific_power(outer_join_daily(counters, role_tags(tag_dim), cfg)), "energy-days"
    )
    comparison = energy_before_after(daily, energy_split(daily, events), price, cfg)
    return EnergyReport(daily, energy_gaps(counters, tag_dim, cfg), comparison)
