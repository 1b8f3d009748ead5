"""Derived features, filters and smoothing of vibration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.functions.scoring import crest_factor, total_vrms
from rotorwatch.operators.series import TIME_ORDER, rolling_median


def derive_features(df: DataFrame) -> DataFrame:
    """Add ``Total_vRMS`` and ``Crest_Factor``; an existing column is kept, and a
    missing input gives NULL."""
    have = set(df.columns)

    def value(needs, expr: Column) -> Column:
        return expr if needs <= have else F.lit(None).cast("double")

    if "Total_vRMS" not in have:
        df = df.withColumn("Total_vRMS", value({"velRMS_x", "velRMS_y", "velRMS_z"}, total_vrms()))
    if "Crest_Factor" not in have:
        df = df.withColumn("Crest_Factor", value({"velPEAK", "velRMS"}, crest_factor()))
    return df


def filter_spikes(df: DataFrame, keep_null_crest=False, cfg: Settings = DEFAULTS) -> DataFrame:
    """Drop sensor spikes. Rows without a crest factor go too, unless kept on request."""
    if "Crest_Factor" not in df.columns:
        return df
    ok = F.col("Crest_Factor") <= cfg.crest_spike
    return df.where(ok | F.col("Crest_Factor").isNull() if keep_null_crest else ok)


def filter_running(
    df: DataFrame, key="device_id", current="current_A", cfg: Settings = DEFAULTS
) -> DataFrame:
    """Keep rows of running machines.

    A machine with any current reading is judged by current alone, so its rows
    without a reading go; other machines are judged by vibration.
    """
    by_vibration = F.col("Total_vRMS") > cfg.vrms_on
    if current not in df.columns:
        return df.where(by_vibration) if "Total_vRMS" in df.columns else df
    metered = df.where(F.col(current).isNotNull()).select(key, F.lit(True).alias("_metered")).distinct()
    on = F.when(F.col("_metered"), F.col(current) > cfg.current_on).otherwise(by_vibration)
    return df.join(F.broadcast(metered), key, "left").where(on).select(*df.columns)


def filter_running_hybrid(
    df: DataFrame, current: str | None, threshold: float | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Row by row: the current decides where it is known, else vibration."""
    by_vibration = F.col("Total_vRMS") > cfg.vrms_on
    if current is None or current not in df.columns:
        return df.where(by_vibration)
    limit = cfg.current_on if threshold is None else threshold
    c = F.col(current)
    return df.where(F.when(c.isNotNull(), c > limit).otherwise(by_vibration))


def smooth_features(
    df: DataFrame, key="device_id", order=TIME_ORDER, cfg: Settings = DEFAULTS
) -> DataFrame:
    cols = [c for c in cfg.features if c in df.columns]
    return rolling_median(df, [key], cols, cfg.smooth_rows, order, cfg=cfg)


def clean_vibration(df: DataFrame, keep_null_crest=False, cfg: Settings = DEFAULTS) -> DataFrame:
    """derive -> spikes -> running -> smooth."""
    rows = filter_spikes(derive_features(df), keep_null_crest, cfg)
    return smooth_features(filter_running(rows, cfg=cfg), cfg=cfg)
