"""Checks of a trained model against its scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.functions.scoring import pearson
from rotorwatch.operators.baseline import variation
from rotorwatch.operators.model import _chosen_value, model_by_machine
from rotorwatch.operators.quantiles import exact_percentiles


def baseline_flag(scored: DataFrame, baseline: DataFrame, key="device_id") -> DataFrame:
    """Mark scored rows whose timestamp occurs in the machine's baseline."""
    stamps = baseline.select(key, "datetime").distinct().withColumn("_b", F.lit(True))
    return scored.join(stamps, [key, "datetime"], "left").withColumn(
        "is_baseline", F.coalesce("_b", F.lit(False))
    ).drop("_b")


def baseline_average_score(
    scored: DataFrame, baseline: DataFrame, key="device_id", cfg: Settings = DEFAULTS
) -> DataFrame:
    stamps = baseline.select(key, "datetime").distinct()
    return (
        scored.join(stamps, [key, "datetime"], "left_semi")
        .groupBy(key).agg(F.avg("health_score").alias("baseline_avg"))
        .withColumn("baseline_ok", F.coalesce(F.col("baseline_avg") >= cfg.baseline_ok, F.lit(False)))
    )


def bin_range_check(scored: DataFrame, model: DataFrame, key="device_id") -> DataFrame:
    """Range of the load column in the scored rows against the trained edges."""
    rows = scored.drop("bin_col").join(F.broadcast(model_by_machine(model, key).select(key, "bin_col", "edges")), key)
    v = _chosen_value(scored.drop("bin_col"))
    return (
        rows.where(F.col("edges").isNotNull())
        .groupBy(key, "bin_col")
        .agg(F.first("edges").alias("_e"), F.min(v).alias("scored_min"), F.max(v).alias("scored_max"))
        .select(
            key, "bin_col", F.element_at("_e", 1).alias("trained_min"),
            F.element_at("_e", -1).alias("trained_max"), "scored_min", "scored_max",
            (F.col("scored_min") < F.element_at("_e", 1)).alias("below"),
            (F.col("scored_max") > F.element_at("_e", -1)).alias("above"),
        )
    )


def baseline_feature_cv(baseline: DataFrame, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Variation of each feature on the baseline against its limit."""
    features = [f for f in cfg.features if f in baseline.columns]
    wide = baseline.groupBy(key).agg(*[variation(f).alias(f) for f in features])
    limits = F.create_map(*[F.lit(x) for f in features for x in (f, cfg.cv_limits[f])])
    return wide.unpivot(key, features, "feature", "cv").withColumn(
        "cv_limit", limits[F.col("feature")]
    ).withColumn("stable", F.coalesce(F.col("cv") < F.col("cv_limit"), F.lit(False)))


def bin_drift(flagged: DataFrame, key="device_id", current="current_A", cfg: Settings = DEFAULTS) -> DataFrame:
    """Per bin: feature and current medians on the baseline and on the rest.
    Bins that lack either side are left out."""
    base = F.col("is_baseline")
    rows = flagged.select(
        key, "load_bin",
        F.when(base, F.col("accOA")).alias("_a0"), F.when(~base, F.col("accOA")).alias("_a1"),
        F.when(base, F.col(current)).alias("_c0"), F.when(~base, F.col(current)).alias("_c1"),
    )
    med = exact_percentiles(rows, [key, "load_bin"], {
        "accOA_baseline": ("_a0", 0.5), "accOA_recent": ("_a1", 0.5),
        "current_baseline": ("_c0", 0.5), "current_recent": ("_c1", 0.5),
    })
    ratio = F.when(F.col("accOA_baseline") > 0, F.col("accOA_recent") / F.col("accOA_baseline"))
    return (
        med.where(F.col("accOA_baseline").isNotNull() & F.col("accOA_recent").isNotNull())
        .withColumn("ratio", ratio)
        .withColumn("drift", F.when(F.col("ratio") > 1.15, "worse").when(F.col("ratio") >= 0.9, "similar").otherwise("better"))
    )


def score_feature_corr(scored: DataFrame, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    features = [f for f in cfg.features if f in scored.columns]
    aggs = []
    for f in features:
        both = F.col("health_score").isNotNull() & F.col(f).isNotNull()
        aggs.append(F.struct(F.count_if(both).alias("n"), pearson("health_score", f).alias("r")).alias(f))
    wide = scored.groupBy(key).agg(*aggs)
    out = wide.unpivot(key, features, "feature", "s").select(
        key, "feature", F.col("s.n").alias("n"), F.col("s.r").alias("r")
    )
    return out.where(F.col("n") > 10).withColumn(
        "direction", F.when(F.col("r") < -0.3, "negative").when(F.col("r") < 0, "weak").otherwise("positive")
    )


def bin_score_spread(scored: DataFrame, key="device_id") -> DataFrame:
    s = "health_score"
    return (
        scored.where(F.col(s).isNotNull())
        .groupBy(key, "load_bin")
        .agg(
            F.count(s).alias("n"), F.stddev_samp(s).alias("std"), F.avg(s).alias("mean"),
            F.min(s).alias("min"), F.max(s).alias("max"),
        )
        .withColumn("unsteady", ~F.coalesce(F.col("std") <= 15, F.lit(False)))
    )


def smoothing_effect(scored: DataFrame, key="device_id") -> DataFrame:
    return (
        scored.groupBy(key)
        .agg(F.stddev_samp("health_score").alias("raw_std"), F.stddev_samp("health_score_smooth").alias("smooth_std"))
        .where(F.col("raw_std") > 0)
        .withColumn("reduction_pct", (1 - F.col("smooth_std") / F.col("raw_std")) * 100)
    )


def latest_score(scored: DataFrame, key="device_id", order=("datetime", "row_id")) -> DataFrame:
    """Last known score, and the alert of the very last row (which may be Unknown)."""
    when = F.struct(*order)
    known = F.when(F.col("health_score").isNotNull(), when)
    return scored.groupBy(key).agg(
        F.max_by("health_score", known).alias("latest_score"),
        F.max_by("alert_level", when).alias("last_alert"),
    )
