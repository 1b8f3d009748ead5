"""Long telemetry: tag mapping, pivot, counters, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.functions.times import seconds_between
from rotorwatch.operators.series import TIME_ORDER, with_previous


def map_tags(long: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """Attach device and variable of each tag; unmapped tags drop out."""
    dim = tag_dim.select("tagname", "variable_type", "device_id")
    return long.drop("device_id", "variable_type").join(F.broadcast(dim), "tagname")


def variable_types(tag_dim: DataFrame) -> list[str]:
    """Sorted variables of the tag dimension: the pivot columns."""
    rows = tag_dim.select("variable_type").distinct().orderBy("variable_type").collect()
    return [r[0] for r in rows]


def pivot_scada(long: DataFrame, tag_dim: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """One row per device and timestamp, one column per variable; readings of one
    variable at one timestamp are averaged, empty readings ignored."""
    variables = variables or variable_types(tag_dim)
    # Conditional averages need one shuffle where pivot() needs two.
    of = lambda v: F.avg(F.when(F.col("variable_type") == v, F.col("value"))).alias(v)
    return (
        map_tags(long, tag_dim)
        .where(F.col("value").isNotNull())
        .groupBy("device_id", "datetime")
        .agg(*[of(v) for v in variables])
    )


def counter_delta(long: DataFrame, keys=("tagname",), order=TIME_ORDER, cfg: Settings = DEFAULTS) -> DataFrame:
    """Increment to the previous reading of the same tag; a reset gives NULL."""
    out = with_previous(long, keys, ["value"], order, cfg=cfg)
    raw = F.col("value") - F.col("prev_value")
    return out.withColumn("delta", F.when(raw >= 0, raw)).withColumn("is_reset", F.coalesce(raw < 0, F.lit(False)))


def counter_resets(long: DataFrame, keys=("tagname",), order=TIME_ORDER, cfg: Settings = DEFAULTS) -> DataFrame:
    deltas = counter_delta(long, keys, order, cfg)
    return deltas.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if("is_reset").alias("n_resets")
    )


def counter_daily_sum(long: DataFrame, keys=("tagname",), order=TIME_ORDER, cfg: Settings = DEFAULTS) -> DataFrame:
    """Sum of increments per day; a day without any increment gives NULL."""
    deltas = counter_delta(long, keys, order, cfg)
    return deltas.groupBy(*keys, F.to_date("datetime").alias("date")).agg(F.sum("delta").alias("total"))


def detect_gaps(
    long: DataFrame, keys=("tagname",), order=TIME_ORDER,
    interval_min: float | None = None, factor: float | None = None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Silent periods of each tag, longer than interval x factor."""
    limit = (interval_min or cfg.gap_interval_min) * (factor or cfg.gap_factor)
    rows = long.where(F.col("datetime").isNotNull())
    steps = with_previous(rows, keys, ["datetime"], order, cfg=cfg)
    minutes = seconds_between("prev_datetime", "datetime") / 60.0
    return (
        steps.withColumn("_m", minutes)
        .where(F.col("_m") > limit)
        .select(
            *keys, F.col("prev_datetime").alias("gap_start"), F.col("datetime").alias("gap_end"),
            F.bround(F.col("_m") / 60.0, 2).alias("gap_hours"),
        )
    )


def topk_gaps(gaps: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` longest gaps of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("gap_hours"), "gap_start")
    return gaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tag_counts(long: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """Rows and distinct names of the telemetry and of the tag mapping."""

    def count(df, source, name):
        return df.agg(
            F.lit(source).alias("source"), F.count("*").alias("n_rows"),
            F.countDistinct(name).alias("n_names"),
        )

    return (
        count(long, "telemetry_tags", "tagname")
        .unionByName(count(tag_dim, "mapped_tags", "tagname"))
        .unionByName(count(tag_dim, "mapped_devices", "device_id"))
    )
