"""Descriptive statistics, before/after comparison and trend lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, DISPLAY_METRICS, Settings
from rotorwatch.functions.scoring import pearson, period_label
from rotorwatch.operators.quantiles import exact_percentiles
from rotorwatch.operators.series import TIME_ORDER, with_position


def to_long(df: DataFrame, ids, cols, name="metric", value="value") -> DataFrame:
    """One row per input row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(*ids, F.explode(pairs).alias("_x")).select(
        *ids, F.col("_x.n").alias(name), F.col("_x.v").alias(value)
    )


def describe_stats(df: DataFrame, cols, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """count, mean, std, min, median and max of each column, 4 decimals."""
    stats = exact_percentiles(
        to_long(df, [key], cols), [key, "metric"], {"median": ("value", 0.5)},
        extra=[
            F.count("value").alias("count"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        ],
    )
    return stats.select(
        key, "metric", "count",
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "median", "max")],
    )


def before_after_compare(
    df: DataFrame, metrics=DISPLAY_METRICS, keys=(), period="period", cfg: Settings = DEFAULTS
) -> DataFrame:
    """Both sides of every metric, the difference and its share of the first side.
    ``period`` holds 'before' or 'after'."""
    keys = list(keys)
    sides = ("before", "after")
    long = to_long(df, [*keys, period], metrics).select(
        *keys, "metric", *[F.when(F.col(period) == s, F.col("value")).alias(s) for s in sides]
    )
    stats = exact_percentiles(
        long, [*keys, "metric"], {f"{s}_median": (s, 0.5) for s in sides},
        extra=[
            x for s in sides for x in (
                F.count(s).alias(f"{s}_n"), F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_std"),
            )
        ],
    )
    diff = F.col("after_mean") - F.col("before_mean")
    return stats.select(
        *keys, "metric",
        *[c for s in sides for c in (
            F.col(f"{s}_n"), *[F.round(f"{s}_{m}", 5).alias(f"{s}_{m}") for m in ("mean", "median", "std")],
        )],
        F.round(diff, 5).alias("diff"),
        F.round(diff / F.nullif(F.col("before_mean"), F.lit(0.0)) * 100, 1).alias("change_pct"),
    )


def before_after_diff(compared: DataFrame, keys=()) -> DataFrame:
    return compared.select(
        *keys, "metric", F.col("before_mean").alias("before"), F.col("after_mean").alias("after"),
        "diff", "change_pct",
    )


def _fit(x, y):
    return [
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        pearson(x, y).alias("r"),
        F.stddev_pop(x).alias("_sx"),
    ]


def _fit_or_null(df: DataFrame, min_rows: int, cfg: Settings) -> DataFrame:
    """No line through fewer than ``min_rows`` points or a constant x."""
    ok = (F.col("n") >= min_rows) & (F.col("_sx") >= cfg.constant_sigma)
    out = df
    for c in ("slope", "intercept", "r"):
        out = out.withColumn(c, F.when(ok & ~F.isnan(c), F.col(c)))
    return out.drop("_sx")


def trendline_by_group(
    df: DataFrame, xs, ys, key="device_id", split: DataFrame | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Straight-line fit of every y on every x per machine.

    With ``split`` (machine, ``split_date``) each side of the date gets its own
    line. Pairs with fewer than five complete rows are left out.
    """
    rows = df.select(key, "datetime", *dict.fromkeys([*xs, *ys]))
    if split is None:
        rows = rows.withColumn("period", F.lit("all"))
    else:
        rows = rows.join(split.select(key, "split_date"), key, "left").withColumn(
            "period", F.when(F.col("split_date").isNull(), "all").otherwise(period_label("datetime", "split_date"))
        )
    pairs = F.array(*[
        F.struct(F.lit(x).alias("xn"), F.lit(y).alias("yn"), F.col(x).alias("x"), F.col(y).alias("y"))
        for x in xs for y in ys
    ])
    long = (
        rows.select(key, "period", F.explode(pairs).alias("_p"))
        .select(key, "period", F.col("_p.xn").alias("x_name"), F.col("_p.yn").alias("y_name"),
                F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    pair = [key, "x_name", "y_name"]
    fits = long.groupBy(*pair, "period").agg(*_fit("x", "y"))
    shown = fits.groupBy(*pair).agg(F.sum("n").alias("_t")).where(F.col("_t") >= 5)
    return _fit_or_null(fits.join(shown, pair, "left_semi"), 2, cfg)


def early_late_trendline(
    df: DataFrame, key="device_id", current="current_A", y="Total_vRMS", alternative="accOA",
    order=TIME_ORDER, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """One line through the first half of a machine's complete rows and one
    through the rest. x is the current, or accOA for a machine without any."""
    metered = df.groupBy(key).agg((F.count(current) > 0).alias("_metered"))
    x = F.when(F.col("_metered"), F.col(current)).otherwise(F.col(alternative))
    rows = (
        df.join(metered, key)
        .select(
            key, *order, x.alias("x"), F.col(y).alias("y"),
            F.when(F.col("_metered"), current).otherwise(alternative).alias("x_name"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= 6)
    halves = with_position(rows, [key], order, "_pos", cfg=cfg).join(sizes, key).withColumn(
        "half", F.when(F.col("_pos") < F.floor(F.col("_n") / 2), "early").otherwise("late")
    )
    return _fit_or_null(halves.groupBy(key, "x_name", "half").agg(*_fit("x", "y")), 2, cfg)


def normalize_time(df: DataFrame, key="device_id") -> DataFrame:
    """Place of each row between the machine's first and last timestamp, 0 to 1."""
    span = df.groupBy(key).agg(F.min("datetime").alias("_t0"), F.max("datetime").alias("_t1"))
    us = lambda a, b: F.timestamp_diff("MICROSECOND", F.col(a), F.col(b))
    total = F.greatest(us("_t0", "_t1"), F.lit(0))
    total = F.when(total == 0, F.lit(1_000_000)).otherwise(total)
    return df.join(span, key).withColumn("time_norm", us("_t0", "datetime") / total).drop("_t0", "_t1")
