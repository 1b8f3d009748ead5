"""Fleet tables over an external health score, and machine summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.functions.scoring import alert_level, trend_label
from rotorwatch.functions.times import from_micros, micros
from rotorwatch.operators.mapping import map_devices
from rotorwatch.operators.quantiles import exact_percentiles, join_groups
from rotorwatch.session import materialize


def filter_valid_scores(df: DataFrame, score="HealthScore") -> DataFrame:
    """Rows whose score is known and not 0."""
    return df.where(F.col(score).isNotNull() & (F.col(score) != 0))


def _valid(score) -> Column:
    return F.when(F.col(score) != 0, F.col(score))


def device_health_stats(df: DataFrame, score="HealthScore", key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Row counts and score statistics of every machine with a valid score."""
    rows = df.select(key, "datetime", _valid(score).alias("_s"))
    return _health_stats(rows, key)


def _health_stats(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """Statistics of ``_s``; columns that begin with ``_`` come from the further aggregates."""
    at = F.when(F.col("_s").isNotNull(), F.col("datetime"))
    out = exact_percentiles(rows, [key], {"_median": ("_s", 0.5)}, extra=[
        F.count("*").alias("n_total"), F.count("_s").alias("n_valid"),
        F.avg("_s").alias("_mean"), F.stddev_samp("_s").alias("_std"),
        F.min("_s").alias("_min"), F.max("_s").alias("_max"),
        F.min(at).alias("date_start"), F.max(at).alias("date_end"), *more,
    ]).where(F.col("n_valid") > 0)
    excluded = F.col("n_total") - F.col("n_valid")
    return out.select(
        key, "n_total", "n_valid", excluded.alias("n_excluded"),
        F.round(excluded / F.col("n_total") * 100, 1).alias("excluded_pct"),
        *[F.round(f"_{c}", 2).alias(c) for c in ("mean", "median", "std", "min", "max")],
        "date_start", "date_end", *([] if not more else ["_mean", "_d0", "_d1", "_k", "_ds"]),
    )


def _day() -> Column:
    return micros("datetime") / F.lit(86_400_000_000.0) - F.lit(18_262.0)  # days since 2020


def _line() -> list[Column]:
    """Regression aggregates of ``_s`` over days, of rows with a score."""
    d = F.when(F.col("_s").isNotNull(), _day())
    return [F.min(d).alias("_d0"), F.max(d).alias("_d1"), F.regr_slope("_s", d).alias("_k"), F.avg(d).alias("_ds")]


def _line_columns(cfg) -> list[Column]:
    enough = (F.col("n_valid") >= 5) & (F.col("_d1") > F.col("_d0"))
    month = F.when(enough, F.col("_k") * 30)
    return [
        F.round(month, 2).alias("slope_per_month"),
        F.when(enough, F.col("_mean") - F.col("_k") * (F.col("_ds") - F.col("_d0"))).alias("intercept"),
        trend_label(month, cfg).alias("trend_label"),
    ]


def health_trend(df: DataFrame, score="HealthScore", key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Slope of the score per 30 days, the line's value at the first valid row,
    and a label. Needs five valid rows over a span above zero."""
    rows = filter_valid_scores(df, score).select(key, "datetime", F.col(score).alias("_s"))
    fit = rows.groupBy(key).agg(F.count("_s").alias("n_valid"), F.avg("_s").alias("_mean"), *_line())
    return fit.select(key, "n_valid", *_line_columns(cfg))


def _halves_and_recent(df: DataFrame, score, key, days: int) -> DataFrame:
    """Per machine with a valid score the means before (``_a``) and from (``_b``) the middle of its time range,
    and mean and number (``_r``, ``_m``) of its last ``days`` days.

    Scores are added up once per machine and day. Whole days go to their sides as they are;
    only the rows of the days in which the middle or the start of the last days lies are read again.
    """
    rows = filter_valid_scores(df, score).select(
        key, "datetime", F.col(score).alias("_s"), F.to_date("datetime").alias("_day"))
    cells = materialize(rows.groupBy(key, "_day").agg(
        F.count("*").alias("_n"), F.sum("_s").alias("_sum"), F.min("datetime").alias("_from"), F.max("datetime").alias("_to")), "days")
    machine = Window.partitionBy(key)
    start, end = F.min("_from").over(machine), F.max("_to").over(machine)
    marked = cells.withColumns({
        "_middle": from_micros(micros(start) + F.floor((micros(end) - micros(start)) / 2)),
        "_recent": F.timestamp_add("DAY", F.lit(-days), end),
    })
    # A day without a time (NULL) lies on no side, as in a comparison of its rows.
    split = lambda cut: (F.col("_from") < F.col(cut)) & (F.col("_to") >= F.col(cut))
    border = split("_middle") | split("_recent")

    def sides(at, n, total):
        early, late, recent = F.col(at) < F.col("_middle"), F.col(at) >= F.col("_middle"), F.col(at) >= F.col("_recent")
        return [x for name, side in (("a", early), ("b", late), ("m", recent)) for x in (
            F.sum(F.when(side, n)).alias(f"_n{name}"), F.sum(F.when(side, total)).alias(f"_s{name}"))]

    days_ = marked.where(~F.coalesce(border, F.lit(False))).groupBy(key).agg(*sides("_from", F.col("_n"), F.col("_sum")))
    cut = marked.where(border).select(key, "_day", "_middle", "_recent")
    near = join_groups(rows, cut, [key, "_day"]).groupBy(key).agg(*sides("datetime", F.lit(1), F.col("_s")))
    both = days_.unionByName(near).groupBy(key).agg(*[F.sum(c).alias(c) for c in days_.columns if c != key])
    mean = lambda x: F.col(f"_s{x}") / F.col(f"_n{x}")
    return both.select(
        key, mean("a").alias("_a"), mean("b").alias("_b"), mean("m").alias("_r"),
        F.coalesce("_nm", F.lit(0)).cast("long").alias("_m"))


def _half_columns() -> list[Column]:
    change = (F.col("_b") - F.col("_a")) / F.nullif(F.col("_a"), F.lit(0.0)) * 100
    return [F.round("_a", 2).alias("first_half_mean"), F.round("_b", 2).alias("second_half_mean"),
            F.round(change, 1).alias("half_change_pct")]


def _recent_columns() -> list[Column]:
    return [F.round("_r", 2).alias("recent_mean"), F.col("_m").alias("recent_n")]


def half_period_change(df: DataFrame, score="HealthScore", key="device_id") -> DataFrame:
    """Mean score before and after the middle of the machine's time range."""
    return _halves_and_recent(df, score, key, 1).select(key, *_half_columns())


def recent_window_mean(df: DataFrame, days: int = 30, score="HealthScore", key="device_id") -> DataFrame:
    """Mean score of the machine's own last ``days`` days, both ends included."""
    return _halves_and_recent(df, score, key, days).select(key, *_recent_columns())


def daily_device_scores(df: DataFrame, score="HealthScore", key="device_id") -> DataFrame:
    return filter_valid_scores(df, score).groupBy(key, F.to_date("datetime").alias("date")).agg(
        F.round(F.avg(score), 2).alias("avg_score"), F.count("*").alias("n_valid")
    )


def daily_fleet_average(daily: DataFrame, days: int = 60) -> DataFrame:
    """Mean of the machines' daily means for the last ``days`` days of the data;
    every machine weighs the same."""
    # The daily means have two decimals; decimal sums do not depend on row order.
    mean = F.avg(F.col("avg_score").cast("decimal(18,2)"))
    fleet = daily.groupBy("date").agg(
        F.round(mean, 2).cast("double").alias("avg_score"), F.count("avg_score").alias("n_devices")
    )
    first_day = fleet.agg(F.date_add(F.max("date"), -(days - 1)))
    return fleet.where(F.col("date") >= first_day.scalar())


def fleet_ranking(stats: DataFrame) -> DataFrame:
    """Machines by mean score, worst first."""
    return stats.orderBy("mean", "device_id")


def health_summary(df: DataFrame, recent_days: int = 30, score="HealthScore", key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """All fleet columns of a machine in one row."""
    rows = df.select(key, "datetime", _valid(score).alias("_s"))
    whole = _health_stats(rows, key, *_line())
    parts = _halves_and_recent(df, score, key, recent_days)
    stats = [c for c in whole.columns if not c.startswith("_")]
    both = join_groups(whole, parts, [key])
    return both.select(*stats, *_line_columns(cfg), *_half_columns(), *_recent_columns())


def device_records(scored: DataFrame, baseline: DataFrame, device_dim: DataFrame) -> DataFrame:
    """Per measuring point: machine, latest score, baseline dates, row count."""
    known = F.when(F.col("health_score").isNotNull(), F.struct("datetime", "row_id"))
    latest = scored.groupBy("device_id", "devicename", "position").agg(
        F.round(F.max_by("health_score", known), 1).alias("latest_score"), F.count("*").alias("data_count")
    )
    base = baseline.groupBy("device_id").agg(
        F.to_date(F.min("datetime")).alias("baseline_start"), F.to_date(F.max("datetime")).alias("baseline_end")
    )
    return map_devices(latest.join(base, "device_id"), device_dim).drop("tagname")


def scoring_status(points: DataFrame, cleaned: DataFrame, baseline: DataFrame, model: DataFrame, scored: DataFrame,
                   key="device_id") -> DataFrame:
    """One row per measuring point: ``scored``, or the first step that gave nothing for it."""
    out = points.select(key).distinct()
    steps = (("no_clean_rows", cleaned), ("no_baseline", baseline), ("not_trained", model),
             ("not_scored", scored.where(F.col("health_score").isNotNull())))
    status = F.lit(None).cast("string")
    for name, rows in steps:
        out = join_groups(out, rows.select(key).distinct().withColumn(name, F.lit(True)), [key], "left")
        status = F.coalesce(status, F.when(F.col(name).isNull(), F.lit(name)))
    return out.select(key, F.coalesce(status, F.lit("scored")).alias("status"))


def device_summary(records: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per machine: both positions, the lower score, its alert, the
    baseline dates of M1 (else M2) and the summed row count."""
    def at(pos, c):
        return F.max(F.when(F.col("position") == pos, F.col(c)))

    both = records.groupBy("machine_id").agg(
        F.max("model_group").alias("model_group"),
        at("M1", "latest_score").alias("latest_score_M1"), at("M2", "latest_score").alias("latest_score_M2"),
        F.coalesce(at("M1", "baseline_start"), at("M2", "baseline_start")).alias("baseline_start"),
        F.coalesce(at("M1", "baseline_end"), at("M2", "baseline_end")).alias("baseline_end"),
        F.sum("data_count").alias("data_count"),
    )
    return both.withColumn("overall_score", F.least("latest_score_M1", "latest_score_M2")).withColumn(
        "alert_level", alert_level("overall_score", cfg)
    )


def validation_summary(aligned: DataFrame, cleaned: DataFrame, min_rows: int = 10) -> DataFrame:
    """Clean rows, time range and coverage of every measuring point."""
    seen = aligned.groupBy("device_id", "position").agg((F.count("current_A") > 0).alias("has_current"))
    kept = cleaned.groupBy("device_id").agg(
        F.count("*").alias("row_count"), F.min("datetime").alias("time_start"), F.max("datetime").alias("time_end")
    )
    base = F.regexp_replace("device_id", "_[^_]*$", "")
    rows = seen.join(kept, "device_id", "left").withColumn("_base", base)
    sides = rows.groupBy("_base").agg(
        F.bool_or(F.col("device_id").endswith("_M1")).alias("has_m1"),
        F.bool_or(F.col("device_id").endswith("_M2")).alias("has_m2"),
    )
    n = F.coalesce("row_count", F.lit(0))
    return rows.join(sides, "_base").select(
        "device_id", "position", n.alias("row_count"), "time_start", "time_end", "has_current",
        "has_m1", "has_m2", (n >= min_rows).alias("passed"),
    )
