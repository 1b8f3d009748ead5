"""Effect of maintenance at equal operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import (
    CURRENT_WORDS,
    DEFAULT_CURRENT_TYPE,
    DEFAULTS,
    DISPLAY_METRICS,
    FREQUENCY_WORDS,
    POWER_WORDS,
    Settings,
)
from rotorwatch.functions.scoring import contains_any, load_bin, period_label
from rotorwatch.operators.model import MIN_FILLED, _chosen_value, columns_like
from rotorwatch.operators.quantiles import exact_percentiles

_HZ_STEP = 5.0   # fixed value: width of a frequency group
_MIN_ROWS = 20   # fixed value: rows needed for a comparison


def maintenance_in_range(df: DataFrame, events: DataFrame, key="device_id", machine="devicename") -> DataFrame:
    """Events inside the data range of each measuring point. ``split_date`` is the
    last of them. Events are kept per machine, so both positions get them."""
    span = df.groupBy(key, machine).agg(F.min("datetime").alias("_t0"), F.max("datetime").alias("_t1"))
    log = events.select(F.col("device_id").alias("_dev"), "event_ts", "event_name")
    inside = span.join(log, F.col(machine) == F.col("_dev")).where(
        (F.col("event_ts") >= F.col("_t0")) & (F.col("event_ts") <= F.col("_t1"))
    )
    return inside.select(
        key, "event_ts", "event_name",
        F.max("event_ts").over(Window.partitionBy(key)).alias("split_date"),  # a few log lines each
    )


def label_period(df: DataFrame, events_in_range: DataFrame, key="device_id") -> DataFrame:
    split = events_in_range.select(key, "split_date").distinct()
    return df.join(split, key).withColumn("period", period_label("datetime", "split_date"))


def resolve_current_column(tag_dim: DataFrame, wanted: str = DEFAULT_CURRENT_TYPE) -> DataFrame:
    """Each device's current variable: exact name, then a name that contains the
    wanted text, then one with a known word; ties in name order."""
    name = F.col("variable_type")
    level = F.when(name == wanted, 0).when(F.lower(name).contains(wanted.lower()), 1)
    for i, word in enumerate(CURRENT_WORDS):
        level = level.when(F.lower(name).contains(word.lower()), 2 + i)
    ranked = tag_dim.withColumn("_level", level).where(F.col("_level").isNotNull())
    return ranked.groupBy("device_id").agg(F.min_by("variable_type", F.struct("_level", "variable_type")).alias("current_col"))


def resolve_group_column(df: DataFrame, current: str | None = None, key="device_id") -> DataFrame:
    """Name of the operating-point column per machine: frequency, power, current."""
    chosen = [
        F.when(F.count(c) >= MIN_FILLED, F.lit(c))
        for words in (FREQUENCY_WORDS, POWER_WORDS) for c in columns_like(df, words)
    ]
    if current is not None and current in df.columns:
        chosen.append(F.when(F.count(current) > 0, F.lit(current)))
    name = F.coalesce(*chosen) if chosen else F.max(F.lit(None).cast("string"))
    return df.groupBy(key).agg(name.cast("string").alias("group_col"))


def with_group_value(df: DataFrame, choice: DataFrame, key="device_id") -> DataFrame:
    """Rows with a known operating point."""
    rows = df.join(choice, key).withColumn("group_value", _chosen_value(df, "group_col"))
    return rows.where(F.col("group_value").isNotNull())


def effect_binning(rows: DataFrame, key="device_id", n_bins: int = 4, cfg: Settings = DEFAULTS) -> DataFrame:
    """Shared bins per machine over both sides of the maintenance.

    Quartiles; where they do not separate anything a frequency is rounded to 5 Hz
    steps, and what cannot be separated is one bin. Returns the rows with
    ``bin_method``, ``effect_bin``, ``bin_left`` and ``bin_right``.
    """
    wanted = {f"_e{i}": ("group_value", i / n_bins) for i in range(n_bins + 1)}
    step = F.bround(F.col("group_value") / _HZ_STEP) * _HZ_STEP
    stats = exact_percentiles(rows, [key], wanted, extra=[
        F.count("group_value").alias("_n"),
        F.min(step).alias("_s0"), F.max(step).alias("_s1"),
    ])
    edges = F.array_distinct(F.array(*wanted))
    is_freq = contains_any("group_col", FREQUENCY_WORDS)
    quartiles = (F.size("_edges") > 1) & (F.col("_n") >= MIN_FILLED)
    by_step = is_freq & (F.col("_s0") < F.col("_s1"))
    plan = stats.where(F.col("_n") >= _MIN_ROWS).select(
        key, edges.alias("_edges"), "_n", "_s0", "_s1"
    )
    out = rows.join(plan, key).withColumn(
        "bin_method", F.when(quartiles, "quartile").when(by_step, "step").otherwise("single")
    )
    no = load_bin("group_value", "_edges")

    def per_method(a: Column, b: Column, c: Column) -> Column:
        return F.when(F.col("bin_method") == "quartile", a).when(F.col("bin_method") == "step", b).otherwise(c)

    return (
        out.withColumn("effect_bin", per_method(no.cast("double"), step, F.lit(0.0)))
        .withColumn("bin_left", per_method(F.get("_edges", no), step, F.lit(0.0)))
        .withColumn("bin_right", per_method(F.get("_edges", no + 1), step, F.lit(0.0)))
        .drop("_edges", "_n", "_s0", "_s1")
    )


def maintenance_effect(
    binned: DataFrame, metrics=DISPLAY_METRICS, current: str | None = None, score="health_score",
    key="device_id", cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Medians before and after per bin, for binned rows with a ``period``.

    Improvement is (before - after) / before. Bins that lack a side are left out.
    """
    cols = [m for m in metrics if m in binned.columns]
    extra = [c for c in (current, score) if c and c in binned.columns]
    before = F.col("period") == "before"
    sided = binned.select(
        key, "effect_bin", "bin_left", "bin_right", "period",
        *[F.when(before if s == "before" else ~before, F.col(c)).alias(f"{c}_{s}")
          for c in [*cols, *extra] for s in ("before", "after")],
    )
    wanted = {f"_{c}_{s}": (f"{c}_{s}", 0.5) for c in [*cols, *extra] for s in ("before", "after")}
    med = exact_percentiles(sided, [key, "effect_bin", "bin_left", "bin_right"], wanted, extra=[
        F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"),
    ]).where((F.col("n_before") > 0) & (F.col("n_after") > 0))
    out = [F.col(c) for c in (key, "effect_bin", "bin_left", "bin_right", "n_before", "n_after")]

    def share(a, b):
        return (a - b) / F.nullif(a, F.lit(0.0)) * 100

    for c in cols:
        a, b = F.col(f"_{c}_before"), F.col(f"_{c}_after")
        out += [a.alias(f"{c}_before"), b.alias(f"{c}_after"), share(a, b).alias(f"{c}_improve_pct")]
    if current and current in binned.columns:
        a, b = F.col(f"_{current}_before"), F.col(f"_{current}_after")
        gap = F.abs(a - b) / F.nullif(a, F.lit(0.0)) * 100
        out += [a.alias("current_before"), b.alias("current_after"), gap.alias("current_diff_pct"),
                (gap < 10).alias("load_comparable")]
    if score in binned.columns:
        a, b = F.col(f"_{score}_before"), F.col(f"_{score}_after")
        out += [a.alias("score_before"), b.alias("score_after"), (b - a).alias("score_delta")]
    return med.select(*out)


def alignment_coverage(df: DataFrame, current: str, key="device_id") -> DataFrame:
    """How much of a series has a current reading, and whether it stops early."""
    known = F.col(current).isNotNull()
    return (
        df.groupBy(key)
        .agg(
            F.count("*").alias("n_rows"), F.count_if(known).alias("n_aligned"),
            F.max(F.when(known, F.col("datetime"))).alias("last_aligned"),
            F.max("datetime").alias("_end"),
        )
        .where(F.col("n_aligned") > 0)
        .select(
            key, "n_rows", "n_aligned", (F.col("n_aligned") / F.col("n_rows") * 100).alias("aligned_pct"),
            "last_aligned",
            (F.col("last_aligned") < F.timestamp_add("DAY", F.lit(-3), F.col("_end"))).alias("ends_early"),
        )
    )

