"""Counter-based energy efficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, ENERGY_WORDS, FLOW_WORDS, RUN_HOUR_WORDS, Settings
from rotorwatch.functions.scoring import contains_any
from rotorwatch.operators.quantiles import exact_percentiles
from rotorwatch.operators.telemetry import counter_daily_sum

ROLES = {"kwh": ENERGY_WORDS, "flow": FLOW_WORDS, "run": RUN_HOUR_WORDS}


def _with_roles(tag_dim: DataFrame, roles=None) -> DataFrame:
    fits = F.array(*[
        F.when(contains_any("variable_type", words), F.lit(role)) for role, words in (roles or ROLES).items()
    ])
    return tag_dim.withColumn("role", F.explode(F.array_compact(fits)))


def resolve_variable_by_keyword(tag_dim: DataFrame, roles=None) -> DataFrame:
    """First variable of each device, in mapping order, whose name fits a role."""
    return _with_roles(tag_dim, roles).groupBy("device_id", "role").agg(
        F.min_by("variable_type", "row_no").alias("variable_type")
    )


def first_tag_for_variable(tag_dim: DataFrame) -> DataFrame:
    """First tag of each variable in mapping order; several are flagged."""
    return tag_dim.groupBy("device_id", "variable_type").agg(
        F.min_by("tagname", "row_no").alias("tagname"), F.count("*").alias("n_tags")
    ).withColumn("ambiguous", F.col("n_tags") > 1)


def role_tags(tag_dim: DataFrame) -> DataFrame:
    """Tags by role, for devices that have both an energy and a flow counter.

    The first tag of the first fitting variable is the first fitting mapping row.
    """
    tags = _with_roles(tag_dim).groupBy("device_id", "role").agg(
        F.min_by("tagname", "row_no").alias("tagname")
    )
    needed = F.count_if(F.col("role").isin("kwh", "flow")).over(Window.partitionBy("device_id"))
    return tags.withColumn("_n", needed).where(F.col("_n") == 2).drop("_n")  # three rows a device


def outer_join_daily(counters: DataFrame, tags: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per device and day that any of its counters reports, one column
    per role. Increments are taken on each tag's own clock before days are joined."""
    used = counters.drop("device_id").join(F.broadcast(tags), "tagname")
    return (
        counter_daily_sum(used, ("device_id", "role", "tagname"), cfg=cfg)
        .groupBy("device_id", "date")
        .agg(*[
            F.max(F.when(F.col("role") == role, F.col("total"))).alias(name)
            for role, name in (("kwh", "kwh_sum"), ("flow", "flow_sum"), ("run", "running_hours"))
        ])
    )


def daily_specific_power(daily: DataFrame) -> DataFrame:
    """Flow per kWh of each day; NULL on a day without energy use."""
    return daily.withColumn(
        "specific_power", F.col("flow_sum") / F.nullif(F.col("kwh_sum"), F.lit(0.0))
    )


def missing_days(daily: DataFrame) -> DataFrame:
    return daily.groupBy("device_id").agg(
        F.count("*").alias("n_days"),
        F.count_if(F.col("kwh_sum").isNull()).alias("n_missing_kwh"),
        F.count_if(F.col("flow_sum").isNull()).alias("n_missing_flow"),
    )


def energy_split(daily: DataFrame, events: DataFrame) -> DataFrame:
    """Last maintenance of each device inside its daily range."""
    span = daily.groupBy("device_id").agg(F.min("date").alias("_d0"), F.max("date").alias("_d1"))
    day = lambda c: F.col(c).cast("timestamp_ntz")
    return (
        span.join(events, "device_id")
        .where((F.col("event_ts") >= day("_d0")) & (F.col("event_ts") <= day("_d1")))
        .groupBy("device_id").agg(F.max("event_ts").alias("split_date"))
    )


def energy_before_after(
    daily: DataFrame, split: DataFrame, price: float | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Median efficiency on both sides of the maintenance, and the energy saved
    against producing the later flow at the earlier efficiency."""
    before = F.col("date").cast("timestamp_ntz") < F.col("split_date")
    sides = {"pre": before, "post": ~before}
    cols = {"sp": "specific_power", "runhr": "running_hours"}
    rows = daily.join(split, "device_id").select(
        "device_id", before.alias("_pre"), "flow_sum", "kwh_sum",
        *[F.when(cond, F.col(c)).alias(f"_{n}_{s}") for n, c in cols.items() for s, cond in sides.items()],
    )
    out = exact_percentiles(
        rows, ["device_id"], {f"{n}_{s}": (f"_{n}_{s}", 0.5) for n in cols for s in sides},
        extra=[
            F.count_if("_pre").alias("n_pre"), F.count_if(~F.col("_pre")).alias("n_post"),
            F.coalesce(F.sum(F.when(~F.col("_pre"), F.col("flow_sum"))), F.lit(0.0)).alias("_flow"),
            F.coalesce(F.sum(F.when(~F.col("_pre"), F.col("kwh_sum"))), F.lit(0.0)).alias("_kwh"),
        ],
    ).withColumn(
        "improve_pct",
        (F.col("sp_post") - F.col("sp_pre")) / F.nullif(F.col("sp_pre"), F.lit(0.0)) * 100,
    )
    cols_out = ["device_id", "n_pre", "n_post", "sp_pre", "sp_post", "runhr_pre", "runhr_post", "improve_pct"]
    if price is not None:
        saved = F.when(
            (F.col("n_post") > 0) & (F.col("sp_pre") > 0), F.col("_flow") / F.col("sp_pre") - F.col("_kwh")
        )
        out = out.withColumn("kwh_saved", saved).withColumn("cost_saved", saved * price)
        cols_out += ["kwh_saved", "cost_saved"]
    return out.select(*cols_out)


def run_hours_confound(compared: DataFrame) -> DataFrame:
    """Flag a comparison whose daily run hours moved by more than one hour."""
    gap = F.abs(F.col("runhr_pre") - F.col("runhr_post"))
    return compared.where(gap.isNotNull()).select(
        "device_id", "runhr_pre", "runhr_post", gap.alias("runhr_diff"), (gap > 1).alias("confounded")
    )


def union_dates(*daily: DataFrame) -> DataFrame:
    """Distinct device days of several daily tables."""
    out = daily[0].select("device_id", "date")
    for d in daily[1:]:
        out = out.union(d.select("device_id", "date"))
    return out.distinct()

