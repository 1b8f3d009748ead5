"""Dimension joins and checks of the mapping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import CURRENT_WORDS, DEFAULTS, Settings
from rotorwatch.functions.scoring import contains_any
from rotorwatch.operators.asof import asof_nearest


def one_per_device(device_dim: DataFrame) -> DataFrame:
    """One row per device name; of repeated names the last in file order counts."""
    rest = [c for c in device_dim.columns if c != "devicename"]
    last = F.max_by(F.struct(*rest), "row_no").alias("_r")
    return device_dim.groupBy("devicename").agg(last).select("devicename", "_r.*")


def map_devices(df: DataFrame, device_dim: DataFrame) -> DataFrame:
    """Add tag, machine and model group; the machine defaults to the device name."""
    dim = one_per_device(device_dim).select("devicename", "tagname", "machine_id", "model_group")
    return (
        df.join(F.broadcast(dim), "devicename", "left")
        .withColumn("machine_id", F.coalesce("machine_id", "devicename"))
        .withColumn("model_group", F.coalesce("model_group", F.lit("")))
    )


def semi_join_tags(long: DataFrame, tag_dim: DataFrame, device: str | None = None) -> DataFrame:
    """Telemetry rows whose tag belongs to the mapping (of one device)."""
    dim = tag_dim if device is None else tag_dim.where(F.col("device_id") == device)
    return long.join(F.broadcast(dim.select("tagname").distinct()), "tagname", "left_semi")


def anti_join_tags(long: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """Tags mapped but never seen, and tags seen but not mapped."""
    seen = long.select("tagname").distinct()
    mapped = tag_dim.select("tagname").distinct()
    return (
        mapped.join(seen, "tagname", "left_anti").withColumn("problem", F.lit("mapped_not_seen"))
        .unionByName(seen.join(mapped, "tagname", "left_anti").withColumn("problem", F.lit("seen_not_mapped")))
    )


def except_tags(long: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """The same two differences as set operations."""
    seen, mapped = long.select("tagname"), tag_dim.select("tagname")
    return (
        mapped.subtract(seen).withColumn("problem", F.lit("mapped_not_seen"))
        .unionByName(seen.subtract(mapped).withColumn("problem", F.lit("seen_not_mapped")))
    )


def distinct_names(vib: DataFrame, tag_dim: DataFrame) -> DataFrame:
    return (
        vib.select(F.lit("vibration").alias("source"), F.col("devicename").alias("name"))
        .union(tag_dim.select(F.lit("mapping"), F.col("device_id")))
        .distinct().orderBy("source", "name")
    )


def device_match_check(vib: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """Whether each vibration device occurs in the tag mapping."""
    known = tag_dim.select(F.trim("device_id").alias("devicename")).distinct().withColumn("_k", F.lit(True))
    return (
        vib.select("devicename").distinct().join(known, "devicename", "left")
        .select("devicename", F.coalesce("_k", F.lit(False)).alias("matched"))
    )


def _span(df, key, prefix):
    return df.groupBy(key).agg(F.min("datetime").alias(f"{prefix}_start"), F.max("datetime").alias(f"{prefix}_end"))


def time_overlap_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether the time ranges of two series of one key touch."""
    both = _span(a, key, "a").join(_span(b, key, "b"), key)
    return both.withColumn(
        "overlap", (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    )


def mapping_chain_check(vib: DataFrame, long: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """Per measuring point: in the mapping, tags found, current mapped, overlap."""
    per_tag = long.groupBy("tagname").agg(F.min("datetime").alias("_t0"), F.max("datetime").alias("_t1"))
    chain = (
        tag_dim.join(per_tag, "tagname", "left")
        .groupBy(F.col("device_id").alias("devicename"))
        .agg(
            F.count("*").alias("n_tags"), F.count("_t0").alias("n_found"),
            F.bool_or(contains_any("variable_type", CURRENT_WORDS)).alias("has_current"),
            F.min("_t0").alias("_s0"), F.max("_t1").alias("_s1"),
        )
    )
    span = vib.groupBy("device_id", "devicename").agg(F.min("datetime").alias("_v0"), F.max("datetime").alias("_v1"))
    return span.join(chain, "devicename", "left").select(
        "device_id", F.col("n_tags").isNotNull().alias("in_mapping"), "n_tags", "n_found", "has_current",
        ((F.col("_v0") <= F.col("_s1")) & (F.col("_s0") <= F.col("_v1"))).alias("overlap"),
    )


def asof_current(
    vib: DataFrame, current: DataFrame, device_dim: DataFrame, tolerance_s: int | None = None,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Vibration rows with ``current_A`` of the device's own current tag."""
    tags = one_per_device(device_dim).select("devicename", "tagname")
    rows = vib.join(F.broadcast(tags), "devicename", "left")
    right = current.select("tagname", "datetime", "row_id", F.col("value").alias("current_A"))
    out = asof_nearest(rows, right, ["tagname"], ["current_A"], tolerance_s, right_order="row_id", cfg=cfg)
    return out.select(*vib.columns, "current_A")


def asof_scada_wide(
    vib: DataFrame, wide: DataFrame, tolerance_s: int | None = None, cfg: Settings = DEFAULTS
) -> DataFrame:
    """Vibration rows with all variables of the nearest telemetry timestamp."""
    variables = [c for c in wide.columns if c not in ("device_id", "datetime")]
    right = wide.withColumnRenamed("device_id", "devicename")
    out = asof_nearest(vib, right, ["devicename"], variables, tolerance_s, cfg=cfg)
    return out.select(*vib.columns, *variables)


def alignment_status(vib: DataFrame, current: DataFrame, device_dim: DataFrame) -> DataFrame:
    """Per measuring point, why its current can or cannot be aligned."""
    span = vib.groupBy("device_id", "devicename").agg(
        F.min("datetime").alias("_v0"), F.max("datetime").alias("_v1")
    )
    tags = one_per_device(device_dim).select("devicename", "tagname")
    readings = current.groupBy("tagname").agg(F.min("datetime").alias("_c0"), F.max("datetime").alias("_c1"))
    empty = current.agg((F.count("*") == 0).alias("_empty"))  # one row
    overlap = (F.col("_v1") >= F.col("_c0")) & (F.col("_c1") >= F.col("_v0"))
    return (
        span.join(tags, "devicename", "left").join(readings, "tagname", "left")
        .withColumn("_empty", empty.scalar())
        .select(
            "device_id", "tagname",
            F.when(F.col("_empty"), "no_current_data")
            .when(F.col("tagname").isNull(), "not_mapped")
            .when(F.col("_c0").isNull(), "tag_absent")
            .when(~overlap, "no_overlap")
            .otherwise("aligned").alias("status"),
        )
    )


def align_with_diagnostics(
    vib: DataFrame, current: DataFrame, device_dim: DataFrame, tolerance_s: int | None = None,
    cfg: Settings = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Aligned rows, and the status table that explains the unaligned ones."""
    return (
        asof_current(vib, current, device_dim, tolerance_s, cfg),
        alignment_status(vib, current, device_dim),
    )
