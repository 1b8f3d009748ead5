"""Result tables to files.

Tables with a folder per measuring point are written so that a run for some points replaces
theirs and leaves all others as they are; running it again gives the same table. Models are
published version by version: a version is written aside and appears by one rename, so a job that
fails leaves the last one in place.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_COLUMNS = (
    "datetime", "device_id", "position", "load_bin", "health_score", "health_score_smooth",
    "alert_level", "Total_vRMS", "accOA", "Crest_Factor", "current_A",
)
BOM = "﻿"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None, bom=False, mode="errorifexists"
) -> None:
    """Write a table, one sub-folder per value of ``by``.

    Rows of a long series go to tasks by machine and day, so a machine is written
    by many tasks and a task writes few files. ``bom`` marks CSV as UTF-8 for
    spreadsheet programs. With mode ``replace`` the folders of the values of ``by`` that occur in
    ``df`` are replaced and the others stay; without ``by`` the whole table is.
    """
    if by and "datetime" in df.columns:
        df = df.repartition(F.col(by), F.to_date("datetime"))
    if bom and fmt == "csv":
        first = next(c for c in df.columns if c != by)
        df = df.withColumnRenamed(first, BOM + first)
    w = df.write.mode("overwrite" if mode == "replace" else mode).format(fmt)
    if by and mode == "replace":
        w = w.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.option("header", "true").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    (w.partitionBy(by) if by else w).save(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a table back. A table with sub-folders that got no row holds no file to take columns
    from; with ``schema`` it is read as an empty table."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def sink_scores(scored: DataFrame, path: str, fmt="parquet", load_columns=(), mode="replace", **kw) -> None:
    """Scores of every measuring point; the load columns in use are added."""
    cols = [*SCORE_COLUMNS, *[c for c in load_columns if c not in SCORE_COLUMNS]]
    write_table(scored.select(*[c for c in cols if c in scored.columns]), path, fmt, "device_id", mode=mode, **kw)


def sink_candidates(candidates: DataFrame, path: str, fmt="parquet", mode="replace", **kw) -> None:
    write_table(candidates, path, fmt, "device_id", mode=mode, **kw)


def sink_device_summary(summary: DataFrame, path: str, fmt="csv", **kw) -> None:
    cols = ["machine_id", "model_group", "latest_score_M1", "latest_score_M2", "overall_score",
            "alert_level", "baseline_start", "baseline_end", "data_count"]
    write_table(summary.select(*cols), path, fmt, **kw)


def sink_validation(validation: DataFrame, path: str, fmt="csv", **kw) -> None:
    """An empty table still gets its header."""
    cols = ["device_id", "position", "row_count", "time_start", "time_end", "has_current", "has_m1", "has_m2"]
    write_table(validation.select(*cols), path, fmt, **kw)


def sink_correlation(correlations: DataFrame, path: str, fmt="parquet", mode="replace", **kw) -> None:
    """One table; its sub-folders are the tables per measuring point."""
    write_table(correlations.drop("pearson_raw", "spearman_raw"), path, fmt, "device_id", mode=mode, **kw)


def sink_export(exported: DataFrame, path: str, fmt="parquet", mode="replace", **kw) -> None:
    write_table(exported, path, fmt, "device_id", mode=mode, **kw)


def sink_energy(daily: DataFrame, gaps: DataFrame, path: str, fmt="parquet", mode="replace", **kw) -> None:
    write_table(daily, f"{path}/daily", fmt, "device_id", mode=mode, **kw)
    write_table(gaps, f"{path}/gaps", fmt, "device_id", mode=mode, **kw)


def sink_health_tables(
    summary: DataFrame, valid: DataFrame, daily: DataFrame, fleet_daily: DataFrame, path: str, fmt="csv", **kw
) -> None:
    write_table(summary.orderBy("mean"), f"{path}/all_devices_summary", fmt, bom=True, **kw)
    write_table(valid, f"{path}/all_devices_valid_scores", fmt, bom=True, **kw)
    write_table(daily, f"{path}/daily_per_device", fmt, bom=True, **kw)
    write_table(fleet_daily, f"{path}/daily_fleet_average", fmt, bom=True, **kw)


def sink_before_after(compared: DataFrame, short: DataFrame, path: str, fmt="csv", **kw) -> None:
    write_table(compared, f"{path}/summary", fmt, bom=True, **kw)
    write_table(short, f"{path}/diff", fmt, bom=True, **kw)


VERSION = re.compile(r"version=(\d+)$")


def _folder(spark: SparkSession, path: str):
    """Hadoop's path class, and the file system of ``path``."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def model_versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of the model at ``path``, oldest first."""
    make, fs = _folder(spark, path)
    if not fs.exists(make(path)):
        return []
    found = (VERSION.search(f.getPath().getName()) for f in fs.listStatus(make(path)))
    return sorted(int(m[1]) for m in found if m)


def save_model(model: DataFrame, path: str, keep: int | None = None) -> int:
    """Publish ``model`` as the next version at ``path`` and return its number.

    The table is written to a folder that no reader looks at and then renamed, which HDFS and local
    disks do in one step. A failed write leaves all versions as they were, and ``model`` may itself
    be read from ``path``. Of two writers at once each gets a number of its own. ``keep`` removes all
    but the newest versions, for use when no job reads the older ones any more.
    """
    if keep is not None and keep < 1:
        raise ValueError("keep at least one version")
    spark = model.sparkSession
    jvm, (make, fs) = spark._jvm, _folder(spark, path)
    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    try:
        model.write.parquet(aside)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(path).toUri(), spark._jsc.hadoopConfiguration())
        no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        while True:
            number = max(model_versions(spark, path), default=0) + 1
            try:
                files.rename(fs.makeQualified(make(aside)), fs.makeQualified(make(f"{path}/version={number:06d}")), no_options)
                break
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
    finally:
        fs.delete(make(aside), True)
    for old in model_versions(spark, path)[:-keep] if keep else []:
        fs.delete(make(f"{path}/version={old:06d}"), True)
    return number


def load_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest published model at ``path``, or a certain one."""
    have = model_versions(spark, path)
    if not have or version is not None and version not in have:
        raise FileNotFoundError(f"no model version {version or ''} at {path}; there are {have}")
    return spark.read.parquet(f"{path}/version={version or have[-1]:06d}")
