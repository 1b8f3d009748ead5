"""Session set-up and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rotorwatch", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine expects: adaptive execution with skew
    joins (the defaults), UTC, and the charsets that cp950 files need."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach. A cluster names it in
    ``spark.checkpoint.dir``; only a local session may fall back to a temp folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="rotorwatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.conf.get("spark.app.id", "app")
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote for this application. Call it when no
    result that reads those tables is needed any more."""
    app = spark.conf.get("spark.app.id", "app")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{app}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later steps read the same expensive result. Unlike a
    cache it survives the loss of executors, and unlike an RDD checkpoint it
    keeps column pruning and filter pushdown for the readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
