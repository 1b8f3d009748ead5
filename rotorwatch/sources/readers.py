"""CSV folders to typed DataFrames.

Files may differ in encoding and header. One pass over the lines makes a catalogue of the files, kept
as a table; only the different layouts (encoding and header) reach the driver, however many
files there are. A second pass reads the lines of all files together, learns each one's layout from
the catalogue and takes columns by their place in it.
"""

from __future__ import annotations

import csv
import logging
import re
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorwatch.config import DEFAULT_EVENT_NAME, DISPLAY_METRICS
from rotorwatch.session import materialize
from rotorwatch.sources import columns as C

log = logging.getLogger("rotorwatch.sources")

# Encodings in order of trial (Spark name, Python name).
UTF8, CP950, LATIN1 = ("UTF-8", "utf-8-sig"), ("x-windows-950", "cp950"), ("ISO-8859-1", "latin1")

# Fixed value: byte structure of cp950 text, two hex digits per byte.
_CP950_HEX = (
    "^(?:[0-7][0-9A-F]|(?:A[1-9A-F]|[B-E][0-9A-F]|F[0-9])"
    "(?:[4-6][0-9A-F]|7[0-9A-E]|A[1-9A-F]|[B-E][0-9A-F]|F[0-9A-E]))*$"
)

# Vibration columns that hold numbers.
MEASURES = (
    "accOA", "velRMS_x", "velRMS_y", "velRMS_z", "velPEAK", "velRMS", "velOA", "accRMS",
    "HealthScore", "Total_vRMS", "Crest_Factor",
)

VIBRATION_SCHEMA = (
    "datetime timestamp_ntz, " + ", ".join(f"{m} double" for m in MEASURES)
    + ", devicename string, position string, device_id string, row_id long"
)
DEVICE_SCHEMA = (
    "tagname string, devicename string, machine_id string, model_group string, "
    "train_start timestamp_ntz, train_end timestamp_ntz, row_no long"
)
LONG_SCHEMA = "datetime timestamp_ntz, tagname string, value double, row_id long"
TAG_SCHEMA = "tagname string, variable_type string, device_id string, unit string, row_no long"
LOG_SCHEMA = "device_id string, event_ts timestamp_ntz, event_name string"


class Layout(NamedTuple):
    encoding: tuple
    header: tuple


class Files(NamedTuple):
    """What a folder holds: its layouts, and a table with ``file`` and ``layout``, the place in that list."""

    layouts: list[Layout]
    catalogue: DataFrame | None
    paths: list

    def lines(self) -> DataFrame:
        """Lines without headers, as ``_cells``, with ``_file``, ``_layout`` and their place in the file."""
        return _cells(self)


def catalogue(spark: SparkSession, path) -> Files:
    """Files by encoding and header; none where the path is absent. One row per different layout
    reaches the driver."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        return _catalogue(spark, paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.error("no such input: %s", paths)
        return Files([], None, paths)


def _reader(spark):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]")


def _catalogue(spark, paths) -> Files:
    lines = _reader(spark).text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    raw = F.col("value").cast("binary")
    found = lines.groupBy("file").agg(
        F.min_by(raw, F.struct("start", "n")).alias("first"),
        F.bool_and(F.expr("is_valid_utf8(value)")).alias("utf8"),
        F.bool_and(F.hex(raw).rlike(_CP950_HEX)).alias("cp950"),
    )
    code = F.when(F.col("utf8"), 0).when(F.col("cp950"), 1).otherwise(2)
    table = materialize(found.select("file", code.alias("code"), "first"), "catalogue")
    kinds = table.select("code", "first").distinct().orderBy("code", "first").collect()
    layouts: dict = {}
    numbers = []
    for row in kinds:  # headers that differ in blanks only are one layout
        enc = (UTF8, CP950, LATIN1)[row["code"]]
        text = bytes(row["first"]).decode(enc[1], errors="replace")
        layout = Layout(enc, _distinct(h.strip() for h in next(csv.reader([text]), [])))
        numbers.append((row["code"], row["first"], layouts.setdefault(layout, len(layouts))))
    if any(x.encoding == CP950 for x in layouts):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # cp950 is not in the default list
    number = spark.createDataFrame(numbers, "code int, first binary, layout int")
    return Files(list(layouts), table.join(number, ["code", "first"]).select("file", "layout"), paths)


def _distinct(names) -> tuple:
    """Header names; one that occurs again, case aside, gets a number behind it."""
    seen: dict = {}
    out = []
    for h in names:
        n = seen[h.lower()] = seen.get(h.lower(), -1) + 1
        out.append(f"{h}.{n}" if n else h)
    return tuple(out)


def _cells(files: Files) -> DataFrame:
    spark = files.catalogue.sparkSession
    # Whole lines without headers: no quotes, and a separator that text doesn't hold. Latin-1 keeps every byte.
    lines = _reader(spark).schema("line string").options(
        header="true", sep="\x01", quote="", encoding=LATIN1[0]).csv(files.paths).select(
        "line", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_n"))
    known = lines.join(files.catalogue.withColumnsRenamed({"file": "_file", "layout": "_layout"}), "_file")
    raw, text = F.encode("line", LATIN1[0]), F.col("line")
    for enc in {x.encoding for x in files.layouts} - {LATIN1}:
        mine = [k for k, x in enumerate(files.layouts) if x.encoding == enc]
        text = F.when(F.col("_layout").isin(mine), F.decode(raw, enc[0])).otherwise(text)
    width = max(len(x.header) for x in files.layouts)
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    return known.select("_file", "_start", "_n", "_layout", F.from_csv(text, schema.simpleString()[7:-1].replace(":", " ")).alias("_cells"))


def _by_layout(choice: dict):
    """``choice`` holds an expression by number of layout; NULL for other layouts."""
    out = None
    for k, value in choice.items():
        out = F.when(F.col("_layout") == k, value) if out is None else out.when(F.col("_layout") == k, value)
    return out


def _cell(k: int):
    return F.col("_cells")[f"c{k}"]


def _columns(layouts: list[Layout]) -> dict:
    """For every name, case aside, its place by number of layout, in order of first use."""
    out: dict = {}
    for k, layout in enumerate(layouts):
        for place, h in enumerate(layout.header):
            out.setdefault(h.lower(), (h, {}))[1][k] = place
    return dict(out.values())


def _text(places: dict):
    """The column that stands at these places, as text."""
    return _by_layout({k: _cell(place) for k, place in places.items()})


def _quoted(name: str):
    return F.col(f"`{name}`")


def _all_text(files: Files) -> list:
    return [_text(places).alias(name) for name, places in _columns(files.layouts).items()]


def read_csv_multi_encoding(spark: SparkSession, path) -> DataFrame:
    """All columns as text, files united by column name; without files, no column."""
    files = catalogue(spark, path)
    return files.lines().select(*_all_text(files)) if files.layouts else spark.createDataFrame([], T.StructType([]))


def load_vibration(spark: SparkSession, folder) -> DataFrame:
    """Vibration rows of all measuring points, named by their file.

    Files without a device in their name or without a time column are skipped,
    and so are rows whose time cannot be read.
    """
    files = catalogue(spark, folder)
    times, ids, named = {}, {}, []
    for k, layout in enumerate(files.layouts):
        time, score = C.time_header(layout.header), C.score_header(layout.header)
        if time is None:
            log.error("no time column in %s", layout.header)
            named.append(Layout(layout.encoding, ()))
            continue
        times[k] = layout.header.index(time)
        ids[k] = F.xxhash64("_file", *[_cell(j) for j in range(len(layout.header))])
        # A blank name stands for the time, which has a column of its own.
        named.append(Layout(layout.encoding, tuple(
            "" if h == time else "HealthScore" if h == score else h for h in layout.header)))
    if not times:
        log.error("no vibration file with a time column in %s", folder)
        return spark.createDataFrame([], VIBRATION_SCHEMA)
    rest = {h: places for h, places in _columns(named).items() if h}
    return files.lines().where(F.col("_layout").isin(list(times))).select(
        C.parse_timestamp(_text(times)).alias("datetime"),
        *[(C.number(_text(p)) if h in MEASURES else _text(p)).alias(h) for h, p in rest.items()],
        *C.device_from_path("_file"), _by_layout(ids).alias("row_id"),
    ).where(F.col("datetime").isNotNull() & F.col("device_id").isNotNull())


def load_report(spark: SparkSession, folder) -> DataFrame:
    """One row per file: its time column (NULL: the loaders skip the file), rows, rows whose time
    cannot be read and that the loaders leave out, rows of an unlikely year, and up to three of
    the time texts that cannot be read."""
    files = catalogue(spark, folder)
    if not files.layouts:
        return spark.createDataFrame(
            [], "file string, time_column string, n_rows long, n_unparsed long, n_odd_year long, examples array<string>")
    names = {k: C.time_header(x.header) for k, x in enumerate(files.layouts)}
    names = {k: (h, files.layouts[k].header.index(h)) for k, h in names.items() if h}
    none = F.lit(None).cast("string")
    text = _text({k: place for k, (_, place) in names.items()}) if names else none
    rows = files.lines().select(F.col("_file").alias("file"), text.alias("t")).withColumn("datetime", C.parse_timestamp("t"))
    bad = F.when(F.col("datetime").isNull(), F.col("t"))
    counts = rows.groupBy("file").agg(
        F.count("*").alias("n_rows"), *C.timestamp_counts("datetime"),
        F.array(F.min(bad), F.max(bad), F.first(bad, ignorenulls=True)).alias("examples"))
    known = files.catalogue.withColumnRenamed("layout", "_layout")
    known = known.select("file", (_by_layout({k: F.lit(h) for k, (h, _) in names.items()}) if names else none).alias("time_column"))
    examples = F.array_distinct(F.array_compact(F.coalesce("examples", F.array().cast("array<string>"))))
    return known.join(counts, "file", "left").fillna(0, ["n_rows", "n_unparsed", "n_odd_year"]).withColumn("examples", examples)


def _load_long(spark, folder, loose: bool) -> DataFrame:
    """``loose`` also accepts headers that merely contain 'tag' or 'val'."""
    files, found = catalogue(spark, folder), {}
    for k, layout in enumerate(files.layouts):
        h = list(layout.header)
        time = C.time_header(h) if loose else C.first_header(h, C.TIME_NAMES, ("date", "time"))
        others = [x for x in h if x != time]
        tag = C.first_header(others, C.TAG_NAMES, ("tag",) if loose else ())
        value = C.first_header([x for x in others if x != tag], C.VALUE_NAMES, ("val",) if loose else ())
        if time is None or tag is None or value is None:
            log.error("skipped files with %s: time=%s tag=%s value=%s", layout.header, time, tag, value)
            continue
        found[k] = [h.index(x) for x in (time, tag, value)]
    if not found:
        return spark.createDataFrame([], LONG_SCHEMA)
    time, tag, value = (_text({k: places[j] for k, places in found.items()}) for j in range(3))
    return files.lines().where(F.col("_layout").isin(list(found))).select(
        C.parse_timestamp(time).alias("datetime"), tag.alias("tagname"), C.number(value).alias("value"),
        F.xxhash64("_file", time, tag, value).alias("row_id"),
    ).where(F.col("datetime").isNotNull())


def load_current(spark: SparkSession, folder) -> DataFrame:
    """Current readings: datetime, tagname, value."""
    return _load_long(spark, folder, loose=True)


def load_other_data(spark: SparkSession, folder) -> DataFrame:
    """Telemetry readings: datetime, tagname, value."""
    return _load_long(spark, folder, loose=False)


def _dimension(spark, path) -> tuple[DataFrame, list[str]]:
    """All columns as text and ``row_no``, which rises with file name and line."""
    files = catalogue(spark, path)
    if not files.layouts:
        return spark.createDataFrame([], "row_no long"), []
    names = list(_columns(files.layouts))
    ordered = files.lines().select("_file", "_start", "_n", *_all_text(files)).orderBy("_file", "_start", "_n")
    return ordered.select(*[_quoted(c) for c in names], F.monotonically_increasing_id().alias("row_no")), names


def _blank_to_null(name):
    t = F.trim(_quoted(name))
    return F.when(t != "", t)


def load_device_mapping(spark: SparkSession, path) -> DataFrame:
    df, names = _dimension(spark, path)
    if not names:
        return spark.createDataFrame([], DEVICE_SCHEMA)
    required = ["tagname", "devicename", "machine_id", "model_group"]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"device mapping lacks {missing}")

    def date(c):
        return (C.parse_timestamp(_blank_to_null(c)) if c in names else F.lit(None).cast("timestamp_ntz")).alias(c)

    return df.select(*required, date("train_start"), date("train_end"), "row_no")


def load_tag_mapping(spark: SparkSession, path) -> DataFrame:
    """Headers may differ in case, spaces and hyphens. Without the required
    columns the mapping is empty."""
    df, names = _dimension(spark, path)
    plain = {re.sub(r"[\s-]", "_", c): c for c in reversed(names)}
    norm = {n: plain.get(C.first_header(plain, (n,))) for n in ("tagname", "variable_type", "device_id", "unit")}
    required = ("tagname", "variable_type", "device_id")
    missing = [c for c in required if not norm[c]]
    if missing:
        log.error("tag mapping lacks %s: %s", missing, names)
        return spark.createDataFrame([], TAG_SCHEMA)
    unit = _quoted(norm["unit"]) if norm["unit"] else F.lit("")
    return df.select(
        *[F.trim(_quoted(norm[c])).alias(c) for c in required], unit.alias("unit"), "row_no"
    )


def load_maintenance_log(spark: SparkSession, path) -> DataFrame:
    df, names = _dimension(spark, path)
    dev = C.first_header(names, C.DEVICE_NAMES)
    date = C.first_header(names, C.DATE_NAMES, C.DATE_PARTS)
    name = C.first_header([c for c in names if c != dev], (), C.EVENT_PARTS)
    if dev is None or date is None:
        log.warning("maintenance log lacks a device or date column: %s", names)
        return spark.createDataFrame([], LOG_SCHEMA)
    event = F.trim(_quoted(name)) if name else F.lit(None).cast("string")
    return df.select(
        F.trim(_quoted(dev)).alias("device_id"), C.parse_timestamp(_quoted(date)).alias("event_ts"),
        F.coalesce(event, F.lit(DEFAULT_EVENT_NAME)).alias("event_name"),
    ).where(F.col("event_ts").isNotNull())


def load_metrics(spark: SparkSession, path) -> DataFrame:
    """The four comparison metrics as numbers."""
    df = read_csv_multi_encoding(spark, path)
    missing = [m for m in DISPLAY_METRICS if m not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}; columns: {df.columns[:10]}")
    return df.select(*[C.number(m).alias(m) for m in DISPLAY_METRICS])


def metrics_audit(df: DataFrame) -> DataFrame:
    """Rows, and rows with any metric missing."""
    bad = F.greatest(*[F.col(m).isNull().cast("int") for m in DISPLAY_METRICS]) == 1
    return df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_incomplete"))
