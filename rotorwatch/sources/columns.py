"""Repair of headers, timestamps and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted header names, best first.
TIME_NAMES = ("datetime", "date", "time", "timestamp")
TAG_NAMES = ("tagname", "tag_name", "tag", "tagid", "tag_id", "sensor", "sensorname", "sensor_id", "sensorid")
VALUE_NAMES = ("value", "val", "measurement", "reading", "data", "current")
DEVICE_NAMES = ("device_id", "device", "deviceid")
DATE_NAMES, DATE_PARTS = ("日期", "保養日期"), ("date",)
EVENT_PARTS = ("event", "name", "項目")
SCORE_NAMES = ("healthscore", "health_score", "health score")

# Fixed value: a date (year first, month first or eight digits), a clock time, a half of
# the day, a zone mark; slashes have become dashes.
STAMP = (
    r"^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{1,2})-(\d{1,2})-(\d{4})|(\d{4})(\d{2})(\d{2}))"
    r"(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d+))?)?(?: ?(AM|PM))?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?)?$"
)
YEARS = (2020, 2030)

# Fixed value: device and position in a vibration file name.
FILE_PATTERN = r"(?i)(?:冰水_)?([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)_(M[12])_Analytics"


def parse_timestamp(text) -> Column:
    """Timestamp without zone from text in any accepted layout, NULL otherwise.

    Fractions beyond microseconds are cut. A zone mark is dropped and the clock time
    kept; the session's zone plays no part.
    """
    c = F.col(text) if isinstance(text, str) else text
    clean = F.upper(F.trim(F.regexp_replace(F.regexp_replace(c.cast("string"), "/", "-"), r"\s+", " ")))
    # The pattern is matched once: a text that fits becomes its parts, any other stays whole.
    fits = F.when(~clean.contains("|"), F.regexp_replace(clean, STAMP, "$1$6$7|$2$4$8|$3$5$9|$10|$11|$12|$13|$14"))
    return F.transform(F.array(F.split(fits, r"\|")), _stamp)[0]


def _stamp(p) -> Column:
    """Timestamp from year, month, day, hour, minute, second, fraction and half of the day; NULL for a whole text."""
    def two(x):
        return F.lpad(x, 2, "0")

    hour, half = F.get(p, F.lit(3)), F.get(p, F.lit(7))
    number = hour.try_cast("int")
    hour = F.when(half == "", hour).when(number.between(1, 12), (number % 12 + F.when(half == "PM", 12).otherwise(0)).cast("string"))
    iso = F.concat(
        F.get(p, F.lit(0)), F.lit("-"), two(F.get(p, F.lit(1))), F.lit("-"), two(F.get(p, F.lit(2))), F.lit(" "),
        two(hour), F.lit(":"), two(F.get(p, F.lit(4))), F.lit(":"), two(F.get(p, F.lit(5))), F.lit("."), F.rpad(F.get(p, F.lit(6)), 6, "0"),
    )
    return F.when(F.size(p) == 8, iso.try_cast("timestamp_ntz"))


def timestamp_counts(ts="datetime") -> list[Column]:
    """Aggregates: timestamps that failed to parse, and those of an unlikely year."""
    odd = ~F.year(ts).between(*YEARS)
    return [F.count_if(F.col(ts).isNull()).alias("n_unparsed"), F.count_if(odd).alias("n_odd_year")]


def timestamp_audit(df: DataFrame, keys=(), ts="datetime") -> DataFrame:
    """How many timestamps failed to parse or lie in an unlikely year. Rows of
    unlikely years stay in the data."""
    return df.groupBy(*keys).agg(*timestamp_counts(ts))


def device_from_path(path) -> list[Column]:
    """devicename, position and device_id from a file path; NULL without a match.
    A directory written by Spark counts as the file it is named after."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(p, r"([^/]*?)(?:/part-[^/]*)?$", 1)
    base = F.regexp_extract(name, FILE_PATTERN, 1)
    pos = F.upper(F.regexp_extract(name, FILE_PATTERN, 2))
    found = base != ""
    return [
        F.when(found, base).alias("devicename"),
        F.when(found, pos).alias("position"),
        F.when(found, F.concat(base, F.lit("_"), pos)).alias("device_id"),
    ]


def first_header(columns, names=(), parts=()) -> str | None:
    """First column that equals a name (case aside, best name first), else the
    first that contains one of the parts."""
    lower = {}
    for c in columns:
        lower.setdefault(c.strip().lower(), c)
    for n in names:
        if n in lower:
            return lower[n]
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def time_header(columns) -> str | None:
    return first_header(columns, parts=("date", "time"))


def score_header(columns) -> str | None:
    if "HealthScore" in columns:
        return "HealthScore"
    return next((c for c in columns if c.lower() in SCORE_NAMES), None)


def number(col) -> Column:
    """Double from text; unreadable text and NaN give NULL."""
    c = F.col(col) if isinstance(col, str) else col
    v = c.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)
