"""Time arithmetic on timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS = 1_000_000


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", _epoch(), F.col(ts) if isinstance(ts, str) else ts)


def from_micros(u: Column) -> Column:
    return F.timestamp_add("MICROSECOND", u, _epoch())


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(_MICROS))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
