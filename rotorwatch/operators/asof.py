"""Nearest as-of join within a tolerance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.functions.times import micros
from rotorwatch.operators.series import in_parts, over_borders


def asof_nearest(
    left: DataFrame, right: DataFrame, keys, payload, tolerance_s: int | None = None,
    ts: str = "datetime", right_order: str | None = None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Left rows plus the ``payload`` columns of the nearest right row.

    The distance limit is inclusive; of two equally near rows the earlier wins;
    left rows without a match keep NULLs. All payload columns come from one right
    row, its NULLs included. Of right rows with one timestamp the last counts when
    looking back and the first when looking ahead (``right_order`` says which). A NULL
    key or time matches nothing.

    Both sides form one table in the order of (key, time), cut into parts of about equally
    many rows. The nearest mark beyond either border of a part comes from a table with one row
    per (key, part), so neither a busy key nor a dense hour is one task's work, and no row is copied.
    """
    keys, payload = list(keys), list(payload)
    tol = (cfg.merge_tolerance_s if tolerance_s is None else tolerance_s) * 1_000_000

    body = F.struct(*[F.col(c) for c in payload])
    rank = F.col(right_order) if right_order else body
    known = [F.col(c).isNotNull() for c in (*keys, ts)]
    marks = (
        right.where(reduce(lambda a, b: a & b, known))
        .groupBy(*keys, ts)
        .agg(F.max_by(body, rank).alias("_late"), F.min_by(body, rank).alias("_early"))
        .withColumn("_u", micros(ts))
        .select(
            *keys, "_u", F.lit(0).alias("_side"),
            F.struct("_u", F.col("_late").alias("v")).alias("_back"),
            F.struct("_u", F.col("_early").alias("v")).alias("_ahead"),
        )
    )
    # Rows of one key and time may be many; a hash of the row deals them out.
    rows = left.withColumns({"_u": micros(ts), "_side": F.lit(1), "_tie": F.xxhash64(*left.columns)})
    order = ("_u", "_side")
    parts = in_parts(rows.unionByName(marks, allowMissingColumns=True), keys, (*order, "_tie"), cfg)
    part = Window.partitionBy(*keys, "_part")
    past = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is the same running frame on the reversed order.
    future = part.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    near = parts.withColumns({
        "_b": F.last("_back", ignorenulls=True).over(past), "_a": F.last("_ahead", ignorenulls=True).over(future),
    }).where(F.col("_side") == 1)
    mark = F.when(F.col("_side") == 0, F.col("_u"))
    found = over_borders(
        parts, near, keys, [F.max_by("_back", mark).alias("_last"), F.min_by("_ahead", mark).alias("_first")],
        lambda w: [
            F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        ],
    ).withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")}).withColumns(
        {"_db": F.col("_u") - F.col("_b._u"), "_da": F.col("_a._u") - F.col("_u")}
    )
    pick = F.when(
        (F.col("_db") <= tol) & (F.col("_da").isNull() | (F.col("_db") <= F.col("_da"))), F.col("_b.v")
    ).when(F.col("_da") <= tol, F.col("_a.v"))
    keep = [c for c in left.columns if c not in payload]
    return found.withColumn("_hit", pick).select(*keep, *[F.col("_hit")[c].alias(c) for c in payload])
