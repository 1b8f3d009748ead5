"""Row-order operators on per-machine time series.

A window over a whole machine would put all its rows into one task. The
operators here deal the table by range of (machine, order) first, so that parts hold
about equally many rows however dense an hour is, and write it once. What crosses the
border of a part passes through a small table with one row per (machine, part). Rows
without a time stand before all others of their machine and are dealt by the rest of
the order; a NULL machine is one like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.operators.quantiles import join_groups
from rotorwatch.session import materialize

TIME_ORDER = ("datetime", "row_id")


def _sorted_struct(cols) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def in_parts(df: DataFrame, keys, order, cfg: Settings = DEFAULTS, numbered=False) -> DataFrame:
    """``df`` with ``_part``, its place in equally large ranges of (keys, order); if ``numbered``,
    with ``_row``, which counts the rows of a part in their order.

    Written once: the borders are drawn from a sample, and all readers must see the same ones.
    Columns that repeat may stand in both lists.
    """
    by = list(dict.fromkeys([*keys, *order]))
    # Several parts for each core, so that tasks which take parts by hash get about equally many rows.
    dealt = df.repartitionByRange(cfg.range_parts or 4 * df.sparkSession.sparkContext.defaultParallelism, *by)
    if numbered:  # a part is one task, whose ids are consecutive
        dealt = dealt.sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    return materialize(dealt.withColumn("_part", F.spark_partition_id()), "in-order")


def over_borders(parts: DataFrame, rows: DataFrame, keys, aggs, carried) -> DataFrame:
    """Join rows with what the other parts of their machine hand over: ``aggs`` per part, and
    ``carried(window)`` over the parts in order."""
    return _with_borders(rows, parts.groupBy(*keys, "_part").agg(*aggs), keys, carried)


def _with_borders(rows: DataFrame, per_part: DataFrame, keys, carried) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy("_part")
    # As many rows as machines and parts together; rows of the series stay where they are.
    borders = F.broadcast(per_part.select(*keys, "_part", *carried(along)))
    return join_groups(rows, borders, [*keys, "_part"], "left")


def with_position(df: DataFrame, keys, order=TIME_ORDER, name="pos", cfg: Settings = DEFAULTS) -> DataFrame:
    """Number the rows of each key from 0 in the given order."""
    keys = list(keys)
    parts = in_parts(df, keys, order, cfg)
    rows = parts.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    out = over_borders(
        parts, rows, keys,
        [F.count("*").alias("_n")],
        lambda w: [
            (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_skip")
        ],
    )
    return out.withColumn(name, F.col("_skip") + F.col("_rn") - 1).drop("_part", "_rn", "_n", "_skip")


def with_previous(
    df: DataFrame, keys, cols, order=TIME_ORDER, prefix="prev_", cfg: Settings = DEFAULTS
) -> DataFrame:
    """Add the values of the preceding row of the key (NULL on its first row)."""
    keys, cols = list(keys), list(cols)
    parts = in_parts(df, keys, order, cfg)
    in_part = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = parts.withColumn("_near", F.lag(_sorted_struct(cols)).over(in_part))
    out = over_borders(
        parts, rows, keys,
        [F.max_by(_sorted_struct(cols), _sorted_struct(order)).alias("_last")],
        lambda w: [F.lag("_last").over(w).alias("_far")],
    )
    prev = F.coalesce("_near", "_far")
    return out.select(*df.columns, *[prev[c].alias(prefix + c) for c in cols])


def _fill_parts(cols, order):
    """Aggregates per part and carried columns for forward and backward fill."""
    aggs = [
        f(F.col(c), F.when(F.col(c).isNotNull(), _sorted_struct(order))).alias(f"_{side}_{c}")
        for c in cols
        for f, side in ((F.max_by, "last"), (F.min_by, "first"))
    ]

    def carried(w):
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return [
            F.coalesce(
                F.last(f"_last_{c}", ignorenulls=True).over(earlier),
                F.first(f"_first_{c}", ignorenulls=True).over(whole),
            ).alias(f"_fill_{c}")
            for c in cols
        ]

    return aggs, carried


def _with_fill(parts: DataFrame, keys, cols, order):
    """Rows plus ``_fill_c``: the latest non-null value up to the row, or the
    machine's first non-null value where there is none yet."""
    in_part = Window.partitionBy(*keys, "_part").orderBy(*order)
    so_far = in_part.rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumns({f"_near_{c}": F.last(c, ignorenulls=True).over(so_far) for c in cols})
    aggs, carried = _fill_parts(cols, order)
    out = over_borders(parts, rows, keys, aggs, carried)
    return out.withColumns({f"_fill_{c}": F.coalesce(f"_near_{c}", f"_fill_{c}") for c in cols}) if cols else out


def fill_gaps(
    df: DataFrame, keys, cols, order=TIME_ORDER, suffix="", cfg: Settings = DEFAULTS
) -> DataFrame:
    """Forward fill, then backward fill of what is left at the start."""
    keys, cols = list(keys), list(cols)
    out = _with_fill(in_parts(df, keys, order, cfg), keys, cols, order)
    keep = [c for c in df.columns if suffix or c not in cols]
    return out.select(*keep, *[F.col(f"_fill_{c}").alias(c + suffix) for c in cols])


def _middle(values: Column) -> Column:
    """Median of an array; NULL for an empty one."""
    s = F.sort_array(values)
    n = F.size(s)
    low = F.get(s, F.floor((n - 1) / 2).cast("int"))
    high = F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def rolling_median(
    df: DataFrame, keys, cols, rows: int, order=TIME_ORDER, suffix="", fill=True,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Centred rolling median over ``rows`` rows that skips NULLs, then forward
    and backward fill.

    A smoothed value is NULL only where every raw value in reach is NULL. The
    value carried there is the median next to the gap, which sees exactly one raw
    value: the last one before the gap (or the first one of the series). So the
    fill can be taken from the raw column in the same pass that numbers the rows.
    """
    keys, cols = list(keys), list(cols)
    before, after = rows // 2, (rows - 1) // 2
    parts = in_parts(df, keys, order, cfg, numbered=True)
    group, place = [*keys, "_part"], F.col("_row")
    fills, fill_carried = _fill_parts(cols if fill else [], ["_row"])
    ends = parts.groupBy(*group).agg(F.min("_row").alias("_first"), F.max("_row").alias("_end"), *fills)
    # The rows that a frame of a neighbouring part can reach: a few per machine and part.
    near = join_groups(
        parts.select(*group, "_row", *cols), F.broadcast(ends.select(*group, "_first", "_end")), group
    ).withColumns({"_head": place < F.col("_first") + after, "_tail": place > F.col("_end") - before})
    row = _sorted_struct(["_row", *cols])
    edges = near.where("_head OR _tail").groupBy(*group).agg(*[
        F.sort_array(F.collect_list(F.when(F.col(side), row))).alias(f"{side}s") for side in ("_head", "_tail")])
    per_part = join_groups(ends, edges, group, "left")

    def carried(w):
        """The rows before a part and those after it, in order. Each part has at least one."""
        def rows_of(side, n, low, high):
            lists = F.flatten(F.collect_list(side).over(w.rowsBetween(low, high))) if n else F.array()
            return lists.alias("_before" if low < 0 else "_after")

        return ["_first", "_end", *fill_carried(w), rows_of("_tails", before, -before, -1), rows_of("_heads", after, 1, after)]

    in_part = Window.partitionBy(*group).orderBy("_row")
    frame, so_far = in_part.rowsBetween(-before, after), in_part.rowsBetween(Window.unboundedPreceding, 0)
    out = _with_borders(
        parts.withColumns({
            **{f"_near_{c}": F.collect_list(c).over(frame) for c in cols},
            **{f"_last_{c}": F.last(c, ignorenulls=True).over(so_far) for c in (cols if fill else [])},
        }), per_part, keys, carried)
    # How many rows of the frame lie before the part, and how many after it.
    lack, more = before - (place - F.col("_first")), after - (F.col("_end") - place)

    def values(c):
        sides = [F.col(f"_near_{c}")]
        if before:
            sides.append(F.when(lack > 0, F.slice(F.reverse("_before"), 1, lack.cast("int"))[c]))
        if after:
            sides.append(F.when(more > 0, F.slice("_after", 1, more.cast("int"))[c]))
        return F.concat(sides[0], *[F.coalesce(F.array_compact(s), F.array()) for s in sides[1:]])

    out = out.withColumns({f"_mid_{c}": _middle(values(c)) for c in cols})
    keep = [c for c in df.columns if suffix or c not in cols]

    def value(c):
        return F.coalesce(f"_mid_{c}", f"_last_{c}", f"_fill_{c}") if fill else F.col(f"_mid_{c}")

    return out.select(*keep, *[value(c).alias(c + suffix) for c in cols])
