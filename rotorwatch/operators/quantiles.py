"""Exact percentiles and average ranks, in one way for groups of any size.

Percentiles are selected by brackets. One mergeable aggregate gives a sketch of every column together
with all other aggregates of a group; the sketch names two values between which a wanted place must
lie. A second aggregate over the rows counts what lies below the bracket and, of the few values
within it, how often each occurs; there the place is found exactly. Only the table with one row per
group is written, and no group is sorted as a whole.

Medians of windows go by bins of equally many values instead, which such a sketch gives: counts of bins
tell in which one a place lies, and only its values are looked at.

Ranks need all values in order: distinct values are counted where the rows are, then dealt by
range of (group, value), so that a large group spreads over many parts. A small table with the row
count of every (group, part) tells how many values lie before a part, and only within a part are
values sorted. NULL keys are groups like others; NULL and NaN values are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.session import materialize

SKETCH = 10_000
"""A sketch errs by one in so many rows of its group, at most."""
BINS = 128
"""Bins of a key's values over all its windows, a power of two."""
REACH = ((10_000, 3 / SKETCH), (40, 0.05), (0, 1.0))
"""From so many rows on, how far a bracket reaches to each side: two rows more than the sketch may err."""


def join_groups(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on keys of which NULLs count as equal; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys])
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def _long(df: DataFrame, keys, cols, cell=()) -> DataFrame:
    """One row per known value, with its column's name."""
    pairs = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in cols])
    return (
        df.select(*keys, *cell, F.explode(pairs).alias("_x"))
        .select(*keys, *cell, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    )


def _ranged(df: DataFrame, keys, cols) -> DataFrame:
    """Counts of distinct values per group with ``_p``, the part of the value order
    they lie in. Written once, because a part's borders are drawn from a sample."""
    counted = _long(df, keys, cols).groupBy(*keys, "_m", "_v").agg(F.count("*").alias("_c"))
    return materialize(
        counted.repartitionByRange(*keys, "_m", "_v").withColumn("_p", F.spark_partition_id()), "value-counts"
    )


def _up_to(order: Window) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, 0)


def _with_skips(sizes: DataFrame, group) -> DataFrame:
    """Per part, how many values of the group lie before it, and the group's total."""
    return sizes.withColumns({
        "_skip": F.sum("_n").over(_up_to(Window.partitionBy(*group).orderBy("_p"))) - F.col("_n"),
        "_total": F.sum("_n").over(Window.partitionBy(*group)),
    })


def _positions(wanted: dict):
    """Of each percentile, the (lower and upper) places in the order of its column."""
    for name, (c, p) in wanted.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        yield name, c, at, F.floor(at), F.ceil(at)


def _pick(rows: DataFrame, keys, wanted: dict) -> DataFrame:
    """Percentiles from rows with ``_m``, ``_v``, ``_c``, ``_upto`` and ``_total``."""
    aggs, out = [], []
    for i, (name, c, at, low, high) in enumerate(_positions(wanted)):
        def holds(place, c=c):
            return (F.col("_m") == c) & (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c"))

        aggs += [
            F.max(F.when(holds(low), F.col("_v"))).alias(f"_low{i}"),
            F.max(F.when(holds(high), F.col("_v"))).alias(f"_high{i}"),
            F.max(F.when(F.col("_m") == c, at - low)).alias(f"_share{i}"),
        ]
        a, b, s = F.col(f"_low{i}"), F.col(f"_high{i}"), F.col(f"_share{i}")
        out.append(F.when(a == b, a).otherwise(a * (F.lit(1.0) - s) + b * s).alias(name))
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *out)


def _placed(rows: DataFrame, keys) -> DataFrame:
    """Rows with ``_upto``, how many values of the group come up to theirs, and ``_total``."""
    part = [*keys, "_m", "_p"]
    sizes = rows.groupBy(*part).agg(F.sum("_c").alias("_n"))
    before = _with_skips(sizes, [*keys, "_m"]).drop("_n")
    inside = F.sum("_c").over(_up_to(Window.partitionBy(*part).orderBy("_v")))
    return join_groups(rows.withColumn("_inside", inside), before, part).withColumn(
        "_upto", F.col("_skip") + F.col("_inside"))


def _known(c: str) -> str:
    """SQL of a column as double, NULL where it is NaN."""
    v = "CAST(`" + c.replace("`", "``") + "` AS DOUBLE)"
    return f"CASE WHEN NOT isnan({v}) THEN {v} END"


def _clip(p: float) -> float:
    return min(1.0, max(0.0, p))


def _doubles(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def exact_percentiles(df: DataFrame, keys, wanted: dict, extra=()) -> DataFrame:
    """One row per group with ``{name: (column, probability)}`` percentiles.

    Linear interpolation between neighbours, as pandas does. ``extra`` are further
    aggregates of the same groups. Groups whose values are all NULL still get their row.
    The rows are read twice: for the sketch, and for the counts within brackets.
    """
    # Expressions are SQL text: with many columns, calls to the JVM would cost more than the job.
    keys, cols = list(keys), sorted({c for c, _ in wanted.values()})
    at = {c: sorted({float(p) for d, p in wanted.values() if d == c}) for c in cols}
    edges = {c: sorted({_clip(p + side * reach) for p in at[c] for side in (-1, 1) for _, reach in REACH}) for c in cols}
    # One row per group, written so that the rows are read for it once, and joined with a table of known size.
    sketch = materialize(df.groupBy(*keys).agg(*extra, *[F.expr(x) for i, c in enumerate(cols) for x in (
        f"count({_known(c)}) AS _count{i}",
        f"percentile_approx({_known(c)}, {_doubles(edges[c])}, {SKETCH}) AS _edge{i}",
    )]), "sketch")
    places = [(i, p) for i, c in enumerate(cols) for p in at[c]]

    def edge(i, p, side):
        """The bracket's value on one side of the place, by the size of the group."""
        return "coalesce(" + ", ".join(
            f"CASE WHEN _count{i} >= {least} THEN _edge{i}[{edges[cols[i]].index(_clip(p + side * reach))}] END"
            for least, reach in REACH) + ")"

    brackets = sketch.select(*keys, *[F.expr(f"{edge(i, p, side)} AS _{name}{k}")
                                      for k, (i, p) in enumerate(places) for side, name in ((-1, "from"), (1, "to"))])
    inside = join_groups(df.select(*keys, *[F.expr(f"{_known(c)} AS _v{i}") for i, c in enumerate(cols)]), brackets, keys)
    # Values below a bracket count as one NULL value; those above are left out.
    hits = ", ".join(
        f"CASE WHEN _v{i} <= _to{k} THEN named_struct('_k', {k}, '_v', CASE WHEN _v{i} >= _from{k} THEN _v{i} END) END"
        for k, (i, _) in enumerate(places))
    counts = (
        inside.select(*keys, F.expr(f"explode(filter(array({hits}), x -> x IS NOT NULL)) AS _x"))
        .groupBy(*keys, F.col("_x._k").alias("_k"), F.col("_x._v").alias("_v")).agg(F.count("*").alias("_c"))
    )
    # Each place lies where the running count first passes it.
    total = F.expr("array(" + ", ".join(f"_count{i}" for i, _ in places) + ")[_k]")
    share = F.expr(f"{_doubles(p for _, p in places)}[_k]")
    upto = F.sum("_c").over(_up_to(Window.partitionBy(*keys, "_k").orderBy("_v")))
    sizes = sketch.select(*keys, *[f"_count{i}" for i in range(len(cols))])
    placed = join_groups(counts.withColumn("_upto", upto), sizes, keys).select(
        *keys, "_k", "_v", "_c", "_upto", (share * (total - 1)).alias("_at"))
    holds = "{0}(_at) < _upto AND {0}(_at) >= _upto - _c"
    hit = placed.select(*keys, "_k", *map(F.expr, (
        f"CASE WHEN {holds.format('floor')} THEN _v END AS _low", f"CASE WHEN {holds.format('ceil')} THEN _v END AS _high",
        "_at - floor(_at) AS _share",
    )))
    found = hit.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN _k = {k} THEN {x} END) AS {x}{k}")
                                     for k in range(len(places)) for x in ("_low", "_high", "_share")])
    out = join_groups(sketch, found, keys, "left")
    number = {(cols[i], p): k for k, (i, p) in enumerate(places)}

    def between(name, c, p):
        k = number[c, float(p)]
        return F.expr(
            f"CASE WHEN _count{cols.index(c)} > 0 AND (_low{k} IS NULL OR _high{k} IS NULL) THEN raise_error('no exact place') "
            f"WHEN _low{k} = _high{k} THEN _low{k} ELSE _low{k} * (1D - _share{k}) + _high{k} * _share{k} END").alias(name)

    own = {f"_{x}{i}" for i in range(len(cols)) for x in ("count", "edge")}
    more = [c for c in sketch.columns if c not in keys and c not in own]
    return out.select(*keys, *more, *[between(name, c, p) for name, (c, p) in wanted.items()])


def _bin(value: Column, edges: Column) -> Column:
    """How many of BINS - 1 sorted edges lie below a value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(BINS.bit_length() - 1))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(edges, at + step) < value, at + step).otherwise(at))


def window_percentiles(df: DataFrame, key: str, wanted: dict, cell, windows_of) -> DataFrame:
    """Percentiles per (key, window_no) where windows are runs of cells.

    ``windows_of`` copies a table with the columns ``cell`` into the windows of each cell. A sketch
    deals the values of each key into BINS bins of about equally many. Only their counts are copied
    into windows, and of the values, counted by cell, only those of bins in which a window of the key
    has a wanted place. The sketch sets what is copied, not what comes out.
    """
    cell, group, column = list(cell), [key, "window_no"], [key, "_m"]
    rows = _long(df, [key], sorted({c for c, _ in wanted.values()}), cell)
    edges = rows.groupBy(*column).agg(
        F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], SKETCH).alias("_edges"))
    edges = materialize(edges, "edges")  # all readers must see the same ones
    binned = join_groups(rows, F.broadcast(edges), column).withColumn("_p", _bin(F.col("_v"), F.col("_edges"))).drop("_edges")
    sizes = windows_of(binned.groupBy(key, *cell, "_m", "_p").agg(F.count("*").alias("_n")))
    parts = _with_skips(sizes.groupBy(*group, "_m", "_p").agg(F.sum("_n").alias("_n")), [*group, "_m"])
    hit = reduce(lambda a, b: a | b, [
        (F.col("_m") == c) & (place >= F.col("_skip")) & (place < F.col("_skip") + F.col("_n"))
        for _, c, _, low, high in _positions(wanted) for place in (low, high)
    ])
    needed = materialize(parts.where(hit).drop("_n"), "needed-bins")
    some = needed.groupBy(*column).agg(F.collect_set("_p").alias("_hits"))
    near = join_groups(binned, F.broadcast(some), column).where(F.array_contains("_hits", F.col("_p")))
    part = [*group, "_m", "_p"]
    counted = windows_of(near.groupBy(key, *cell, "_m", "_p", "_v").agg(F.count("*").alias("_c")))
    values = join_groups(counted, needed, part).groupBy(*part, "_skip", "_total", "_v").agg(F.sum("_c").alias("_c"))
    inside = F.sum("_c").over(_up_to(Window.partitionBy(*part).orderBy("_v")))
    return _pick(values.withColumn("_upto", F.col("_skip") + inside), group, wanted)


def average_ranks(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """One row per (group, distinct value) with the average rank of its ties.

    Ties are counted before anything is sorted, so a value that fills a third of
    a group costs one row here.
    """
    keys = list(keys)
    rank = F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0)
    return _placed(_ranged(df, keys, [value]), keys).select(*keys, F.col("_v").alias(value), rank.alias(name))


def with_centred_ranks(rows: DataFrame, keys, value: str, weight: str, name: str) -> DataFrame:
    """Rows plus ``name``, the average rank of ``value`` in its group less the mean rank, and ``name`` with
    ``_value``, the value less the group's mean. A row stands for ``weight`` equal ones.

    Rows are dealt by range of (group, value) with a hash behind, so that one value of very many rows
    spreads too. What lies in other parts, ties of a part's first and last value among it, comes from
    a table with one row per (group, part); no join is keyed by a value.
    """
    keys = list(keys)
    dealt = rows.repartitionByRange(*keys, value, F.xxhash64(*rows.columns))
    parts = materialize(dealt.withColumn("_p", F.spark_partition_id()), "ranked")
    group, v, c = [*keys, "_p"], F.col(value), F.col(weight)
    per_value = parts.groupBy(*group, v.alias("_v")).agg(F.sum(c).alias("_c"))
    per_part = per_value.groupBy(*group).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_v") * F.col("_c")).alias("_s"),
        F.min("_v").alias("_first"), F.min_by("_c", "_v").alias("_c_first"),
        F.max("_v").alias("_last"), F.max_by("_c", "_v").alias("_c_last"),
    )
    whole = Window.partitionBy(*keys)
    per_part = per_part.withColumns({
        "_skip": F.sum("_n").over(_up_to(whole.orderBy("_p"))) - F.col("_n"),
        "_total": F.sum("_n").over(whole), "_mean": F.sum("_s").over(whole) / F.sum("_n").over(whole),
    })
    # A value in several parts is the last of one and the first of the next.
    ends = F.array(
        F.struct(F.lit(0).alias("e"), F.col("_first").alias("v"), F.col("_c_first").alias("c"), F.col("_skip").alias("less")),
        F.struct(F.lit(1).alias("e"), F.col("_last").alias("v"),
                 F.when(F.col("_last") == F.col("_first"), 0).otherwise(F.col("_c_last")).alias("c"),
                 (F.col("_skip") + F.col("_n") - F.col("_c_last")).alias("less")),
    )
    same = Window.partitionBy(*keys, "_x.v")
    at = lambda e, x: F.max(F.when(F.col("_x.e") == e, x))
    borders = (
        per_part.withColumn("_x", F.explode(ends))
        .withColumn("_rank", F.min("_x.less").over(same) + (F.sum("_x.c").over(same) + 1) / F.lit(2.0))
        .groupBy(*group, "_skip", "_total", "_mean")
        .agg(at(0, F.col("_x.v")).alias("_first"), at(0, F.col("_rank")).alias("_rank_first"),
             at(1, F.col("_x.v")).alias("_last"), at(1, F.col("_rank")).alias("_rank_last"))
    )
    order = Window.partitionBy(*group).orderBy(v)
    inside = parts.withColumns({
        "_ties": F.sum(c).over(Window.partitionBy(*group, value)),
        "_upto": F.sum(c).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    rank = (
        F.when(v == F.col("_first"), F.col("_rank_first")).when(v == F.col("_last"), F.col("_rank_last"))
        .otherwise(F.col("_skip") + F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0))
    )
    return join_groups(inside, borders, group).select(
        *rows.columns, (rank - (F.col("_total") + 1) / F.lit(2.0)).alias(name), (v - F.col("_mean")).alias(f"{name}_value"))
