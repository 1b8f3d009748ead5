"""Interleaving of sources in proportion to target weights by Pfair scheduling.

Rows of a source are put in a fixed random order and cut into blocks. Block j of a source of
weight w (of W in all) is released at slot floor(j*W/w) and due by slot ceil((j+1)*W/w);
earliest deadline first then keeps every source within less than one block of its share at
any time. Weights are whole numbers, so the schedule repeats after W slots: one cycle is
worked out once, and the slot of any block follows from it by arithmetic, row by row. When a
source ends, the others go on with their weights among themselves from there; no row is lost
or repeated.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rotorwatch.llm.rows import ROW, keyed
from rotorwatch.session import materialize


def cycle(weights: dict) -> dict:
    """Slots of each source in one cycle, by earliest deadline among released blocks. Of equal
    deadlines the lesser key is first."""
    total = sum(weights.values())
    slots: dict = {s: [] for s in weights}
    waiting, ready = [(0, s) for s in weights], []
    heapq.heapify(waiting)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // weights[s], s))
    return slots


def phases(blocks: dict, weights: dict) -> dict:
    """Of each source, per phase: ``(first block, first slot, cycle length, weight, slots)``.
    A phase ends with the slot in which some source places its last block."""
    left = {s: n for s, n in blocks.items() if n}
    done, out, at = dict.fromkeys(left, 0), {s: [] for s in left}, 0
    while left:
        g = math.gcd(*(weights[s] for s in left))
        w = {s: weights[s] // g for s in left}
        slots, total = cycle(w), sum(w.values())
        end = min((n - 1) // w[s] * total + slots[s][(n - 1) % w[s]] + 1 for s, n in left.items())
        for s in list(left):
            out[s].append((done[s], at, total, w[s], slots[s]))
            n = end // total * w[s] + sum(x < end % total for x in slots[s])
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at += end
    return out


def mix(
    docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block_rows: int = 64, others: int = 0,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the row key (``_ll_*``), id, source, ``block`` (of its source),
    ``slot`` (of the block in the mix), ``release`` and ``deadline`` (slots), ``position`` (sort key of
    the row in the mix).

    Of the sources that ``weights`` does not name, null among them, the ``others`` with the most rows are
    sources of ``rest_weight`` each, and what is left of them together is one more; so what reaches
    the driver is one count per weight. Rows of a source are
    numbered in slices by hash, about the root of their number each. Repeated rows keep
    their number. An empty table gives an empty result; null ids and texts are placed like others.
    """
    if min([rest_weight, *weights.values()]) < 1:
        raise ValueError("weights are whole numbers from 1")
    source = F.col(source_col).cast("string")
    sizes = materialize(docs.groupBy(source.alias("source")).count(), "sources")
    named = F.col("source").isin(*weights) if weights else F.lit(False)
    own = sizes.withColumn("named", F.coalesce(named, F.lit(False)))
    own = own.orderBy(F.desc("named"), F.desc("count"), "source").limit(len(weights) + others).collect()
    known = [r["source"] for r in own if r["named"]]
    known += [r["source"] for r in own if not r["named"]][:others]
    size = {r["source"]: r["count"] for r in own}
    left = int(sizes.agg(F.sum("count")).first()[0] or 0) - sum(size[s] for s in known)
    rest = len(known)
    counts = {q: size[s] for q, s in enumerate(known)} | ({rest: left} if left else {})
    weight = {q: weights.get(s, rest_weight) for q, s in enumerate(known)} | {rest: rest_weight}
    plan = phases({q: -(-n // block_rows) for q, n in counts.items()}, weight)
    # Bounded: a row per weight, and in it at most as many phases and slots as weights make.
    table = docs.sparkSession.createDataFrame(
        [(q, math.isqrt(counts[q]) + 1, [tuple(p) for p in plan[q]]) for q in counts],
        T._parse_datatype_string(
            "_ll_queue int, slices long, phases array<struct<first:long,at:long,total:long,weight:long,slots:array<int>>>"
        ),
    )
    queues = docs.sparkSession.createDataFrame(list(zip(known, range(rest), strict=True)), "_ll_known string, _ll_queue int")
    rows = keyed(docs, id_col, text_col).select(*ROW, F.col(source_col).alias("_ll_source"))
    rows = rows.join(F.broadcast(queues), F.col("_ll_source").cast("string").eqNullSafe(F.col("_ll_known")), "left")
    rows = rows.withColumn("_ll_queue", F.coalesce("_ll_queue", F.lit(rest))).drop("_ll_known")
    rows = rows.withColumn("_ll_order", F.shiftrightunsigned(F.xxhash64("_ll_id", "_ll_hash", F.lit("mix")), 33))
    sliced = rows.join(F.broadcast(table.select("_ll_queue", "slices")), "_ll_queue").withColumn(
        "_ll_slice", F.shiftright(F.col("_ll_order") * F.col("slices"), 31)
    ).drop("slices")
    at = ["_ll_queue", "_ll_slice"]
    before = Window.partitionBy("_ll_queue").orderBy("_ll_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*at).count().select(*at, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ll_before"))
    number = F.row_number().over(Window.partitionBy(*at).orderBy("_ll_order", *ROW)) - 1
    numbered = sliced.join(starts, at).withColumn("_ll_n", F.col("_ll_before") + number)
    j = F.floor(F.col("_ll_n") / block_rows)
    placed = numbered.join(F.broadcast(table.select("_ll_queue", "phases")), "_ll_queue").withColumn("block", j)
    placed = placed.withColumn("p", F.element_at(F.filter("phases", lambda x: x["first"] <= F.col("block")), -1))
    k, w, total = F.col("block") - F.col("p.first"), F.col("p.weight"), F.col("p.total")
    slot = F.col("p.at") + F.floor(k / w) * total + F.get(F.col("p.slots"), (k % w).cast("int"))
    return placed.select(
        *ROW, F.col("_ll_id").alias(id_col), F.col("_ll_source").alias(source_col), "block", slot.alias("slot"),
        (F.col("p.at") + F.floor(k * total / w)).alias("release"),
        (F.col("p.at") + F.ceil((k + 1) * total / w)).alias("deadline"),
        (slot * block_rows + F.col("_ll_n") % block_rows).alias("position"),
    )
