"""How far the sources of a language diverge in their terms.

Terms of a lot of texts are packed by length: up to eight bytes into one word of 64 bits, up to sixteen
into two, first byte highest, so that words order as bytes do. Packed terms are radix-sorted and
their runs counted in numpy; longer terms are sorted as bytes, in buckets of similar width. Lots hand
on one row per term, language and source, which Spark adds up.

Each kept term then travels once, with its counts by source. Terms of a language are dealt out in parts,
and each task adds up the differences of all pairs of sources over its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text
from rotorwatch.llm.text import texts_of
from rotorwatch.session import materialize

LOT = 1 << 23
"""Bytes of text counted together; a longer document is a lot of its own."""
PART = 1 << 12
"""Kept terms of a language in one part."""
TILE = 256
"""Sources whose differences from all others one row of a part adds up."""
SALTS = 64
"""Ways in which the terms of a language are dealt when they learn its size."""
CELLS = 1 << 20
"""Entries of the term by source matrix held at a time."""


def _byte_table() -> np.ndarray:
    """Bytes of terms in lower case, 0 for all others."""
    table = np.zeros(256, np.uint8)
    lower = np.arange(ord("a"), ord("z") + 1)
    table[lower] = table[lower - 32] = lower
    table[128:] = np.arange(128, 256)
    return table


BYTES = _byte_table()


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """Order by unsigned keys, the last one first, stable: one pass per 16 bits that differ."""
    order = None
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16) if shift else key.astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            digit = digit if order is None else digit[order]
            step = np.argsort(digit, kind="stable")  # a radix sort on 16 bits
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def _packed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` bytes (at most 8) from ``start`` as 64-bit words, first byte highest."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[start].view(">u8")[:, 0].astype(np.uint64)
    spare = (np.uint64(64) - np.uint64(8) * size.astype(np.uint64))
    return np.where(size > 0, (words >> (spare & np.uint64(63))) << (spare & np.uint64(63)), np.uint64(0))


def _strings(matrix: np.ndarray) -> pa.Array:
    """Strings from rows of bytes that end in zeros."""
    flat = matrix.ravel()
    offsets = np.zeros(len(matrix) + 1, np.int64)
    np.cumsum((matrix != 0).sum(1), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(matrix), pa.py_buffer(offsets), pa.py_buffer(flat[flat != 0].tobytes()))


def _runs(order, equal, group, doc):
    """First entry, count and number of documents of every run of one term and group."""
    new = np.ones(len(order), bool)
    new[1:] = ~equal | (group[order[1:]] != group[order[:-1]])
    other = new.copy()
    other[1:] |= doc[order[1:]] != doc[order[:-1]]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(other.astype(np.int64), first)


def count_terms(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """``(terms, group, count, documents)`` of the documents ``data[bounds[i]:bounds[i+1]]``, bucket by
    bucket of lengths. Documents of a group must follow each other."""
    data = np.append(BYTES[data], np.zeros(8, np.uint8))
    inside = data != 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    if len(bounds):  # a document ends a term
        cut = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    start, size = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size -= start
    doc = np.searchsorted(bounds, start, "right") - 1
    of = group[doc].astype(np.uint32)

    short = np.flatnonzero(size <= 8)
    if len(short):
        word = _packed(data, start[short], size[short])
        order = radix_order(of[short], word)
        first, count, docs = _runs(order, word[order[1:]] == word[order[:-1]], of[short], doc[short])
        yield _strings(word[first].astype(">u8").view(np.uint8).reshape(-1, 8)), of[short][first], count, docs
    middle = np.flatnonzero((size > 8) & (size <= 16))
    if len(middle):
        high = _packed(data, start[middle], np.full(len(middle), 8))
        low = _packed(data, start[middle] + 8, size[middle] - 8)
        order = radix_order(of[middle], low, high)
        same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        first, count, docs = _runs(order, same, of[middle], doc[middle])
        both = np.stack([high[first], low[first]], 1).astype(">u8").view(np.uint8).reshape(-1, 16)
        yield _strings(both), of[middle][first], count, docs
    width = 32
    while (size > width // 2).any():  # buckets of 17 to 32 bytes, 33 to 64, ...
        long = np.flatnonzero((size > width // 2) & (size <= width))
        if len(long):
            matrix = np.zeros((len(long), width), np.uint8)
            at = np.arange(width)[None, :] < size[long][:, None]
            matrix[at] = data[np.repeat(start[long] - (np.cumsum(size[long]) - size[long]), size[long]) + np.arange(size[long].sum())]
            key = matrix.view(f"S{width}")[:, 0]
            order = np.lexsort((of[long], key))
            first, count, docs = _runs(order, key[order[1:]] == key[order[:-1]], of[long], doc[long])
            yield _strings(matrix[first]), of[long][first], count, docs
        width *= 2


def _counted(batches):
    """Rows ``(lang, source, term, n, docs)`` of each lot; a group's own row has no term."""
    for batch in batches:
        lang, source = (batch.column(c).cast(pa.string()).dictionary_encode() for c in ("lang", "source"))
        width = max(1, len(source.dictionary))
        code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width
        code += source.indices.to_numpy(zero_copy_only=False)
        groups, group = np.unique(code, return_inverse=True)
        order = np.argsort(group, kind="stable")
        data, bounds = texts_of(batch.column("text").take(pa.array(order)))
        group, lo = group[order], 0

        def rows(term, of, n, docs, groups=groups, lang=lang, source=source, width=width):
            which = groups[of]
            return pa.RecordBatch.from_arrays([
                lang.dictionary.take(pa.array(which // width)), source.dictionary.take(pa.array(which % width)),
                term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])

        if len(groups):
            zero = np.zeros(len(groups), np.int64)
            yield rows(pa.nulls(len(groups), pa.string()), np.arange(len(groups)), zero, zero)
        while lo < len(group):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + LOT, "right")) - 1)
            for term, of, n, docs in count_terms(data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], group[lo:hi]):
                yield rows(term, of, n, docs)
            lo = hi


def shares(count: np.ndarray, total) -> np.ndarray:
    """``1 + floor(10^9 * count / total)`` for counts up to ``total``, in whole numbers below 2^53."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class _Language:
    """The sources of one language, and the sums of the terms seen so far."""

    def __init__(self, head, tile, smooth, most):
        self.sources, self.smooth, self.most = [h["source"] for h in head["cells"]], smooth, most
        self.bottom = np.array([h["n"] for h in head["cells"]], np.int64) + smooth * head["v"]
        self.whole = int(sum(h["n"] for h in head["cells"])) + smooth * head["v"]
        self.index = pa.array(self.sources, pa.string())
        self.mine = np.arange(tile * TILE, min(len(self.sources), (tile + 1) * TILE))
        self.pairs = np.zeros((len(self.mine), len(self.sources)), np.int64)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))
        self.base = shares(np.full(len(self.sources), smooth, np.int64), np.maximum(self.bottom, 1))

    def add(self, terms: np.ndarray, owner: np.ndarray, source: pa.Array, n: np.ndarray):
        """Terms in rising order, and their counts: the term of each, its source and the count."""
        at = pc.index_in(source, self.index).to_numpy(zero_copy_only=False).astype(np.int64)
        p = shares(n + self.smooth, self.bottom[at])
        total = np.bincount(owner, weights=n, minlength=len(terms)).astype(np.int64)
        q = shares(total + self.smooth, self.whole)
        step = max(1, CELLS // len(self.sources))
        for lo in range(0, len(terms), step):
            inside = (owner >= lo) & (owner < lo + step)
            matrix = np.tile(self.base, (min(step, len(terms) - lo), 1))
            matrix[owner[inside] - lo, at[inside]] = p[inside]
            for k, own in enumerate(self.mine):
                self.pairs[k] += np.abs(matrix - matrix[:, own:own + 1]).sum(0)
        over = (n > 0) & (p > q[owner]) & (at >= self.mine[0]) & (at <= self.mine[-1])
        self._keep(at[over], (p - q[owner])[over], terms[owner[over]])

    def _keep(self, at, value, term):
        """Of each source the terms of the largest values; of equal ones those first in byte order."""
        at, value, term = (np.concatenate(x) for x in zip(self.best, (at, value, term), strict=True))
        order = np.lexsort((-value, at))
        at, value, term = at[order], value[order], term[order]
        first, last = np.searchsorted(at, at, "left"), np.searchsorted(at, at, "right")
        near = value >= value[np.minimum(first + self.most, last) - 1]  # ties of the last place too
        at, value, term = at[near], value[near], term[near]
        order = sorted(range(len(at)), key=lambda k: (at[k], -value[k], term[k].encode()))
        at, value, term = at[order], value[order], term[order]
        near = np.arange(len(at)) - np.searchsorted(at, at, "left") < self.most
        self.best = at[near], value[near], term[near]

    def rows(self, lang):
        k, j = np.nonzero(self.mine[:, None] != np.arange(len(self.sources))[None, :])
        at, value, term = self.best
        own = np.concatenate([self.mine[k], at])
        item = pa.concat_arrays([self.index.take(pa.array(j)), pa.array(term.tolist(), pa.string())])
        return pa.RecordBatch.from_arrays([
            pa.array([lang] * len(own), pa.string()), self.index.take(pa.array(own)),
            pa.array(["pair"] * len(k) + ["term"] * len(at), pa.string()), item,
            pa.array(np.concatenate([self.pairs[k, j], value]), pa.int64()),
        ], ["lang", "source", "part", "item", "value"])


def _compared(smooth, most):
    """Rows ``(lang, source, part, item, value)``: sums over the terms of a part, and its leading terms."""
    def run(batches):
        now, state = None, None
        for batch in batches:
            lo, keys = 0, list(zip(*(batch.column(c).to_pylist() for c in ("lang", "tile", "slice")), strict=True))
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != now:
                    if state is not None:
                        yield state.rows(now[0])
                    now = keys[lo]
                    head = batch.slice(lo, 1).to_pylist()[0]  # the row without a term comes first
                    state = _Language(head, now[1], smooth, most)
                    lo += 1
                if lo < hi:
                    part = batch.slice(lo, hi - lo)
                    cells = part.column("cells")
                    flat = cells.flatten()
                    owner = np.repeat(np.arange(hi - lo), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
                    terms = np.array(part.column("term").to_pylist(), object)
                    state.add(terms, owner, flat.field("source"), flat.field("n").to_numpy(zero_copy_only=False))
                lo = hi
        if state is not None:
            yield state.rows(now[0])
    return run


def audit(docs: DataFrame, least: int = 30, smooth: int = 5, most: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` for the sources of each language.

    A term is a run of letters A-Z (lower-cased), a-z and characters beyond ASCII. Each language keeps the V
    terms that stand in ``least`` of its documents or more. In a source with N occurrences of kept terms, a term
    with ``count`` has the share ``p = 1 + floor(10^9 * (count + smooth) / (N + smooth * V))``. Part ``pair``: every other
    source of the language and the sum of \\|p - q\\| over all kept terms. Part ``term``: kept terms that occur in
    the source with a larger share than in the whole language, and the difference, up to rank ``most``. Ranks
    count from 1 by falling value, then by the item's bytes. Arithmetic is in whole numbers, exact up to 2^53
    occurrences in a language.

    Null text, language and source are empty strings. Every row is a document, repeated ones too. A source
    whose documents have no term takes part with count 0. A single source has no pairs. An empty table
    gives an empty result. Only columns ``text``, ``lang`` and ``source`` are read.
    """
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A term's counts by source; without a term, the sources of the language.
    kept = materialize(
        counted.groupBy("lang", "term").agg(
            F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"), F.sum("docs").alias("docs"))
        .where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs"), "kept-terms")
    cells = kept.select("lang", "term", F.explode("cells").alias("c")).select("lang", "term", "c.source", "c.n")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("term").alias("v"))
    heads = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells")).join(sizes, "lang")
    slices = F.ceil(F.greatest("v", F.lit(1)) / F.lit(PART)).cast("long")
    tiles = F.ceil(F.size("cells") / F.lit(TILE)).cast("long")
    per_lang = heads.select("lang", "v", slices.alias("slices"), tiles.alias("tiles"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = (
        heads.withColumns({"slices": slices, "tiles": tiles}).withColumn("slice", upto("slices")).withColumn("tile", upto("tiles"))
        .select("lang", "tile", "slice", F.lit(None).cast("string").alias("term"), "cells", "v")
    )
    per_lang = per_lang.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    terms = (
        kept.where(F.col("term").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SALTS)))
        .join(per_lang, ["lang", "salt"])
        .withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices"))).withColumn("tile", upto("tiles"))
        .select("lang", "tile", "slice", "term", "cells", "v")
    )
    dealt = first.unionByName(terms).repartition("lang", "tile", "slice").sortWithinPartitions(
        "lang", "tile", "slice", F.asc_nulls_first("term"))
    sums = dealt.mapInArrow(_compared(smooth, most), "lang string, source string, part string, item string, value long")
    sums = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= most))
