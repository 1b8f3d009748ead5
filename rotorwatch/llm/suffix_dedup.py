"""Repeated byte strings by suffix sorting with a difference cover.

A string of ``window`` bytes that starts at two places stays out of both. Suffixes are sorted only
as deep as ``window`` bytes, and only where a repeat is possible:

1. Texts are packed into lots of some MB, written once. In each window the smallest hash of its
   ``gram``-byte runs is its anchor; consecutive windows with one anchor are a stretch of text. Equal
   windows have equal anchors, so a window whose anchor occurs once in the corpus can't be repeated.
2. Stretches whose anchors repeat are dealt by anchor. Equal stretches of a lot, and of a bucket, are one.
3. Each bucket of texts is sorted by the difference cover of 3: places 1 and 2 of every three are the
   sample; its triples are sorted and named, the names are sorted the same way one third as deep, and
   the remaining suffixes are merged with the sample by their first symbol and the rank after it.
4. Neighbours in that order are compared over ``window`` bytes.

An anchor of very many different stretches (``CROWD``) would fill one task. Its windows are dealt
by their own 128-bit hashes instead and counted by those.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text
from rotorwatch.llm.substring_dedup import merged
from rotorwatch.llm.text import mix, pieces
from rotorwatch.session import materialize

LOT = 1 << 21
"""Bytes of text in a lot; a longer document is a lot of its own."""
BATCH = 1 << 21
"""Bytes of stretches that are sorted together at least, whole buckets at a time."""
CROWD = 1 << 13
"""Different stretches of one anchor from which its windows are dealt by hash."""
PLACE = np.uint64((1 << 22) - 1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Prefixes:
    """Hashes of any stretch of some bytes, from sums over prefixes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data) + 1
        self.power = _powers(n, base)
        self.total = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, pow(base, -1, 1 << 64))[:-1], out=self.total[1:])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * self.power[start])


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, kept for the next lot."""
    have = _KEPT.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << int(n - 1).bit_length() if n > 1 else 1, base, np.uint64)
        have[0] = 1
        have = _KEPT[base] = np.cumprod(have)
    return have[:n]


def window_starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """First byte of every window of the documents."""
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    first = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(bounds[:-1] - first, n)


def stretches(data: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Anchor, number of windows and hash of every stretch. The stretches of a lot follow each other
    without gaps through its windows. Of equal hashes in a window the leftmost is its anchor."""
    starts = window_starts(bounds, window)
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return none, np.zeros(0, np.uint16), none
    all_ = Prefixes(data)
    span = window - gram + 1
    at = np.zeros(len(starts), np.int64)
    step = int(PLACE) - window
    for a in range(0, len(data) - window + 1, step):
        b = min(len(data) - gram + 1, a + step + span - 1)
        h = all_.hash(np.arange(a, b), gram)
        low = (h & ~PLACE) | np.arange(b - a, dtype=np.uint64)
        width = 1
        while width < span:  # sliding minimum by doubling
            more = min(width, span - width)
            low = np.minimum(low[:len(low) - more], low[more:])
            width += more
        lo, hi = np.searchsorted(starts, [a, a + step])
        at[lo:hi] = a + (low[starts[lo:hi] - a] & PLACE).astype(np.int64)
    doc = np.searchsorted(bounds, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    return all_.hash(at[first], gram), count.astype(np.uint16), all_.hash(begin, count + window - 1)


def _lots(window, gram):
    """Lots of texts: ids, bounds, bytes, and the anchors and lengths of their stretches. ``distinct``
    has, for the sorted anchors of the lot, how many different stretches each has (65535: as many or more)."""
    def run(batches):
        squeeze, part, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("_ll_id")
            for lo, hi, data, bounds in pieces(batch, "_ll_text", LOT):
                anchor, count, whole = stretches(data, bounds, window, gram)
                order = np.lexsort((whole, anchor))
                differ = np.append(True, (np.diff(anchor[order]) != 0) | (np.diff(whole[order]) != 0))[:len(order)]
                each = np.unique(anchor[order][differ], return_counts=True)[1]
                each = np.minimum(each, 65535).astype(np.uint16)
                binary = [bounds.tobytes(), data.tobytes(), count.tobytes(), each.tobytes()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo)),
                    *[pa.array([squeeze.compress(b)], pa.binary()) for b in binary],
                    pa.array([anchor.tobytes()], pa.binary()),
                ], ["lot", "ids", "bounds", "data", "count", "distinct", "anchor"])
                number += 1
    return run


def _read(payload, kind):
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), kind)


def _pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(values))


def _unpack(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def _rows(batch):
    """The rows one by one: a lot is large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _by_bucket(bucket):
    """Index runs of equal buckets, in the order of the buckets."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def _anchors(buckets):
    """Rows ``(bucket, lot, payload)``: anchors of a lot, how often they occur, how many stretches differ."""
    def run(batches):
        for batch in batches:
            for lot, anchor, distinct in zip(*(batch.column(c).to_pylist() for c in ("lot", "anchor", "distinct")), strict=True):
                u, n = np.unique(np.frombuffer(anchor, np.uint64), return_counts=True)
                bucket = (u % np.uint64(buckets)).astype(np.int64)
                each = _read(distinct, np.uint16)
                parts = _by_bucket(bucket)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([lot] * len(parts), pa.int64()),
                    pa.array([pickle.dumps((u[p], np.minimum(n[p], 2).astype(np.uint8), each[p])) for p in parts], pa.binary()),
                ], ["bucket", "lot", "payload"])
    return run


def _grouped(batches, flush):
    """Call ``flush(rows)`` for the rows of each bucket; they come sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and rows:
                yield from flush(rows)
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield from flush(rows)


def _repeated_anchors(batches):
    """Of each lot the anchors that occur twice or more in the corpus; ``crowded`` ones are marked."""
    def flush(rows):
        got = [pickle.loads(payload) for _, _, payload in rows]
        lots = np.repeat(np.array([lot for _, lot, _ in rows]), [len(g[0]) for g in got])
        anchor, n, each = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(anchor, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = anchor[order[1:]] != anchor[order[:-1]]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(n[order].astype(np.int64), first)[group]
        crowd = np.add.reduceat(each[order].astype(np.int64), first)[group] > CROWD
        hit = total > 1
        order, crowd = order[hit], crowd[hit]
        parts = _by_bucket(lots[order])
        yield pa.RecordBatch.from_arrays([
            pa.array([int(lots[order[p[0]]]) for p in parts], pa.int64()),
            pa.array([pickle.dumps((anchor[order[p]], crowd[p])) for p in parts], pa.binary()),
        ], ["lot", "found"])
    yield from _grouped(batches, flush)


class Lot:
    """A lot with the places of its stretches."""

    def __init__(self, row, window):
        self.number = row["lot"]
        self.bounds, self.data = _read(row["bounds"], np.int64), _read(row["data"], np.uint8)
        self.anchor, self.count = np.frombuffer(row["anchor"], np.uint64), _read(row["count"], np.uint16).astype(np.int64)
        starts = window_starts(self.bounds, window)
        self.start = starts[np.cumsum(self.count) - self.count]


def _dealt(window, buckets):
    """Rows ``(bucket, kind, lot, payload)``: 0 stretches of text, 1 hashes of windows, 2 bytes known to be repeated."""
    def texts(lot, at):
        whole, start, count = lot.data.tobytes(), lot.start[at], lot.count[at]
        cut = [whole[a:b] for a, b in zip(start.tolist(), (start + count + window - 1).tolist(), strict=True)]
        first: dict[bytes, int] = {}
        of = np.fromiter((first.setdefault(s, k) for k, s in enumerate(cut)), np.int64, len(cut))
        times = np.bincount(of, minlength=len(cut))
        more = times[of] > 1
        if more.any():
            yield lot.number, 2, _pack(start[more], start[more] + count[more] + window - 1)
        go = np.flatnonzero(times)
        bucket = (lot.anchor[at[go]] % np.uint64(buckets)).astype(np.int64)
        for p in _by_bucket(bucket):
            k = go[p]
            yield int(bucket[p[0]]), 0, _pack(
                lot.anchor[at[k]], np.minimum(times[k], 2), start[k], count[k], b"".join([cut[x] for x in k.tolist()]))

    def hashes(lot, at):
        start, count = lot.start[at], lot.count[at]
        where = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        one, two = (Prefixes(lot.data, base).hash(where, window) for base in BASES)
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        more = np.sort(where[order[np.repeat(times, times) > 1]])
        if len(more):
            span = merged(more, more + window)
            yield lot.number, 2, _pack(span[:, 0], span[:, 1])
        go = order[first]
        bucket = (one[go] % np.uint64(buckets)).astype(np.int64)
        for p in _by_bucket(bucket):
            yield int(bucket[p[0]]), 1, _pack(one[go[p]], two[go[p]], np.minimum(times[p], 2), where[go[p]])

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                lot = Lot(row, window)
                found = [pickle.loads(x) for x in row["found"]]
                known, crowded = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(known)
                known, crowded = known[order], crowded[order]
                slot = np.minimum(np.searchsorted(known, lot.anchor), len(known) - 1)
                hit = known[slot] == lot.anchor
                out = []
                for form, which in ((texts, hit & ~crowded[slot]), (hashes, hit & crowded[slot])):
                    if which.any():
                        out += form(lot, np.flatnonzero(which))
                bucket, kind, payload = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()),
                    pa.array([row["lot"]] * len(out), pa.int64()), pa.array(payload, pa.binary()),
                ], ["bucket", "kind", "lot", "payload"])
    return run


def _names(a, b, c) -> np.ndarray:
    """Names of triples, from 1, in the order of the triples."""
    def packed(x, y):
        size = int(y.max()) + 1
        if int(x.max()) + 1 > (1 << 63) // size:
            x = np.unique(x, return_inverse=True)[1]
        return x * size + y

    pair = packed(a, b)
    if int(pair.max()) + 1 > (1 << 63) // (int(c.max()) + 1):
        pair = np.unique(pair, return_inverse=True)[1]
    return np.unique(packed(pair, c), return_inverse=True)[1] + 1


def suffix_order(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The places ``wanted`` (all by default) in the order of the suffixes there, as deep as ``depth`` symbols
    at least: suffixes that agree so far stand together. Symbols are at least 1; past the end is 0."""
    rank = _ranks(symbols, depth, wanted)
    wanted = np.arange(len(symbols)) if wanted is None else wanted
    return wanted[np.argsort(rank, kind="stable")]


def _ranks(symbols, depth, wanted=None):
    """Ranks of the suffixes; equal ranks agree in ``depth`` symbols, and ranks follow their order."""
    n = len(symbols)
    every = wanted is None
    wanted = np.arange(n) if every else wanted
    if depth <= 1 or n < 3:
        if n < 3:  # too short for a sample: whole suffixes as numbers
            s = np.concatenate([symbols, np.zeros(3, np.int64)])
            return _names(s[:n], s[1:n + 1], s[2:n + 2])[wanted] if n else s[:0]
        return symbols[wanted]
    s = np.concatenate([symbols, np.zeros(4, np.int64)])
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3)  # a place past the end closes each class
    sample = np.concatenate([one, two])
    name = _names(s[sample], s[sample + 1], s[sample + 2])
    if int(name.max()) < len(name):  # some triples are equal: sort the string of names
        name = _ranks(np.concatenate([name[:len(one)], [0], name[len(one):]]) + 1, -(-depth // 3))
        name = np.delete(name, len(one))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = np.unique(name, return_inverse=True)[1] + 1
    # Merge: class 0 against 1 by (symbol, rank after it), against 2 by (two symbols, rank after them).
    size, wide = int(rank.max()) + 1, int(s.max()) + 1
    near = lambda i: s[i] * size + rank[i + 1]
    if wide * wide > (1 << 62) // size:
        s = np.unique(s, return_inverse=True)[1]
        wide = int(s.max()) + 1
    if wide * wide > (1 << 62) // size:  # name pairs of symbols, so that key and rank fit a word
        pair = np.zeros(n + 4, np.int64)
        pair[:n + 3] = np.unique(s[:n + 3] * wide + s[1:n + 4], return_inverse=True)[1]
    else:
        pair = s[:n + 4] * wide + np.append(s[1:n + 4], 0)
    far = lambda i: pair[i] * size + rank[i + 2]
    part = [wanted[wanted % 3 == k] for k in range(3)]
    zero = part[0][np.argsort(near(part[0]), kind="stable")]
    rest = [p[np.argsort(rank[p], kind="stable")] for p in part[1:]]
    place = np.zeros(n, np.int64)
    for k, key in enumerate((near, far)):
        a, b = key(zero), key(rest[k])
        place[zero] += np.searchsorted(b, a, "left")
        place[rest[k]] += np.searchsorted(a, b, "left")
        own = rank[rest[k]]
        place[rest[k]] += np.searchsorted(own, own, "left")
        other = rest[1 - k]
        place[rest[k]] += np.searchsorted(rank[other], own, "left")
    own = near(zero)
    place[zero] += np.searchsorted(own, own, "left")
    return place[wanted]


def _repeats(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``starts`` begin a window whose bytes also start at another of them."""
    order = suffix_order(data.astype(np.int64) + 1, window, starts)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    a, b, same = order[:-1], order[1:], np.arange(len(order) - 1)
    for k in [*range(0, window - 7, 8), window - 8] if window >= 8 else []:
        keep = words[a[same] + k].view(np.uint64)[:, 0] == words[b[same] + k].view(np.uint64)[:, 0]
        same = same[keep]
    if window < 8:
        for k in range(window):
            same = same[data[a[same] + k] == data[b[same] + k]]
    hit = np.zeros(len(data), bool)
    hit[a[same]] = hit[b[same]] = True
    return hit[starts]


def _shared(rows, window):
    """Of the stretches in ``rows`` the bytes that are repeated: ``(lot, start, end)``."""
    got = [_unpack(payload) for _, _, _, payload in rows]
    lot = np.repeat(np.array([r[2] for r in rows]), [len(g[0]) for g in got])
    anchor, times, start, count = (np.concatenate(x).astype(t) for x, t in zip(
        list(zip(*got, strict=True))[:4], (np.uint64, np.int64, np.int64, np.int64), strict=True))
    whole, size = b"".join(g[4] for g in got), count + window - 1
    end = np.cumsum(size)
    cut = [whole[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
    first: dict[bytes, int] = {}
    of = np.fromiter((first.setdefault(s, k) for k, s in enumerate(cut)), np.int64, len(cut))
    total = np.bincount(of, weights=times, minlength=len(cut))
    lots, begins, ends = [lot[total[of] > 1]], [start[total[of] > 1]], [(start + size)[total[of] > 1]]
    # Different stretches of one anchor may share windows.
    only = np.fromiter(first.values(), np.int64, len(first))
    _, back, n = np.unique(anchor[only], return_inverse=True, return_counts=True)
    only = only[n[back] > 1]
    if len(only):
        data = np.frombuffer(b"".join([cut[k] for k in only.tolist()]), np.uint8)
        windows = count[only]
        base = np.cumsum(size[only]) - size[only]
        owner = np.repeat(only, windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = _repeats(data, np.repeat(base, windows) + inner, window)
        hit &= total[owner] == 1
        owner, inner = owner[hit], inner[hit]
        lots.append(lot[owner])
        begins.append(start[owner] + inner)
        ends.append(start[owner] + inner + window)
    return (np.concatenate(x) for x in (lots, begins, ends))


def _counted(rows, window):
    """The same for windows dealt by hash."""
    got = [_unpack(payload) for _, _, _, payload in rows]
    lot = np.repeat(np.array([r[2] for r in rows]), [len(g[0]) for g in got])
    one, two, times, where = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    total = np.add.reduceat(times[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[(total > 1) & (times[order] == 1)]
    return lot[hit], where[hit], where[hit] + window


def _sorted_buckets(window):
    """Repeated bytes of each lot: ``(lot, gone)``, pairs of first byte and byte after as bytes."""
    def emit(lot, a, b):
        if not len(lot):
            return
        order = np.lexsort((a, lot))
        lot, a, b = lot[order], a[order], b[order]
        at = np.flatnonzero(np.diff(lot, prepend=-1))
        to = np.append(at[1:], len(lot))
        yield pa.RecordBatch.from_arrays([
            pa.array(lot[at], pa.int64()),
            pa.array([merged(a[x:y], b[x:y]).tobytes() for x, y in zip(at.tolist(), to.tolist(), strict=True)], pa.binary()),
        ], ["lot", "gone"])

    def run(batches):
        wait, size, ways = [], 0, {0: _shared, 1: _counted}

        def flush(rows):
            yield from emit(*ways[rows[0][1]](rows, window))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "lot", "payload")), strict=True):
                if row[1] == 2:
                    a, b = _unpack(row[3])
                    yield from emit(np.full(len(a), row[2]), a, b)
                    continue
                if wait and (row[1] != wait[-1][1] or row[0] != wait[-1][0] and size > BATCH):
                    yield from flush(wait)
                    wait, size = [], 0
                wait.append(row)
                size += zstandard.frame_content_size(row[3])
        if wait:
            yield from flush(wait)
    return run


def _cleaned(batches):
    """One row per document of each lot."""
    for batch in batches:
        for k, row in enumerate(_rows(batch.drop_columns(["ids"]))):
            bounds, data = _read(row["bounds"], np.int64), _read(row["data"], np.uint8)
            gone = np.zeros((0, 2), np.int64)
            if row["gone"]:
                gone = np.concatenate([np.frombuffer(g, np.int64).reshape(-1, 2) for g in row["gone"]])
                gone = gone[np.argsort(gone[:, 0], kind="stable")]
                gone = merged(gone[:, 0], gone[:, 1])
            # A run may not reach over the end of its document.
            inner = np.unique(bounds[1:-1])
            split = inner[np.searchsorted(gone[:, 0], inner, "left") > np.searchsorted(gone[:, 1], inner, "right")]
            a, b = np.sort(np.append(gone[:, 0], split)), np.sort(np.append(gone[:, 1], split))
            whole, lost, spans, kept = data.tobytes(), [], [], []
            lo, hi = np.searchsorted(a, bounds[:-1], "left").tolist(), np.searchsorted(a, bounds[1:], "left").tolist()
            for start, end, x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo, hi, strict=True):
                cuts = [start, *np.stack([a[x:y], b[x:y]], 1).ravel().tolist(), end]
                kept.append(b"".join([whole[p:q] for p, q in zip(cuts[::2], cuts[1::2], strict=True)]))
                lost.append(int((b[x:y] - a[x:y]).sum()))
                spans.append(np.stack([a[x:y] - start, b[x:y] - start], 1).tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column("ids").slice(k, 1).flatten(), pa.array(np.diff(bounds)), pa.array(lost, pa.int64()),
                pa.array([len(x) for x in spans], pa.int64()), pa.array(kept, pa.binary()),
                pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            ], ["_ll_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def remove_repeats(
    docs: DataFrame, window: int = 200, gram: int | None = None, buckets: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left, which may
    cut a character) and ``removed``, the runs of bytes taken out as an array of first byte and byte after.

    A byte goes if a string of ``window`` bytes over it also starts anywhere else, in the same text or
    another; strings are judged on the input and lie within one text. Null text is empty. Rows are
    documents of their own even if id and text repeat, so repeated rows lose all strings; the id may be
    null and of any type. Texts shorter than a window stay. An empty table gives an empty result.
    Only the two named columns are read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, gram = buckets or 4 * parts, gram or max(1, window // 3)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_ll_id"), text(text_col).alias("_ll_text"))
    lots = materialize(rows.mapInArrow(
        _lots(window, gram),
        f"lot long, ids array<{kind}>, bounds binary, data binary, count binary, distinct binary, anchor binary",
    ), "lots")
    anchors = lots.select("lot", "anchor", "distinct").mapInArrow(_anchors(parts), "bucket long, lot long, payload binary")
    found = anchors.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _repeated_anchors, "lot long, found binary").groupBy("lot").agg(F.collect_list("found").alias("found"))
    dealt = lots.drop("ids", "distinct").join(found, "lot").mapInArrow(
        _dealt(window, buckets), "bucket long, kind int, lot long, payload binary")
    gone = dealt.repartition(parts, "bucket", "kind").sortWithinPartitions("kind", "bucket").mapInArrow(
        _sorted_buckets(window), "lot long, gone binary").groupBy("lot").agg(F.collect_list("gone").alias("gone"))
    out = lots.select("lot", "ids", "bounds", "data").join(gone, "lot", "left").drop("lot").mapInArrow(
        _cleaned, f"_ll_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, removed array<array<long>>")
    return out.withColumnRenamed("_ll_id", id_col)
