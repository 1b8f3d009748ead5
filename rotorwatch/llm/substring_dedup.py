"""Repeated passages by super-k-mer partitioning.

A window is ``n`` consecutive words. Its minimiser is the smallest hash among its runs of a few
words; consecutive windows with one minimiser travel as one packed string (a super-k-mer) to
the minimiser's bucket. All occurrences of a window share its minimiser, so a bucket, sorted,
counts its windows exactly: equal hashes are compared word by word.

Copies are combined before the shuffle: of equal strings in a lot (some MB of texts), only
that of the smallest id travels, and the others are known to be repeated. A passage that very
many documents share thus reaches its bucket once a lot. Strings travel compressed, one row
per lot and bucket.

A task holds one bucket at a time, and of a bucket at most ``most_bytes`` of strings. The number of
buckets grows with the input; what one minimiser alone brings can't be dealt by it, so a bucket above that
size passes its windows on one by one, with id and place, and Spark groups them by their words.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorwatch.llm.rows import text
from rotorwatch.llm.text import pieces, window_hashes, words
from rotorwatch.operators.series import with_position
from rotorwatch.session import materialize

LAST = np.iinfo(np.int64).max
"""Stands for a null id: larger than any other, and never smaller than another null."""
FOUND = ["_ll_id", "_ll_check", "_ll_gone", "place", "window"]
BUCKET_BYTES = 1 << 26
"""Text per bucket, on average, from which on more buckets are made."""


def super_kmers(w, n: int, m: int):
    """First word, number of windows and minimiser of every super-k-mer."""
    grams = window_hashes(w.hash, m)
    span = n - m + 1
    if len(w.hash) < n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    low, width = grams, 1
    while width < span:  # sliding minimum by doubling
        step = min(width, span - width)
        low = np.minimum(low[:len(low) - step], low[step:])
        width += step
    starts = np.arange(len(low))
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[:len(low)]
    inside = starts + n <= w.first[1:][doc]
    starts, low, doc = starts[inside], low[inside], doc[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.ones(len(starts), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), low[at]


def _lots(n, m, buckets):
    """Rows ``(bucket, kind, payload)``: packed strings, or windows known to be repeated."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids = batch.column("_ll_id")
            number = np.where(ids.is_null().to_numpy(zero_copy_only=False), LAST, ids.fill_null(0).to_numpy())
            check = batch.column("_ll_check").to_numpy()
            for lo, _, data, bounds in pieces(batch, "_ll_text", 1 << 22):
                w = words(data, bounds)
                start, windows, low = super_kmers(w, n, m)
                if not len(start):
                    continue
                doc = np.searchsorted(w.first, start, "right") - 1
                whole = data.tobytes()
                end = w.end[start + windows + n - 2]
                texts = [b" ".join(whole[a:b].split()) for a, b in zip(w.start[start].tolist(), end.tolist(), strict=True)]
                best: dict[bytes, int] = {}
                row = number[lo + doc]
                order = np.argsort(row, kind="stable").tolist()
                for k in order:
                    best.setdefault(texts[k], k)
                first = np.fromiter(map(best.__getitem__, texts), np.int64, len(texts))
                travels = row == row[first]  # of the smallest id; a null id is equal to another
                again = np.flatnonzero(~travels)
                place = start - w.first[doc]
                bucket = (low % np.uint64(buckets)).astype(np.int64)
                out_b, out_k, out_p = [], [], []
                if len(again):
                    out_b.append(int(bucket[again[0]]))
                    out_k.append(1)
                    out_p.append(_pack(squeeze, row[again], check[lo + doc[again]], place[again], windows[again], None))
                go = np.flatnonzero(travels)
                go = go[np.argsort(bucket[go], kind="stable")]
                for part in np.split(go, np.flatnonzero(np.diff(bucket[go])) + 1) if len(go) else []:
                    out_b.append(int(bucket[part[0]]))
                    out_k.append(0)
                    out_p.append(_pack(squeeze, row[part], check[lo + doc[part]], place[part], windows[part],
                                       b"\n".join([texts[k] for k in part.tolist()])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_b, pa.int64()), pa.array(out_k, pa.int32()), pa.array(out_p, pa.binary())],
                    ["bucket", "kind", "payload"])
    return run


def _pack(squeeze, number, check, place, windows, strings):
    return squeeze.compress(pickle.dumps((number, check, place.astype(np.int64), windows.astype(np.int32), strings)))


def _repeated(number, place, windows, strings, n):
    """Of the windows in a bucket, those whose words also start in a document of a smaller id:
    ``(number of the string, first word)``."""
    tokens = b"\n".join(strings).split()
    code_of: dict[bytes, int] = {}
    code = np.fromiter((code_of.setdefault(t, len(code_of)) for t in tokens), np.int64, len(tokens))
    length = windows + n - 1
    begin = np.cumsum(length) - length
    own = np.repeat(np.arange(len(windows)), windows)
    at = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    where, ids = place[own] + at - begin[own], number[own]
    h = window_hashes(code.astype(np.uint64) + np.uint64(1), n)[at]
    order = np.lexsort((ids, h))
    hs = h[order]
    # Neighbours of equal hash are compared word by word; should words differ, sort by words.
    same = np.zeros(len(order), bool)
    same[1:] = hs[1:] == hs[:-1]
    pair = np.flatnonzero(same)
    equal = np.ones(len(pair), bool)
    for k in range(n):
        equal &= code[at[order[pair]] + k] == code[at[order[pair - 1]] + k]
    if not equal.all():
        order = np.lexsort((ids, *[code[at + k] for k in range(n)]))
        same = np.ones(len(order), bool)
        same[:1] = False
        for k in range(n):
            c = code[at[order] + k]
            same[1:] &= c[1:] == c[:-1]
    group = np.cumsum(~same) - 1
    least = ids[order][np.flatnonzero(~same)][group]
    hit = order[ids[order] > least]
    return own[hit], where[hit]


def _windows(got, n):
    """The windows of packed strings, each with its words: batches of the rows of ``_buckets``."""
    number, check, place, windows, strings = got
    rows = []
    for k, string in enumerate(strings.split(b"\n")):
        w = string.split(b" ")
        for j in range(int(windows[k])):
            rows.append((int(number[k]), int(check[k]), int(place[k]) + j, b" ".join(w[j:j + n])))
        if len(rows) >= 1 << 14:
            yield _window_batch(rows)
            rows = []
    if rows:
        yield _window_batch(rows)


def _window_batch(rows):
    number, check, place, window = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array(number, pa.int64()), pa.array(check, pa.int32()), pa.nulls(len(rows), pa.binary()),
        pa.array(place, pa.int64()), pa.array(window, pa.binary()),
    ], FOUND)


def _buckets(n, most_bytes):
    """Rows ``FOUND``: repeated stretches of each row, pairs of first word and first word after as
    bytes; of a bucket with more than ``most_bytes`` of strings, its windows instead."""
    def emit(number, check, a, b):
        order = np.lexsort((a, check, number))
        number, check, a, b = number[order], check[order], a[order], b[order]
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(check) != 0)) + 1
        at, to = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(number)]])
        yield pa.RecordBatch.from_arrays([
            pa.array(number[at]), pa.array(check[at]),
            pa.array([merged(a[x:y], b[x:y]).tobytes() for x, y in zip(at.tolist(), to.tolist(), strict=True)], pa.binary()),
            pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()),
        ], FOUND)

    def flush(parts):
        number, check, place, windows, strings = zip(*parts, strict=True)
        number, check, place = (np.concatenate(x) for x in (number, check, place))
        own, where = _repeated(number, place, np.concatenate(windows).astype(np.int64), strings, n)
        if len(own):
            yield from emit(number[own], check[own], where, where + n)

    def run(batches):
        expand = zstandard.ZstdDecompressor()
        now, parts, held = None, [], 0
        for batch in batches:
            for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = pickle.loads(expand.decompress(payload))
                if kind:
                    number, check, place, windows, _ = got
                    yield from emit(number, check, place, place + windows + n - 1)
                    continue
                if bucket != now:
                    if parts:
                        yield from flush(parts)
                    now, parts, held = bucket, [], 0
                held += len(got[4])
                parts.append(got)
                if held > most_bytes:  # from here on, this bucket holds nothing
                    for part in parts:
                        yield from _windows(part, n)
                    parts = []
        if parts:
            yield from flush(parts)
    return run


def merged(a, b):
    """Stretches sorted by their first word, joined where they touch or overlap."""
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([a[at], reach[np.append(at[1:], len(a)) - 1]], 1).astype(np.int64)


def _repeated_windows(windows: DataFrame, n: int) -> DataFrame:
    """Stretches from windows that travelled one by one: those whose words also start in a smaller id."""
    least = windows.groupBy("window").agg(F.min("_ll_id").alias("_least"), F.max("_ll_id").alias("_most"))
    least = least.where("_most > _least").drop("_most")
    hit = windows.join(least, "window").where("_ll_id > _least").select("_ll_id", "_ll_check", "place")

    def run(batches):
        for batch in batches:
            at = batch.column("place").to_numpy()
            pairs = np.stack([at, at + n], 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_ll_id"), batch.column("_ll_check"), pa.array([x.tobytes() for x in pairs], pa.binary())], FOUND[:3])

    return hit.mapInArrow(run, "_ll_id long, _ll_check int, _ll_gone binary")


def _numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with ``_ll_number``, a whole number in the order of the ids, null for a null id."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return docs.withColumn("_ll_number", F.col(id_col).cast("long"))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_ll_known")).distinct()
    places = with_position(known, [], ["_ll_known"], "_ll_number")
    return docs.join(places, docs[id_col] == places["_ll_known"], "left").drop("_ll_known")


def remove_repeats(
    docs: DataFrame, window: int = 13, minimiser_words: int = 3, buckets: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 28,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one
    space) and ``removed``, the stretches of word numbers as an array.

    A word goes if a window over it also starts in a document of a smaller id; windows are
    judged on the input. Null text is empty. A null id is larger than all others, and none of
    two nulls is the smaller. Ids keep their type; others than whole numbers, such as texts, are numbered
    in their order first. Rows that share an id are told apart by 31 bits of a hash of their
    text; two of those whose hashes collide would lose each other's words. Repeated rows are equal in id, so
    neither removes from the other, and both lose the same words. Texts shorter than a window stay. An empty
    table gives an empty result. Only the two named columns are read. ``buckets`` and ``most_bytes`` decide how
    work is split and change no result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(text(text_col)))).first()[0] or 0
        buckets = max(8 * parts, size // BUCKET_BYTES)
    # Rows that share an id are told apart by a hash; where none do, the id is enough.
    alone = docs.groupBy(id_col).count().where("count > 1").isEmpty()
    check = F.lit(0) if alone else F.pmod(F.xxhash64(text(text_col)), F.lit(1 << 31)).cast("int")
    rows = _numbered(docs.select(id_col, text_col), id_col).select(
        F.col(id_col).alias("_ll_own"), F.col("_ll_number").alias("_ll_id"), check.alias("_ll_check"),
        text(text_col).alias("_ll_text"),
    )
    lots = rows.drop("_ll_own").mapInArrow(_lots(window, minimiser_words, buckets), "bucket long, kind int, payload binary")
    dealt = lots.repartition(parts, "bucket").sortWithinPartitions("kind", "bucket")
    found = materialize(dealt.mapInArrow(
        _buckets(window, most_bytes), "_ll_id long, _ll_check int, _ll_gone binary, place long, window binary"), "stretches")
    single = _repeated_windows(found.where("window is not null").drop("_ll_gone"), window)
    gone = found.where("window is null").select(*FOUND[:3]).union(single)
    gone = gone.withColumn("_ll_id", F.nullif("_ll_id", F.lit(int(LAST))))
    gone = gone.groupBy("_ll_id", "_ll_check").agg(F.collect_list("_ll_gone").alias("_ll_gone"))
    gone = gone.withColumnsRenamed({"_ll_id": "_ll_id_g", "_ll_check": "_ll_check_g"})
    on = [rows[c].eqNullSafe(gone[f"{c}_g"]) for c in ("_ll_id", "_ll_check")]
    both = rows.join(gone, on, "left").select("_ll_own", "_ll_text", "_ll_gone")

    def run(batches):
        for batch in batches:
            out = []
            for s, gone in zip(batch.column("_ll_text").to_pylist(), batch.column("_ll_gone").to_pylist(), strict=True):
                w = s.encode().split()
                n, cut = len(w), np.zeros((0, 2), np.int64)
                if gone:
                    all_ = np.concatenate([np.frombuffer(g, np.int64).reshape(-1, 2) for g in gone])
                    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
                    cut = merged(all_[:, 0], all_[:, 1])
                    for a, b in cut[::-1].tolist():
                        del w[a:b]
                out.append((n, n - len(w), b" ".join(w).decode(), cut.tolist()))
            n, gone, kept, cut = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([
                batch.column("_ll_own"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                pa.array(cut, pa.list_(pa.list_(pa.int64()))),
            ], ["_ll_own", "n_words", "n_removed", "kept_text", "removed"])

    own = docs.schema[id_col].dataType.simpleString()
    schema = f"_ll_own {own}, n_words long, n_removed long, kept_text string, removed array<array<long>>"
    return both.mapInArrow(run, schema).withColumnRenamed("_ll_own", id_col)
