"""Best-fit packing of documents into sequences of at most ``length`` tokens.

Bounded-space online best fit: every task keeps a fixed number of open bins, found through
a bitset keyed by free space. A piece goes to the open bin that it fills best; without one
that fits it opens a bin, and if that is one too many the fullest bin is closed. Pieces come
in lots (one Arrow batch), longest first within a lot; bins stay open across lots. A task
needs no other task's bins, so there is no shuffle, and a lost task is redone alone.

Where documents have an order to keep, a lot is a fixed number of consecutive positions, whole
in one task, and its bins close with it. Sequences are numbered by lot, and within a lot by the
first position that they hold, so the numbering follows the order, however tasks are cut.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text, tokenizer_file

# The vocabulary's pre-tokenisation pattern and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
CACHED_WORDS = 300_000


LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def _spaces_meet(s: str) -> bool:
    """Whether a space has white space beside it. Most texts hold few kinds, which is quick to find out."""
    return "  " in s or any(c in s and (c + " " in s or " " + c in s) for c in WHITE)


class _Words(dict):
    """Ids, as bytes, of a space and the piece that follows it."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece):
        ids = np.array(self.encode(" " + piece), "<u4").tobytes()
        if len(self) < CACHED_WORDS and len(piece) < 64:
            self[piece] = ids
        return ids


@lru_cache
def encoder(path: str):
    """Function from text to little-endian 32-bit ids, equal to the ``tokenizers`` library's.

    A space with no other white space beside it begins a piece of the tokenizer's own pattern, whatever
    the vocabulary holds, so texts are cut there and the ids of frequent pieces are looked up. Other white
    space stays within its piece. Texts with the special token are encoded whole."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    words = _Words(enc.encode_ordinary)

    def encode(s: str) -> bytes:
        if SPECIAL in s:
            return np.array(enc.encode(s, allowed_special={SPECIAL}), "<u4").tobytes()
        head, *rest = LONE_SPACE.split(s) if _spaces_meet(s) else s.split(" ")
        return np.array(enc.encode_ordinary(head), "<u4").tobytes() + b"".join(map(words.__getitem__, rest))

    return encode


class Bins:
    """Open bins by free space; ``bits`` has bit k set while a bin has k tokens free."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def place(self, n: int) -> tuple[int, int]:
        """Bin and offset for a piece of n tokens."""
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if n < self.length and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.length, self.made
            self.made += 1
        if free > n:
            self.by_free[free - n].append(bin_)
            self.bits |= 1 << (free - n)
            self.open += 1
        return bin_, self.length - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_


def pack(
    docs: DataFrame, length: int = 1024, open_bins: int = 16_384, end_id: int | None = 2,
    vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    order_col: str | None = None, lot_positions: int = 512,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned
    32-bit integers), ``sequence_id`` and ``offset``.

    A document's ids are followed by ``end_id``. Documents of more than ``length`` ids are cut
    into pieces of ``length``, of which the first may be shorter. Null text is empty: one
    piece with the end id alone. Repeated rows, and rows without an id, are packed as often as
    they occur. Without an end id, an empty document has no piece. An empty table gives an
    empty result. Only the named columns are read.

    ``order_col`` names whole numbers from 0 that ``sequence_id`` has to follow: documents share a
    sequence only if their numbers are in one lot of ``lot_positions``, and sequences come in the
    order of the lots. Rows of one lot are one task's, so numbers should not repeat much.
    """
    path = vocabulary or tokenizer_file("byte_bpe_50k.tiktoken")

    def pieces(batch, encode, end):
        """``(row, piece, start, size, ids)`` of each piece of a batch."""
        for row, s in enumerate(batch.column(1).to_pylist()):
            ids = encode(s) + end
            n, at, piece = len(ids) // 4, 0, 0
            to = n % length or min(n, length)
            while at < n:
                yield row, piece, at, to - at, ids[4 * at:4 * to]
                at, to, piece = to, to + length, piece + 1

    def packed(ids_of, rows, placed):
        row, piece, start, size, ids = zip(*rows) if rows else ((),) * 5
        for k in range(0, len(rows), 4096):
            cut = slice(k, k + 4096)
            yield pa.RecordBatch.from_arrays([
                ids_of.take(pa.array(row[cut], pa.int64())), pa.array(piece[cut], pa.int32()),
                pa.array(start[cut], pa.int64()), pa.array(size[cut], pa.int64()),
                pa.array(ids[cut], pa.binary()),
                pa.array([b for b, _ in placed[cut]], pa.int64()),
                pa.array([o for _, o in placed[cut]], pa.int64()),
            ], ["_ll_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    def setting():
        return encoder(path), b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, end = setting()
        bins, base = Bins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = sorted(pieces(batch, encode, end), key=lambda r: -r[3])
            yield from packed(batch.column(0), rows, [(base + b, o) for b, o in (bins.place(r[3]) for r in rows)])

    def in_order(batches):
        encode, end = setting()

        def close(lot, ids_of, rows):
            rows.sort(key=lambda r: -r[3])
            bins = Bins(length, open_bins)
            placed = [bins.place(r[3]) for r in rows]
            first = [len(rows)] * bins.made  # rows are numbered in the order to keep
            for r, (b, _) in zip(rows, placed, strict=True):
                first[b] = min(first[b], r[0])
            number = dict(zip(sorted(range(bins.made), key=lambda b: first[b]), range(bins.made), strict=True))
            yield from packed(pa.concat_arrays(ids_of), rows, [((lot << 32) + number[b], o) for b, o in placed])

        now, ids_of, rows, n = None, [], [], 0
        for batch in batches:
            lots = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(lots)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if now is not None and lots[lo] != now:
                    yield from close(now, ids_of, rows)
                    ids_of, rows, n = [], [], 0
                now, part = int(lots[lo]), batch.slice(lo, hi - lo)
                rows += [(n + r[0], *r[1:]) for r in pieces(part, encode, end)]
                ids_of.append(part.column(0))
                n += hi - lo
        if now is not None:
            yield from close(now, ids_of, rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_ll_id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    cols = [F.col(id_col).alias("_ll_id"), text(text_col).alias("_ll_text")]
    if order_col is None:
        out = docs.select(*cols).mapInArrow(run, schema)
    else:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lot = F.floor(F.col(order_col) / lot_positions).cast("long")
        rows = docs.select(*cols, lot.alias("_ll_lot"), F.col(order_col).alias("_ll_position"))
        # A lot is never cut by a range; rows of one position stand in the order of their ids and texts.
        rows = rows.repartitionByRange(parts, "_ll_lot").sortWithinPartitions("_ll_position", "_ll_id", F.xxhash64("_ll_text"))
        out = rows.mapInArrow(in_order, schema)
    return out.withColumnRenamed("_ll_id", id_col)
