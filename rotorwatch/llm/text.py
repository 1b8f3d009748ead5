"""Words of documents as numpy arrays: places and 64-bit hashes, without a loop per word.

A word is a run of bytes that are not ASCII white space; with ``fold=True`` it is a run
of ASCII letters, digits and bytes of multi-byte characters, hashed in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word in the buffer
    end: np.ndarray    # byte after its last
    hash: np.ndarray   # uint64
    first: np.ndarray  # of each document, index of its first word; one entry more than documents


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache
def _tables(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    value = np.arange(256, dtype=np.uint64) + np.uint64(1)
    if not fold:
        inside = np.ones(256, bool)
        inside[list(SPACE)] = False
        return inside, value
    upper = np.arange(ord("A"), ord("Z") + 1)
    inside = np.zeros(256, bool)
    for part in (upper, upper + 32, np.arange(ord("0"), ord("9") + 1), np.arange(128, 256)):
        inside[part] = True
    value[upper] = value[upper + 32]
    return inside, value


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _block(data, cut, fold):
    """Words of one block; ``cut`` marks bytes at which a document begins."""
    inside, value = _tables(fold)
    n = len(data)
    word = inside[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:]
    ends[:-1] &= ~word[1:] | cut[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(1 << max(20, int(n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * inverse[:n], out=total[1:])
    h = (total[end] - total[start]) * power[start]
    return start, end, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> Words:
    """Words of the documents ``data[bounds[i]:bounds[i+1]]`` (uint8)."""
    inside, _ = _tables(fold)
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data):  # end the block between words
            stop = np.flatnonzero(~inside[data[to:to + BLOCK]] | cut[to:min(len(data), to + BLOCK)])
            if len(stop):
                to += int(stop[0])
                break
            to = min(len(data), to + BLOCK)
        s, e, h = _block(data[at:to], cut[at:to], fold)
        parts.append((s + at, e + at, h))
        at = to
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(start, end, h, np.searchsorted(start, bounds))


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = a.buffers()
    bounds = np.frombuffer(offsets, np.int64)[a.offset:a.offset + len(a) + 1]
    if data is None or not len(a):
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = 2 * BLOCK) -> Iterator[tuple]:
    """Row ranges of at most ``most`` bytes of text, or one row: ``(lo, hi, data, bounds)``."""
    data, bounds = texts_of(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield lo, hi, data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo]
        lo = hi


def owner(first: np.ndarray) -> np.ndarray:
    """Document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, over the whole buffer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out + h[k:len(h) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
