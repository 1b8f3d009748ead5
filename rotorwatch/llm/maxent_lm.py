"""Language-model scores from a hashed maximum-entropy model.

The next word is predicted in two steps, its class and then the word within the class, each a
softmax over 64 outcomes. Features are the previous word, the word before it (a skip
feature) and both together, hashed into fixed tables of weights. Weights start from
feature counts over all training documents and are then improved by rounds of distributed
gradients: each task adds up the gradient of its documents, Spark sums the tasks' in a tree of
fixed fan-in, and the driver takes the step. Rounds take disjoint shares of the documents, one
round for each share, so every training document gives gradients and the work grows with the corpus.
Words outside the ``CLASSES * WITHIN - 1`` most frequent are one outcome, shared out by their
counts, so probabilities of texts add up to one.

Counts of all words are exact. Only the most frequent are broadcast (a fixed number); the
others are joined by word. Once the words are counted each text is cut into tokens once more and
written as ranks, which training and scoring read. Tokens of one context share its outcome
probabilities, so these are worked out once for every different context of some million tokens.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text
from rotorwatch.llm.text import mix
from rotorwatch.session import materialize

CLASSES, WITHIN = 64, 64
SYMBOLS = CLASSES * WITHIN
RARE, BEFORE = SYMBOLS - 1, SYMBOLS
END = b"\n"
"""The end of a document as a token; no word has white space."""
CLASS_ROWS, WORD_ROWS, BLOCK_ROWS = 1 << 14, 1 << 16, 1 << 8
OWN_ROWS = WORD_ROWS // CLASSES
KINDS = 3
LOT = 1 << 20  # tokens worked on at once
STEP = 1 << 12  # contexts worked on at once
TOGETHER = 4  # splits that one task adds up to a gradient
FAN_IN = 32  # tables that one task adds up


@dataclass(frozen=True)
class Model:
    index: dict             # bytes of a frequent word -> rank
    log_count: np.ndarray   # log10(count + 1) by rank
    total: int              # training tokens
    distinct: int
    rare_log: float         # log10 of the rare words' tokens, types and one unknown
    class_bias: np.ndarray
    word_bias: np.ndarray   # class, place in class
    class_w: np.ndarray     # CLASS_ROWS x CLASSES
    word_w: np.ndarray      # WORD_ROWS x WITHIN


def _tokens(column) -> Iterator[list[bytes]]:
    """Words of each text, A-Z in lower case, with the end."""
    texts = column.cast(pa.binary())
    for lo in range(0, len(texts), 256):
        for s in texts.slice(lo, 256).to_pylist():
            yield [*s.lower().split(), END]
    pa.default_memory_pool().release_unused()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over the column ``_ll_text``, ends included."""
    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            for t in _tokens(batch.column("_ll_text")):
                count.update(t)
            words, n = zip(*count.items(), strict=True) if count else ((), ())
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[k:k + 50_000], pa.binary()), pa.array(n[k:k + 50_000], pa.int64())], ["word", "n"])

    return texts.select("_ll_text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ranked(held):
    """Ranks of the tokens of each text as packed 32-bit integers (-1: not frequent), and the words
    that are not frequent."""
    def run(batches):
        index, squeeze = held.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            lo = 0
            for part in _some(_tokens(batch.column("_ll_text")), len, 1 << 18):
                packed, words, times, ends = [], [], [], [0]
                for t in part:
                    rank = np.fromiter(map(index.get, t, repeat(-1)), np.int32, len(t))
                    packed.append(squeeze.compress(rank.tobytes()))
                    rare = Counter(compress(t, (rank < 0).tolist()))
                    words += rare.keys()
                    times += rare.values()
                    ends.append(len(words))
                rest = batch.slice(lo, len(part))
                lo += len(part)
                flat = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "times"])
                yield pa.RecordBatch.from_arrays([
                    *[rest.column(c) for c in ("_ll_id", "_ll_use")], pa.array(packed, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                ], ["_ll_id", "_ll_use", "_ll_ranks", "_ll_rare"])
    return run


def _some(items, size, most):
    """Lists of items that together have at least ``most`` in size, and the rest."""
    out, total = [], 0
    for x in items:
        out.append(x)
        total += size(x)
        if total >= most:
            yield out
            out, total = [], 0
    if out:
        yield out


def _lots(batch):
    """Some documents at a time: the ranks of their tokens, and where each document begins."""
    expand = zstandard.ZstdDecompressor()
    column = batch.column("_ll_ranks")
    docs = (np.frombuffer(expand.decompress(column[k].as_py()), np.int32) for k in range(len(column)))
    for part in _some(docs, len, LOT):
        yield np.concatenate(part), np.cumsum([0, *map(len, part)])


class Contexts:
    """Symbols of tokens and the different contexts in which they stand."""

    def __init__(self, rank, first):
        self.sym = np.where((rank < 0) | (rank >= RARE), RARE, rank).astype(np.int64)
        one = np.concatenate([[BEFORE], self.sym[:-1]])
        two = np.concatenate([[BEFORE] * 2, self.sym[:-2]])[:len(self.sym)]
        one[first[:-1]] = BEFORE
        two[first[:-1]] = BEFORE
        after = first[:-1] + 1
        two[after[after < first[1:]]] = BEFORE
        self.group, self.place = self.sym // WITHIN, self.sym % WITHIN
        context, self.of = np.unique(one + (two << 13), return_inverse=True)
        self.times = np.bincount(self.of)
        self.keys = _features(context & 8191, context >> 13)
        # The word in its class depends on the class as well.
        inner, self.inner_of = np.unique(self.of * CLASSES + self.group, return_inverse=True)
        self.inner_times = np.bincount(self.inner_of)
        self.inner_group, self.inner_keys = inner % CLASSES, [k[inner // CLASSES] for k in self.keys]

    def levels(self, model):
        """Of both steps: weights, biases and which of them each context has, rows by context, context and
        outcome of each token, and how often each context occurs."""
        none = np.zeros(len(self.times), np.int64)
        yield (model.class_w, (model.class_bias[None, :], none), _class_rows(self.keys),
               self.of, self.group, self.times)
        yield (model.word_w, (model.word_bias, self.inner_group), _word_rows(self.inner_keys, self.inner_group),
               self.inner_of, self.place, self.inner_times)


def _features(one, two):
    """Hashed features: the word before, the one before that, and both."""
    bits = np.uint64(0x9E3779B97F4A7C15)
    return [mix(k.astype(np.uint64) * bits) for k in (one, two + (1 << 20), one + (two << 13) + (1 << 40))]


def _class_rows(keys):
    return [(k % np.uint64(CLASS_ROWS)).astype(np.int64) for k in keys]


def _word_rows(keys, group):
    """Each class has rows of its own."""
    return [group * OWN_ROWS + (k >> np.uint64(44)).astype(np.int64) % OWN_ROWS for k in keys]


def _outcomes(weights, bias, rows):
    """Some contexts at a time: their range, exponentials of all outcomes, the sums, and the logarithms
    of the sums."""
    table, which = bias
    for lo in range(0, len(which), STEP):
        z = table[which[lo:lo + STEP]]
        for r in rows:
            z += np.take(weights, r[lo:lo + STEP], axis=0)
        top = z.max(1)
        z -= top[:, None]
        np.exp(z, out=z)
        total = z.sum(1)
        yield slice(lo, lo + STEP), z, total, top + np.log(total)


def _blocks(tables):
    squeeze = zstandard.ZstdCompressor(level=1)
    for name, table in enumerate(tables):
        for b in range(0, len(table), BLOCK_ROWS):
            part = table[b:b + BLOCK_ROWS]
            if part.any():
                yield name * (1 << 20) + b // BLOCK_ROWS, squeeze.compress(part.astype(np.float32).tobytes())


def _added(parts: DataFrame) -> list[np.ndarray]:
    """Tables of all tasks summed, ``FAN_IN`` at a time; their size is fixed by the model."""
    def add(key, table):
        expand, total = zstandard.ZstdDecompressor(), 0.0
        for x in table.column("part"):
            total = total + np.frombuffer(expand.decompress(x.as_py()), np.float32).astype(np.float64)
        packed = zstandard.ZstdCompressor(level=1).compress(total.astype(np.float32).tobytes())
        return pa.table({"block": [key[0].as_py()], "task": pa.array([key[1].as_py()], pa.int32()), "part": [packed]})

    tasks = parts.rdd.getNumPartitions()
    parts = parts.withColumn("task", F.spark_partition_id())
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        parts = parts.groupBy("block", "task").applyInArrow(add, "block long, task int, part binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    got = parts.toArrow()
    out = [np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, WITHIN), np.float32)]
    for block, part in zip(got.column("block").to_pylist(), got.column("part").to_pylist(), strict=True):
        table, b = out[block >> 20], (block & ((1 << 20) - 1)) * BLOCK_ROWS
        plain = zstandard.ZstdDecompressor().decompress(part)
        table[b:b + BLOCK_ROWS] = np.frombuffer(plain, np.float32).reshape(BLOCK_ROWS, -1)
    return out


_PARTS = "block long, part binary"


def _as_batch(blocks):
    b, p = zip(*blocks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(p, pa.binary())], ["block", "part"])


def _counted(table, level):
    """Add how often each (feature, outcome) occurs."""
    weights, _, rows, of, outcome, _ = level
    width = weights.shape[1]
    pair, times = np.unique(of * width + outcome, return_counts=True)
    for r in rows:
        np.add.at(table, r[pair // width] * width + pair % width, times.astype(np.float64))


def _observed(held):
    """Counts of (feature, outcome) over a task's documents."""
    def run(batches):
        m = held.value
        tables = [np.zeros(CLASS_ROWS * CLASSES), np.zeros(WORD_ROWS * WITHIN)]
        for batch in batches:
            for lot in _lots(batch):
                for table, level in zip(tables, Contexts(*lot).levels(m), strict=True):
                    _counted(table, level)
        blocks = list(_blocks([t.reshape(-1, WITHIN) for t in tables]))
        if blocks:
            yield _as_batch(blocks)
    return run


def _gradient(held):
    """Observed less expected counts over a task's documents."""
    def run(batches):
        m = held.value
        grads = [np.zeros((CLASS_ROWS, CLASSES)), np.zeros((WORD_ROWS, WITHIN))]
        for batch in batches:
            for lot in _lots(batch):
                for grad, level in zip(grads, Contexts(*lot).levels(m), strict=True):
                    _counted(grad.reshape(-1), level)
                    weights, bias, rows, _, _, times = level
                    for some, e, total, _ in _outcomes(weights, bias, rows):
                        e *= (times[some] / total).astype(np.float32)[:, None]
                        for r in rows:
                            order = np.argsort(r[some], kind="stable")
                            s = r[some][order]
                            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                            grad[s[at]] -= np.add.reduceat(e[order], at, axis=0)
        blocks = list(_blocks(grads))
        if blocks:
            yield _as_batch(blocks)
    return run


def _log_share(n, prior):
    with np.errstate(divide="ignore"):
        return np.where(n > 0, np.log(np.maximum(n, 1e-9)) - prior, -1e9).astype(np.float32)


def _start(observed, bias, weight, prior):
    """Weights from counts: a part of the log-ratio of an outcome's rate given the feature to its
    rate at large."""
    p = np.exp(bias - bias.max(-1, keepdims=True))
    p = p / p.sum(-1, keepdims=True)
    p = np.maximum(p, 1e-7)
    total = observed.sum(1, keepdims=True)
    return (weight * np.log((observed + prior * p) / ((total + prior) * p))).astype(np.float32)


def _vocabulary(counts: DataFrame, known: int) -> Model:
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    top = counts.orderBy(F.desc("n"), "word").limit(known).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.float64)
    rare = (total - n[:RARE].sum(), distinct - len(n[:RARE]))
    by_symbol = np.zeros(SYMBOLS)
    by_symbol[:len(n[:RARE])] = n[:RARE]
    by_symbol[RARE] = rare[0] + 1
    grouped = by_symbol.reshape(CLASSES, WITHIN)
    return Model(
        {w: k for k, w in enumerate(words)}, np.log10(n + 1), total, distinct, float(np.log10(sum(rare) + 1)),
        _log_share(grouped.sum(1), 0), _log_share(grouped, 0), np.zeros((CLASS_ROWS, CLASSES), np.float32),
        np.zeros((WORD_ROWS, WITHIN), np.float32),
    )


def fit(
    docs: DataFrame, usable: Column, rounds: int = 2, share: int = 2, rate: float = 1 / KINDS, prior: float = 20.0,
    weight: float = 0.4, known: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[Model, DataFrame, DataFrame]:
    """The model learnt from the rows of ``docs`` that are ``usable``, the counts ``(word, n)`` of all
    their tokens, and the tokens of all rows as ranks, for ``score``. Round r takes the gradient of part r
    modulo ``share`` of the documents; ``rounds`` is a multiple of ``share``, so that all of them are used
    equally often."""
    if share < 1 or rounds % share:
        raise ValueError("rounds is a multiple of share")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("_ll_id"), text(text_col).alias("_ll_text"), usable.alias("_ll_use"))
    counts = materialize(word_counts(rows.where("_ll_use")), "words")
    model = _vocabulary(counts, known)
    kind = rows.schema["_ll_id"].dataType.simpleString()
    ranks = materialize(rows.mapInArrow(
        _ranked(sc.broadcast(model.index)),
        f"_ll_id {kind}, _ll_use boolean, _ll_ranks binary, _ll_rare array<struct<word:binary,times:long>>",
    ).withColumn("_ll_row", F.monotonically_increasing_id()), "ranks")  # written once: row numbers stay
    model = replace(model, index={})
    train = ranks.where("_ll_use").select("_ll_id", "_ll_ranks")
    seen = _added(train.select("_ll_ranks").mapInArrow(_observed(sc.broadcast(model)), _PARTS))
    model = replace(
        model, class_w=_start(seen[0], model.class_bias, weight, prior),
        word_w=_start(seen[1], np.repeat(model.word_bias, OWN_ROWS, axis=0), weight, prior),
    )
    for k in range(rounds):
        part = train.where(F.pmod(F.xxhash64("_ll_id", F.lit("part")), F.lit(share)) == k % share).select("_ll_ranks")
        # A task returns a gradient of full size, so few tasks take several splits each.
        part = part.coalesce(max(1, -(-part.rdd.getNumPartitions() // TOGETHER)))
        grads = _added(part.mapInArrow(_gradient(sc.broadcast(model)), _PARTS))
        stepped = []
        for w, g, o in zip((model.class_w, model.word_w), grads, seen, strict=True):
            expected = np.maximum(o / share - g, 0)
            stepped.append(w + np.clip(rate * g / (expected + prior / share + 1), -1, 1).astype(np.float32))
        model = replace(model, class_w=stepped[0], word_w=stepped[1])
    return model, counts, ranks


def _scored(held):
    def run(batches):
        m = held.value
        log10 = np.log(10.0)
        for batch in batches:
            lo = 0
            for rank, first in _lots(batch):
                context, each = Contexts(rank, first), np.zeros(len(rank))
                for weights, bias, rows, of, outcome, _ in context.levels(m):
                    table, which = bias
                    norm = np.empty(len(which))
                    for some, _, _, log_sum in _outcomes(weights, bias, rows):
                        norm[some] = log_sum
                    each += table[which[of], outcome] - norm[of]
                    for r in rows:
                        each += weights[r[of], outcome]
                each /= log10
                count = np.where(rank >= 0, m.log_count[np.maximum(rank, 0)] if len(m.log_count) else 0.0, 0.0)
                each += np.where(context.sym == RARE, count - m.rare_log, 0)
                part = batch.slice(lo, len(first) - 1)
                lo += part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column("_ll_row"), part.column("_ll_id"), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(_total(rank >= 0, first).astype(np.int64)),
                    pa.array(_total(count, first)), pa.array(_total(each, first)),
                ], ["_ll_row", "_ll_id", "_ll_n_tokens", "_ll_known", "_ll_counts", "_ll_model"])
    return run


def _total(values, first):
    return np.add.reduceat(values.astype(np.float64), first[:-1])


def score(ranks: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of the documents given to ``fit``, which hands on ``ranks``: id, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-one unigram) and ``score`` (this model), both log10 probabilities
    of the whole text.

    Null text is empty: its one token is the end. Repeated rows get equal scores, null ids are
    scored like others and used in training if the caller's condition holds for them. An empty
    table gives an empty result; without training documents both scores are 0. Only the id, the text
    and what the condition names are read.
    """
    held = ranks.sparkSession.sparkContext.broadcast(model)
    kind = ranks.schema["_ll_id"].dataType.simpleString()
    schema = f"_ll_row long, _ll_id {kind}, _ll_n_tokens long, _ll_known long, _ll_counts double, _ll_model double"
    part = ranks.select("_ll_row", "_ll_id", "_ll_ranks").mapInArrow(_scored(held), schema)
    rare = ranks.select("_ll_row", F.explode("_ll_rare").alias("r")).select("_ll_row", "r.word", "r.times")
    found = rare.join(counts, "word").groupBy("_ll_row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    each = float(np.log10(model.total + model.distinct + 1))
    return part.join(found, "_ll_row", "left").select(
        F.col("_ll_id").alias(id_col), F.col("_ll_n_tokens").alias("n_tokens"),
        (F.col("_ll_known") + more).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_ll_counts") + logs - F.col("_ll_n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("_ll_model") + logs).alias("score"),
    )
