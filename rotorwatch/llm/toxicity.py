"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary documents each have a bigram model with absolute discounting whose lower
order counts distinct predecessors; both back off to a Kneser-Ney model of the classes
together. A bigram whose class counts stand apart from the shared rate has a probability of each class:
its discounted count, and the class's back-off weight times the word. Any other bigram has the shared
probability times what the class makes of its word, times the weight that the class leaves to such
bigrams in their context, so that every context's probabilities add up to one. A word that does not
stand apart has the shared rate, on its part with what the others leave. So expressions too rare to
tell the classes apart are smoothed by the shared counts in both models.

A document's ``log_ratio`` is the difference of its two log-likelihoods per word, in which the
shared probabilities cancel; a logistic curve fitted on documents that the counts did not use
maps it to 0..1.

Fitting takes at most ``most_rows`` labelled documents (a documented parameter), so the model
has a fixed size and may be broadcast: words are numbered by 20 bits of their hash, and at most
``most_pairs`` bigrams that stand apart are kept, the most frequent ones; others count as not apart.
Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text
from rotorwatch.llm.text import pieces, sums, words
from rotorwatch.session import materialize

WORD_BITS = 20
DISCOUNT = 0.75


class Ratios(NamedTuple):
    """Log-ratios of the toxic and the ordinary model."""

    word: np.ndarray      # by word, of its rate
    context: np.ndarray   # by word before, of the weight left to bigrams that do not stand apart
    pair: np.ndarray      # bigrams that stand apart, sorted
    of_pair: np.ndarray   # theirs


@dataclass(frozen=True)
class Model:
    ratios: Ratios
    scale: float
    slope: float
    shift: float


def labelled_sample(labels: DataFrame, label: str, usable: Column, most_rows: int, id_col: str) -> DataFrame:
    """At most ``most_rows`` labelled ids that may be learnt from: ``(_ll_id, _ll_y)``, chosen by
    hash. Ids labelled both ways count as 1; null ids and labels are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable)
    known = known.groupBy(F.col(id_col).alias("_ll_id")).agg(F.max(label).cast("int").alias("_ll_y"))
    known = known.withColumn("_ll_h", F.pmod(F.xxhash64("_ll_id"), F.lit(1 << 30)))
    n = known.count()
    if n > most_rows:
        near = known.where(F.col("_ll_h") < int((1 << 30) * 1.2 * most_rows / n))
        known = near.orderBy("_ll_h", "_ll_id").limit(most_rows)
    return materialize(known.drop("_ll_h"), "labelled")


def _bigrams(hashes, first):
    """Word and predecessor numbers; the first word of a document follows 0."""
    w = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    v = np.concatenate([[0], w[:-1]])[:len(w)]
    v[first[:-1][np.diff(first) > 0]] = 0
    return v, w


def _count(batches):
    for batch in batches:
        label = batch.column("_ll_y").to_numpy()
        for lo, hi, data, bounds in pieces(batch, "_ll_text"):
            found = words(data, bounds, fold=True)
            v, w = _bigrams(found.hash, found.first)
            y = np.repeat(label[lo:hi], np.diff(found.first))
            for c in (0, 1):
                pair, n = np.unique((v << WORD_BITS | w)[y == c], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(pair), pa.array(n * (c == 0)), pa.array(n * (c == 1))], ["pair", "n0", "n1"])


def _apart(toxic, expected, least_ratio, prior):
    ratio = (toxic + prior) / (expected + prior)
    return (ratio >= least_ratio) | (ratio <= 1 / least_ratio)


def _array(rows, key: str, name: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[rows.column(key).to_numpy()] = rows.column(name).to_numpy()
    return out


def _words(pairs: DataFrame, ratio: float, prior: float):
    """By word: its shared rate, and for each class what the class makes of that, as a factor; and the
    factor of words that do not stand apart."""
    size = 1 << WORD_BITS
    got = pairs.groupBy((F.col("pair") % size).alias("w")).agg(
        F.sum((F.col("n0") > 0).cast("long")).alias("c0"), F.sum((F.col("n1") > 0).cast("long")).alias("c1"),
        F.count("*").alias("c"),
    ).toArrow()
    c0, c1, c = (_array(got, "w", name, size) for name in ("c0", "c1", "c"))
    shared = (c + 0.5) / (c.sum() + 0.5 * size)
    total0, total1 = max(1, c0.sum()), max(1, c1.sum())
    apart = _apart(c1, (c0 + c1) * total1 / (total0 + total1), ratio, prior)
    factors, rest = [], []
    for count, total in ((c0, total0), (c1, total1)):
        backoff = max(DISCOUNT * (count > 0).sum() / total, 1e-9)
        own = np.maximum(count - DISCOUNT, 0) / total + backoff * shared
        left = max(1 - own[apart].sum(), 1e-9) / max(shared[~apart].sum(), 1e-9)
        factors.append(np.where(apart, own / shared, left))
        rest.append(left)
    return shared, factors, rest


def _ratio_tables(pairs: DataFrame, word_ratio, word_prior, pair_ratio, pair_prior, most_pairs) -> Ratios:
    size = 1 << WORD_BITS
    shared, factors, rest = _words(pairs, word_ratio, word_prior)
    before = F.shiftright("pair", WORD_BITS)
    both = F.col("n0") + F.col("n1")
    # Of the bigrams, only those of words that stand apart change what a context adds up to.
    held = pairs.sparkSession.sparkContext.broadcast([f - r for f, r in zip(factors, rest, strict=True)])

    def moved(batches):
        for batch in batches:
            pair, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
            m0, m1 = ((n - DISCOUNT) * f[pair % size] for f in held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m0), pa.array(m1)], ["pair", "n", "n0", "n1", "m0", "m1"])

    got = pairs.select("pair", both.alias("n"), "n0", "n1").mapInArrow(
        moved, "pair long, n long, n0 long, n1 long, m0 double, m1 double",
    ).groupBy(before.alias("v")).agg(
        *[F.sum(c).alias(f"t{c[1:]}") for c in ("n", "n0", "n1")],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"k{c[1:]}") for c in ("n", "n0", "n1")],
        F.sum("m0").alias("m0"), F.sum("m1").alias("m1"),
    ).toArrow()
    x = {c: _array(got, "v", c, size) for c in got.column_names if c != "v"}
    back = {c: np.where(x[f"t{c}"] > 0, DISCOUNT * x[f"k{c}"] / np.maximum(x[f"t{c}"], 1), 1.0) for c in ("", "0", "1")}

    t = pairs.agg(F.sum("n0"), F.sum("n1")).first()
    t0, t1 = float(t[0] or 1), float(t[1] or 1)
    ratio = (F.col("n1") + pair_prior) / (both * (t1 / (t0 + t1)) + pair_prior)
    strong = pairs.where((ratio >= pair_ratio) | (ratio <= 1 / pair_ratio))
    strong = strong.orderBy(F.desc(both), "pair").limit(most_pairs).toArrow().sort_by("pair")
    pair, n0, n1 = (strong.column(c).to_numpy() for c in ("pair", "n0", "n1"))
    v, w = pair >> WORD_BITS, pair % size

    def seen(n, c):
        return np.maximum(n - DISCOUNT, 0) / np.maximum(x[f"t{c}"][v], 1)

    together = seen(n0 + n1, "") + back[""][v] * shared[w]
    context, of_pair = [], []
    for c, n in (("0", n0), ("1", n1)):
        factor, left = factors[int(c)], rest[int(c)]
        own = seen(n, c) + back[c][v] * factor[w] * shared[w]
        every = left * (1 - back[""]) + x[f"m{c}"] / np.maximum(x["t"], 1) + back[""]
        taken, instead = (np.bincount(v, weights=p, minlength=size) for p in (own, together * factor[w]))
        context.append(np.log(np.maximum(1 - taken, 1e-9) / np.maximum(every - instead, 1e-9)))
        of_pair.append(np.log(own))
    word = np.log(factors[1]) - np.log(factors[0])
    return Ratios(word.astype(np.float32), (context[1] - context[0]).astype(np.float32), pair, of_pair[1] - of_pair[0])


def _ratios(batches, table, column):
    """Log-ratio per word of each text, by piece of a batch."""
    for batch in batches:
        out = []
        for _, _, data, bounds in pieces(batch, column):
            found = words(data, bounds, fold=True)
            v, w = _bigrams(found.hash, found.first)
            each = (table.word[w] + table.context[v]).astype(np.float64)
            if len(table.pair):
                pair = v << WORD_BITS | w
                at = np.minimum(np.searchsorted(table.pair, pair), len(table.pair) - 1)
                each = np.where(table.pair[at] == pair, table.of_pair[at], each)
            out.append(sums(each, found.first) / np.maximum(np.diff(found.first), 1))
        yield batch, np.concatenate(out) if out else np.zeros(0)


def _logistic(x, y, rounds=60, penalty=1e-3):
    """Slope and shift by Newton steps, halved until the loss falls; the slope is not negative."""
    def loss(a, b):
        z = a * x + b
        return (np.logaddexp(0, z) - y * z).sum() + penalty * a * a / 2

    a, b = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + penalty * a, (p - y).sum()])
        s = p * (1 - p)
        h = np.array([[(s * x * x).sum() + penalty, (s * x).sum()], [(s * x).sum(), s.sum() + penalty]])
        da, db = np.linalg.solve(h, g)
        rate, now = 1.0, loss(a, b)
        while rate > 1e-6 and loss(a - rate * da, b - rate * db) > now:
            rate /= 2
        if rate <= 1e-6:
            break
        a, b = a - rate * float(da), b - rate * float(db)
    return max(a, 0.0), b


def _stretched(ratio, scale):
    return np.sign(ratio) * np.log1p(np.abs(ratio) * scale)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most_rows: int = 20_000,
    word_ratio: float = 3.0, word_prior: float = 2.0, pair_ratio: float = 4.0, pair_prior: float = 10.0,
    most_pairs: int = 1 << 18, scale: float = 1000.0, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Model from labelled documents; ``usable`` is a condition on the columns of ``labels``.

    Of the ids drawn, every fourth by hash sets the curve and the rest are counted. With one
    class only, or none, every document gets the share of that class as its score.
    """
    sample = labelled_sample(labels, label, usable, most_rows, id_col)
    rows = docs.select(F.col(id_col).alias("_ll_id"), text(text_col).alias("_ll_text"))
    rows = rows.join(F.broadcast(sample), "_ll_id")
    rows = rows.withColumn("_ll_curve", F.pmod(F.xxhash64("_ll_id", F.lit("curve")), F.lit(4)) == 0)
    pairs = rows.where("not _ll_curve").select("_ll_text", "_ll_y").mapInArrow(_count, "pair long, n0 long, n1 long")
    pairs = materialize(pairs.groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "pairs")
    ratios = _ratio_tables(pairs, word_ratio, word_prior, pair_ratio, pair_prior, most_pairs)
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def curve(batches):
        for batch, r in _ratios(batches, held.value, "_ll_text"):
            yield pa.RecordBatch.from_arrays([pa.array(r), batch.column("_ll_y")], ["r", "y"])

    got = rows.where("_ll_curve").select("_ll_text", "_ll_y").mapInArrow(curve, "r double, y int").toArrow()
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max() or not np.any(ratios.word):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(ratios, scale, 0.0, float(np.log(share / (1 - share))))
    slope, shift = _logistic(_stretched(got.column("r").to_numpy(), scale), y)
    return Model(ratios, scale, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``log_ratio``, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Every row is scored on its whole text alone. Null text is empty and has log-ratio 0;
    repeated rows get equal scores; null ids and further columns pass through; an empty table
    gives an empty result. A column of one of these three names is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["log_ratio", "score", "predicted"]
    rows = docs.select(*[c for c in docs.columns if c not in names])

    def run(batches):
        m = held.value
        for batch, r in _ratios(batches, m.ratios, text_col):
            p = 1 / (1 + np.exp(-np.clip(m.slope * _stretched(r, m.scale) + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(r), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                [*batch.schema.names, *names])

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields),
              "log_ratio double", "score double", "predicted int"]
    return rows.mapInArrow(run, ", ".join(fields))
