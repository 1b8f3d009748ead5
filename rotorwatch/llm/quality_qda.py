"""Quality by regularised quadratic discriminant analysis of document statistics.

Each document is reduced to a few transformed statistics in one pass. Per class, mean and
covariance of the labelled documents come from one aggregation; covariances are shrunk
towards the pooled one and its diagonal. The score compares the classes' Mahalanobis
log-densities, with Cholesky factors inverted once on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.llm.rows import text
from rotorwatch.llm.text import owner, pieces, sums, words

FEATURES = ("size", "distinct", "word_length", "symbols", "capitals", "digits", "stops", "doubles", "shouts", "lines")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray      # class, feature
    factor: np.ndarray    # class: inverse Cholesky factor of the covariance
    offset: np.ndarray    # class: log prior less half the log-determinant
    prior: float


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_SYMBOLS, _CAPITALS = _table(b"#*$%&|<>{}~^=+\\@"), _table(bytes(range(65, 91)))
_DIGITS, _STOPS, _SHOUTS = _table(b"0123456789"), _table(b".,;:"), _table(b"!?")
_LINES = _table(b"\n")


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Transformed statistics of each document, one row each; zeros for one without words."""
    w = words(data, bounds)
    n = np.diff(w.first)
    count = np.maximum(n, 1)
    doc = owner(w.first)
    mixed = np.sort((doc.astype(np.uint64) << np.uint64(42)) | (w.hash >> np.uint64(22)))
    new = np.ones(len(mixed), np.int64)
    new[1:] = mixed[1:] != mixed[:-1]
    distinct = np.bincount((mixed >> np.uint64(42)).astype(np.int64), weights=new, minlength=len(n))
    same = np.zeros(len(doc))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    chars = np.maximum(sums((w.end - w.start).astype(np.float64), w.first), 1)

    def share(table):
        return sums(table[data], bounds) / chars

    out = np.stack([
        np.log1p(n), distinct / count ** 0.9, np.log(np.maximum(chars / count, 1)),
        np.sqrt(share(_SYMBOLS)), np.sqrt(share(_CAPITALS)), np.sqrt(share(_DIGITS)), np.sqrt(share(_STOPS)),
        np.sqrt(sums(same, w.first) / count), np.sqrt(share(_SHOUTS)), np.sqrt(share(_LINES)),
    ], axis=1)
    out[n == 0] = 0
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``_ll_f``, the array of statistics."""
    rows = docs.select(*[c for c in docs.columns if c != text_col], text(text_col).alias("_ll_text"))

    def run(batches):
        for batch in batches:
            f = [statistics(data, bounds) for _, _, data, bounds in pieces(batch, "_ll_text")]
            flat = pa.array(np.concatenate(f).ravel() if f else np.zeros(0))
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(at, flat)], [*batch.schema.names[:-1], "_ll_f"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "_ll_f array<double>"]))


def fit(stats: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
        shrink: float = 0.1, id_col: str = "doc_id") -> Model:
    """Model from all labelled documents in ``stats`` (of ``features``); ``usable`` is a condition on
    the columns of ``labels``. Only two rows of moments reach the driver. A class without
    documents takes the other's place with weight zero; without any label all score 0.5.
    """
    k = len(FEATURES)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & usable)
    known = known.groupBy(F.col(id_col).alias("_ll_id")).agg(F.max(label).cast("int").alias("_ll_y"))
    rows = stats.select(F.col(id_col).alias("_ll_id"), "_ll_f").join(known, "_ll_id").select(
        "_ll_y", *[F.get("_ll_f", i).alias(f"f{i}") for i in range(k)])
    pairs = list(combinations_with_replacement(range(k), 2))
    got = {r["_ll_y"]: r for r in rows.where("_ll_y in (0, 1)").groupBy("_ll_y").agg(
        F.count("*").alias("n"), *[F.avg(f"f{i}").alias(f"m{i}") for i in range(k)],
        *[F.covar_pop(f"f{i}", f"f{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).collect()}
    n = np.array([got[c]["n"] if c in got else 0 for c in (0, 1)], float)
    mean, cov = np.zeros((2, k)), np.stack([np.eye(k)] * 2)
    for c, r in got.items():
        mean[c] = [r[f"m{i}"] for i in range(k)]
        for i, j in pairs:
            cov[c, i, j] = cov[c, j, i] = r[f"c{i}_{j}"]
    if n.min() == 0:
        mean[int(n.argmin())], cov[int(n.argmin())] = mean[int(n.argmax())], cov[int(n.argmax())]
    pooled = (np.maximum(n, 1)[:, None, None] * cov).sum(0) / np.maximum(n, 1).sum()
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(k)
    factor, offset = [], []
    for c in (0, 1):
        own = min(1.0, shrink + k / (n[c] + k))
        low = np.linalg.cholesky((1 - own) * cov[c] + own * target)
        factor.append(np.linalg.inv(low))
        offset.append(np.log((n[c] + 0.5) / (n.sum() + 1)) - np.log(np.diag(low)).sum())
    return Model(mean, np.stack(factor), np.array(offset), float((n[1] + 0.5) / (n.sum() + 1)))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score`` (0 to 1, the probability of class 1) and ``predicted`` in place of the
    statistics.

    Documents without words have all statistics zero and are scored like others. Null texts
    are empty, repeated rows get equal scores, null ids and further columns pass through
    (one named like a result is replaced), an empty table gives an empty result.
    """
    kept = [c for c in stats.columns if c not in ("_ll_f", "score", "predicted")]
    rows = stats.select(*kept, "_ll_f")

    def run(batches):
        for batch in batches:
            f = batch.column("_ll_f").flatten().to_numpy().reshape(-1, len(FEATURES))
            log = [model.offset[c] - 0.5 * (((f - model.mean[c]) @ model.factor[c].T) ** 2).sum(1) for c in (0, 1)]
            p = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))
