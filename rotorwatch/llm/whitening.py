"""Whitening of embeddings; components by spectral divide and conquer with QDWH.

Entries become integers, ``floor(256 * c)``. Mean and covariance are taken over the distinct vectors, as
sums that every task adds up for its rows. Only sums of the size of one vector or of one square
matrix of that size reach the driver, which splits the covariance: the polar factor U of ``A - s I`` has the
eigenvectors of A, with eigenvalues 1 above s and -1 below, so ``(U + I) / 2`` projects on the
subspace above s. Bases of both sides give two smaller matrices, down to single components.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorwatch.session import materialize

EPS = np.finfo(float).eps
SCALE = 256


class Model(NamedTuple):
    n: int                  # distinct vectors
    total: list             # exact sums per dimension, Python integers
    values: np.ndarray      # eigenvalues, falling
    components: np.ndarray  # one column each
    trace: float


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by the QR form of dynamically weighted Halley steps.

    Singular directions below rounding may come out with any sign. A zero matrix gives the identity.
    """
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x = a / norm
    low = EPS  # lower bound of the singular values; each step lifts it
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        x = new
        if abs(1 - low) < 10 * EPS and moved < 1e-12 * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray, scale: float):
    """Bases of the subspaces above and below a shift, or None where rounding hides every gap."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    # The mean lies between the outer eigenvalues; other shifts serve where it falls on an eigenvalue.
    for t in (0.0, 0.31, -0.31, 0.13, -0.13, 0.57, -0.57):
        projector = (polar(a - (mean + t * spread) * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        # The largest columns span the upper subspace; further rounds of the projector clean both sides.
        pick = np.argsort(-np.diag(projector), kind="stable")
        q, _ = np.linalg.qr(projector[:, pick[:k]], mode="complete")
        for _ in range(3):
            q, _ = np.linalg.qr(np.hstack([projector @ q[:, :k], q[:, k:] - projector @ q[:, k:]]))
            if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 10 * n * EPS * scale:
                return q[:, :k], q[:, k:]
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix by divide and conquer.

    Eigenvalues that rounding can't tell apart keep the basis in which they come.
    """
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.linalg.norm(a)
    done, open_ = [], [(a, np.eye(len(a)))]
    while open_:
        part, basis = open_.pop()
        n = len(part)
        level = np.trace(part) / n
        flat = n == 1 or np.linalg.norm(part - level * np.eye(n)) <= n * EPS * scale
        two = None if flat else _split(part, scale)
        if two is None:
            done.append(basis)
            continue
        for q in two:
            inner = q.T @ part @ q
            open_.append(((inner + inner.T) / 2, basis @ q))
    vectors, _ = np.linalg.qr(np.hstack(done))  # rounding of the products of bases
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def integers(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Id and ``x``, the integers of every usable vector. Vectors that are null or hold null or
    non-finite entries go, and so do those whose length is not the most frequent one (the longest
    of several)."""
    c = F.col(vector_col)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = docs.select(F.col(id_col).alias("_ll_id"), c).where(c.isNotNull() & finite)
    sizes = good.groupBy(F.size(c).alias("k")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("k")).limit(1).select("k")
    x = F.transform(c, lambda v: F.floor(v.cast("double") * float(SCALE)).cast("long"))
    return good.where(F.size(c) == best.scalar()).select("_ll_id", x.alias("x"))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as one array of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _summed(rows: DataFrame, function, d: int) -> np.ndarray:
    """Sum over all rows of the (k x d) arrays that ``function`` gives for a batch."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = function(_matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    long = rows.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = long.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # one row per entry of the matrix
    out = np.zeros((max((r.i for r in cells), default=-1) + 1, d))
    for r in cells:
        out[r.i, r.j] = r.v
    return out


def fit(distinct: DataFrame) -> Model:
    """Mean and components of the distinct integer vectors in column ``x``."""
    sums = distinct.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    d, n = len(sums), sums[0].n if sums else distinct.count()
    total = [int(r.s) for r in sums]
    mean = np.array([s / n for s in total])

    def products(x):
        centred = x - mean
        return centred.T @ centred

    covariance = _summed(distinct, products, d) / n if d else np.zeros((0, 0))
    covariance = (covariance + covariance.T) / 2
    values, components = eigen(covariance)
    return Model(n, total, values, components, float(np.trace(covariance)))


def _whitener(model: Model, k: int):
    """Projection of integer rows on the first ``k`` components, to variance 1; NaN where there is none."""
    values, mean = model.values[:k], np.array([s / model.n for s in model.total])
    alive = values > len(mean) * EPS * max(model.trace, 0.0)
    scale = np.full(len(values), np.nan)
    scale[alive] = 1 / np.sqrt(values[alive])
    matrix = model.components[:, :k] * scale
    return lambda x: (x - mean) @ matrix


def identity_error(distinct: DataFrame, model: Model, k: int) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity, over components that vary."""
    project, d = _whitener(model, k), len(model.total)
    k = min(k, d)

    def moments(x):
        w = np.nan_to_num(project(x))
        return np.vstack([w.T @ w, w.sum(0)])

    got = _summed(distinct, moments, k) / model.n
    if not len(got):
        return None
    alive = model.values[:k] > d * EPS * max(model.trace, 0.0)
    error = np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k))[np.ix_(alive, alive)]
    return float(error.max()) if error.size else None


def whiten(vectors: DataFrame, model: Model, k: int) -> DataFrame:
    """Rows of ``vectors`` with ``deviation`` (decimal) and ``whitened``, an array of ``k`` components at most, NULL
    where a component has no variance. The model is as large as one square matrix and travels with the task."""
    project, n, total = _whitener(model, k), model.n, model.total
    squares = sum(s * s for s in total)
    reach = max([1, *(abs(s) for s in total)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
            if len(total) * max(most, 1) * max(most, reach) >= 1 << 62:  # sums need more than a word
                x = x.astype(object)
            # sum of (n x - S)^2 as n^2 sum x^2 - 2 n sum x S + sum S^2, in integers of any size
            s = np.array(total, dtype=x.dtype)
            second, cross = (x * x).sum(1).tolist(), (x * s).sum(1).tolist()
            deviation = [Decimal(int(n * n * a - 2 * n * b + squares)) for a, b in zip(second, cross, strict=True)]
            w = project(x.astype(float))
            lists = [[None if v != v else v for v in row] for row in w.tolist()]
            fits = [d if d < 10**38 else None for d in deviation]
            yield pa.RecordBatch.from_arrays([
                batch.column("_ll_id"), pa.array(fits, pa.decimal128(38, 0)), pa.array(lists, pa.list_(pa.float64())),
            ], ["_ll_id", "deviation", "whitened"])

    kind = vectors.schema["_ll_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"_ll_id {kind}, deviation decimal(38,0), whitened array<double>")


def whitened_components(docs: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``docs`` and component up to ``components``: id, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Null vectors and vectors with null or non-finite entries have no rows, nor have vectors whose length is not the
    usual one; entries beyond 64 bits are the largest integers. Copies count once in the fit and each gets its
    rows; a null id is one like others. ``deviation`` is exact, NULL from 38 digits on. A component without
    variance has NULL ``whitened``; ``explained`` is NULL where nothing varies. Vectors with fewer
    entries than ``components`` have as many components as entries. An empty table gives an empty
    result. Only the two named columns are read.
    """
    vectors = materialize(integers(docs, id_col, vector_col), "vectors")
    distinct = materialize(vectors.select("x").distinct(), "distinct")
    model = fit(distinct)
    share = [None if model.trace <= 0 else float(max(v, 0.0) / model.trace) for v in model.values[:components]]
    error = identity_error(distinct, model, components)
    out = whiten(vectors, model, components)
    part = F.array(*[F.lit(s).cast("double") for s in share]) if share else F.array().cast("array<double>")
    return out.select("_ll_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        F.col("_ll_id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(part, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
