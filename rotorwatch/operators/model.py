"""Per-load-bin Mahalanobis model: training on baseline rows and scoring."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, FEATURE_PREFIXES, FREQUENCY_WORDS, Settings
from rotorwatch.functions.scoring import (
    alert_level,
    load_bin,
    mahalanobis,
    name_has_any,
    score_from_distance,
)
from rotorwatch.operators.quantiles import exact_percentiles
from rotorwatch.operators.series import TIME_ORDER, rolling_median
from rotorwatch.session import materialize

MIN_FILLED = 10  # fixed value: non-null rows a load column needs


def columns_like(df: DataFrame, words) -> list[str]:
    """Columns whose name holds one of the words, vibration features left out."""
    return [
        c for c in df.columns
        if not c.lower().startswith(FEATURE_PREFIXES) and name_has_any(c, words)
    ]


def resolve_bin_column(
    df: DataFrame, candidates: list[str] | None = None, key="device_id"
) -> DataFrame:
    """Name of each machine's load column: the first candidate with enough
    values, NULL when there is none. Default candidates: frequency, current."""
    if candidates is None:
        candidates = columns_like(df, FREQUENCY_WORDS)
        candidates += [c for c in ("current_A",) if c in df.columns and c not in candidates]
    chosen = [F.when(F.count(c) >= MIN_FILLED, F.lit(c)) for c in candidates]
    name = F.coalesce(*chosen) if chosen else F.max(F.lit(None).cast("string"))
    return df.groupBy(key).agg(name.cast("string").alias("bin_col"))


def _chosen_value(df: DataFrame, name="bin_col") -> Column:
    """Value of the load column that ``name`` names in this row."""
    numeric = [c for c, t in df.dtypes if t == "double"]
    return reduce(
        lambda acc, c: acc.when(F.col(name) == c, F.col(c)),
        numeric, F.when(F.lit(False), F.lit(None).cast("double")),
    )


def with_bin_value(df: DataFrame, choice: DataFrame, key="device_id") -> DataFrame:
    return df.join(F.broadcast(choice), key, "left").withColumn("bin_value", _chosen_value(df))


def quantile_bins(
    df: DataFrame, value="bin_value", key="device_id", cfg: Settings = DEFAULTS
) -> DataFrame:
    """Load bin edges per machine.

    Equal-count bins, as many as possible up to ``n_bins`` with at least
    ``min_bin_rows`` rows in each; equal edges are merged. NULL edges mean one bin.
    """
    wanted = {
        f"_e{q}_{i}": (value, i / q) for q in range(1, cfg.n_bins + 1) for i in range(q + 1)
    }
    edges = exact_percentiles(df, [key], wanted)
    edges = edges.withColumns({
        f"_edges{q}": F.array_distinct(F.array(*[f"_e{q}_{i}" for i in range(q + 1)]))
        for q in range(1, cfg.n_bins + 1)
    })
    labelled = df.where(F.col(value).isNotNull()).join(
        F.broadcast(edges.select(key, *[f"_edges{q}" for q in range(1, cfg.n_bins + 1)])), key
    )
    counts = labelled.groupBy(key).agg(*[
        F.count_if(load_bin(value, f"_edges{q}") == b).alias(f"_n{q}_{b}")
        for q in range(1, cfg.n_bins + 1) for b in range(q)
    ])
    good = edges.join(counts, key, "left")
    pick = F.lit(None).cast("array<double>")
    for q in range(1, cfg.n_bins + 1):  # the largest q that holds is applied last
        # Merged edges leave empty label numbers; only labels in use are tested.
        enough = reduce(
            lambda a, b: a & b,
            [(F.col(f"_n{q}_{b}") == 0) | (F.col(f"_n{q}_{b}") >= cfg.min_bin_rows) for b in range(q)],
        )
        used = reduce(lambda a, b: a | b, [F.col(f"_n{q}_{b}") > 0 for b in range(q)])
        # A constant column collapses to one edge and only counts as a single bin.
        shaped = F.lit(True) if q == 1 else F.size(f"_edges{q}") > 1
        pick = F.when(enough & used & shaped, F.col(f"_edges{q}")).otherwise(pick)
    return good.select(key, pick.alias("edges"))


def _pinv_batches(n):
    def run(batches):
        for pdf in batches:
            out = []
            for flat in pdf["cov"]:
                inv = np.linalg.pinv(np.asarray(flat, dtype=float).reshape(n, n))
                out.append(inv.tolist())
            pdf = pdf.drop(columns="cov")
            pdf["cov_inv"] = out
            yield pdf
    return run


def fit_bin_moments(
    df: DataFrame, features=None, keys=("device_id", "bin_id"), carry=(), cfg: Settings = DEFAULTS
) -> DataFrame:
    """Mean vector, covariance and its pseudo-inverse per (machine, bin), plus
    the ``carry`` columns, which are constant within a machine.

    The mean uses every value; the covariance only rows with all features. Bins
    with fewer than two such rows, or with a covariance that is not finite, are left out.
    """
    features = list(features or cfg.features)
    n = len(features)
    full = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    masked = {f: F.when(full, F.col(f)) for f in features}
    moments = (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("n_train"),
            F.count_if(full).alias("n_complete"),
            *[F.first(c, ignorenulls=True).alias(c) for c in carry],
            F.array(*[F.avg(f) for f in features]).alias("mean"),
            F.array(*[F.covar_samp(masked[a], masked[b]) for a in features for b in features]).alias("cov"),
        )
        .where((F.col("n_complete") >= 2) & F.forall("cov", lambda x: F.abs(x) < float("inf")))
    )
    # One row per bin reaches Python.
    types = dict(moments.dtypes)
    head = ", ".join(f"`{c}` {types[c]}" for c in moments.columns if c != "cov")
    return moments.mapInPandas(_pinv_batches(n), f"{head}, cov_inv array<array<double>>")


def calibrate_lambda(
    distances: DataFrame, keys=("device_id", "bin_id"), distance="distance", cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Decay rate that puts the 95th percentile distance at the anchor score."""
    p95 = exact_percentiles(distances, list(keys), {"p95": (distance, 0.95)})
    anchor = -math.log(cfg.score_at_p95 / 100.0)
    return p95.select(
        *keys, "p95",
        F.when(F.col("p95") > 0, F.lit(anchor) / F.col("p95")).otherwise(F.lit(1.0)).alias("lambda"),
    )


def label_baseline(
    df: DataFrame, candidates: list[str] | None = None, key="device_id", cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Baseline rows with their load column, bin edges and bin number."""
    rows = with_bin_value(df, resolve_bin_column(df, candidates, key), key)
    edges = quantile_bins(rows, key=key, cfg=cfg)
    return rows.join(F.broadcast(edges), key, "left").withColumn("bin_id", load_bin("bin_value", "edges"))


def train_model(
    baseline: DataFrame, features=None, candidates: list[str] | None = None,
    key="device_id", cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Model table, one row per (machine, bin), from baseline rows."""
    features = list(features or [f for f in cfg.features if f in baseline.columns])
    labelled = materialize(  # read three times below
        label_baseline(baseline, candidates, key, cfg).select(
            key, "bin_id", "bin_col", "edges", *features
        ),
        "labelled",
    )
    keys = [key, "bin_id"]
    moments = materialize(
        fit_bin_moments(labelled, features, keys, ("bin_col", "edges"), cfg), "moments"
    )
    dist = labelled.join(F.broadcast(moments.select(*keys, "mean", "cov_inv")), keys).select(
        *keys, mahalanobis(features, "mean", "cov_inv").alias("distance")
    )
    lam = calibrate_lambda(dist, keys, cfg=cfg)
    quality = (
        dist.join(F.broadcast(lam.select(*keys, "lambda")), keys)
        .groupBy(*keys).agg(F.avg(score_from_distance("distance", "lambda")).alias("avg_score"))
    )
    return (
        moments.join(lam.select(*keys, "lambda"), keys)
        .join(quality, keys)
        .select(*keys, "bin_col", "edges", "mean", "cov_inv", "lambda", "n_train", "avg_score")
    )


def model_summary(model: DataFrame, key="device_id") -> DataFrame:
    return model.select(
        key, "bin_id", "n_train", F.round("lambda", 4).alias("lambda"),
        F.round("avg_score", 1).alias("avg_baseline_score"),
    )


def model_by_machine(model: DataFrame, key="device_id") -> DataFrame:
    """One row per machine: edges, parameters by bin, and those of the last bin.
    A machine has at most ``n_bins`` bins, so the map stays tiny."""
    params = F.struct("mean", "cov_inv", "lambda")
    return model.groupBy(key).agg(
        F.first("bin_col", ignorenulls=True).alias("bin_col"),
        F.first("edges", ignorenulls=True).alias("edges"),
        F.map_from_entries(F.collect_list(F.struct("bin_id", params.alias("p")))).alias("_bins"),
        F.max_by(params, F.col("bin_id")).alias("_last"),
    )


def bin_params_fallback(df: DataFrame, model: DataFrame, key="device_id") -> DataFrame:
    """Attach ``load_bin`` and the parameters of that bin, or of the last trained
    bin where it was not trained. Machines without a model drop out."""
    rows = df.join(F.broadcast(model_by_machine(model, key)), key)
    rows = rows.withColumn("load_bin", load_bin(_chosen_value(df), "edges"))
    return rows.withColumn("_p", F.coalesce(F.try_element_at("_bins", F.col("load_bin")), "_last"))


def score_rows(df: DataFrame, model: DataFrame, features=None, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Score and alert of every row; NULL and Unknown when a feature is missing."""
    features = list(features or [f for f in cfg.features if f in df.columns])
    d = mahalanobis(features, F.col("_p.mean"), F.col("_p.cov_inv"))
    return (
        bin_params_fallback(df, model, key)
        .withColumn("distance", d)
        .withColumn("health_score", score_from_distance("distance", F.col("_p")["lambda"]))
        .withColumn("alert_level", alert_level("health_score", cfg))
        .select(*df.columns, "load_bin", "bin_col", "distance", "health_score", "alert_level")
    )


def smooth_scores(df: DataFrame, key="device_id", order=TIME_ORDER, cfg: Settings = DEFAULTS) -> DataFrame:
    if cfg.score_smooth_rows <= 1:
        return df.withColumn("health_score_smooth", F.col("health_score"))
    return rolling_median(df, [key], ["health_score"], cfg.score_smooth_rows, order, "_smooth", cfg=cfg)


def predict_scores(
    df: DataFrame, model: DataFrame, features=None, key="device_id", order=TIME_ORDER,
    cfg: Settings = DEFAULTS,
) -> DataFrame:
    """bin -> distance -> score -> alert -> smoothed score."""
    return smooth_scores(score_rows(df, model, features, key, cfg), key, order, cfg)
