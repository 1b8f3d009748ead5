"""Pearson and Spearman correlation of telemetry with vibration features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.operators.quantiles import with_centred_ranks

SIMPSON_STEPS = 2000


def _pairs(df: DataFrame, xs, ys, key) -> DataFrame:
    both = F.array(*[
        F.struct(F.lit(x).alias("v"), F.lit(y).alias("f"), F.col(x).alias("x"), F.col(y).alias("y"))
        for x in xs for y in ys
    ])
    return (
        df.select(key, F.explode(both).alias("_p"))
        .select(key, F.col("_p.v").alias("variable_type"), F.col("_p.f").alias("vibration_feature"),
                F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def correlation_matrix(df: DataFrame, xs, ys, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """r of every telemetry x feature pair of a machine, 4 decimals.

    Uses rows where both are known; pairs with too few rows or a constant side
    are left out. Equal (x, y) of a pair are counted first; what follows grows with the
    different ones.
    """
    pair = [key, "variable_type", "vibration_feature"]
    cells = _pairs(df, xs, ys, key).groupBy(*pair, "x", "y").agg(F.count("*").alias("_n"))
    ranked = with_centred_ranks(with_centred_ranks(cells, pair, "x", "_n", "_rx"), pair, "y", "_n", "_ry")
    products = {"xx": ("_rx_value", "_rx_value"), "yy": ("_ry_value", "_ry_value"), "xy": ("_rx_value", "_ry_value"),
                "rxx": ("_rx", "_rx"), "ryy": ("_ry", "_ry"), "rxy": ("_rx", "_ry")}
    sums = ranked.groupBy(*pair).agg(
        F.sum("_n").alias("n_samples"),
        *[F.sum(F.col("_n") * F.col(a) * F.col(b)).alias(f"_{name}") for name, (a, b) in products.items()])

    def r(kind):
        return F.col(f"_{kind}xy") / F.nullif(F.sqrt(F.col(f"_{kind}xx")) * F.sqrt(F.col(f"_{kind}yy")), F.lit(0.0))

    varies = [F.sqrt(F.col(c) / F.col("n_samples")) >= cfg.constant_sigma for c in ("_xx", "_yy")]
    return (
        sums.withColumns({"_p": r(""), "_s": r("r")})
        .where((F.col("n_samples") >= cfg.corr_min_rows) & varies[0] & varies[1]
               & F.col("_p").isNotNull() & F.col("_s").isNotNull())
        .select(*pair, F.round("_p", 4).alias("pearson_r"), F.round("_s", 4).alias("spearman_r"), "n_samples",
                F.col("_p").alias("pearson_raw"), F.col("_s").alias("spearman_raw"))
    )


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation: t test with n - 2 degrees of freedom, n above 3.

    With a = (n - 2) / 2 it is 2 / sqrt(pi) * gamma(a + 1/2) / gamma(a) times the integral of
    (1 - u^2)^(a - 1) from |r| to 1. Simpson's rule covers the range up to where the integrand
    is e^-60 of its first value. Values below 1e-300 are 0.
    """
    a, low = (n.cast("double") - 2) / 2, F.least(F.lit(1.0), F.abs(r))
    # The series for the ratio of gammas is taken eight steps up, where its error is far below 1e-12.
    b = a + 8
    scale = 0.5 * F.log(b) - 1 / (8 * b) + 1 / (192 * b * b * b) - 1 / (640 * F.pow(b, F.lit(5.0)))
    for k in range(8):
        scale = scale + F.log((a + k) / (a + (k + 0.5)))
    reach = F.least(F.lit(1.0), 60 / F.greatest(a - 1, F.lit(0.5)))
    high = F.least(F.lit(1.0), F.sqrt(low * low + (1 - low * low) * reach))
    known = F.struct(a.alias("a"), low.alias("low"), ((high - low) / SIMPSON_STEPS).alias("h"), scale.alias("scale"))

    def integral(x):
        def body(k):
            u = x["low"] + x["h"] * k
            weight = F.when((k == 0) | (k == SIMPSON_STEPS), 1).when(k % 2 == 1, 4).otherwise(2)
            return weight * F.pow(F.greatest(F.lit(0.0), 1 - u * u), x["a"] - 1)

        total = F.aggregate(F.sequence(F.lit(0), F.lit(SIMPSON_STEPS)), F.lit(0.0), lambda s, k: s + body(k))
        return 2 / math.sqrt(math.pi) * F.exp(x["scale"]) * x["h"] / 3 * total

    p = F.transform(F.array(known), integral)[0]
    return F.when(p < 1e-300, 0.0).otherwise(F.least(F.lit(1.0), p))


def with_p_values(correlations: DataFrame) -> DataFrame:
    """Add p-values as text. Works on the finished table: one row per pair."""
    return correlations.withColumns({
        f"{kind}_p": F.format_string("%.2e", correlation_p(F.col(f"{kind}_raw"), F.col("n_samples")))
        for kind in ("pearson", "spearman")
    })


def correlation_pivot(correlations: DataFrame, features, key="device_id") -> DataFrame:
    """Telemetry x feature matrix of Pearson r."""
    return (
        correlations.groupBy(key, "variable_type").pivot("vibration_feature", list(features)).agg(F.first("pearson_r"))
    )


def topk_correlations(correlations: DataFrame, k: int = 6, key="device_id") -> DataFrame:
    """The strongest pairs of each machine."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("pearson_r")), "variable_type", "vibration_feature")
    return correlations.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
