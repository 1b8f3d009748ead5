"""Scalar rules of the health score and its labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, POSITION_LABELS, Settings


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total_vrms(x="velRMS_x", y="velRMS_y", z="velRMS_z") -> Column:
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))


def crest_factor(peak="velPEAK", rms="velRMS") -> Column:
    return F.try_divide(_c(peak), _c(rms) + F.lit(1e-6))


def mahalanobis(features: list, mean, cov_inv) -> Column:
    """Distance of the feature vector from ``mean``; NULL when a feature is NULL
    or the quadratic form is negative or not finite."""
    mean, cov_inv = _c(mean), _c(cov_inv)
    delta = [_c(f) - mean[i] for i, f in enumerate(features)]
    n = len(delta)
    square = reduce(
        lambda a, b: a + b,
        [delta[i] * cov_inv[i][j] * delta[j] for i in range(n) for j in range(n)],
    )
    return F.when((square >= 0) & (square < F.lit(float("inf"))), F.sqrt(square))


def score_from_distance(distance, lam) -> Column:
    raw = F.lit(100.0) * F.exp(-_c(lam) * _c(distance))
    return F.when(_c(distance).isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))


def alert_level(score, cfg: Settings = DEFAULTS) -> Column:
    s = _c(score)
    return (
        F.when(s.isNull(), "Unknown")
        .when(s >= cfg.alert_normal, "Normal")
        .when(s >= cfg.alert_warning, "Warning")
        .otherwise("Critical")
    )


def load_bin(value, edges) -> Column:
    """Right-closed bin number on sorted edges, the lowest edge included.
    NULL values, values outside the edges and missing edges go to bin 0."""
    v, e = _c(value), _c(edges)
    inside = (v >= F.element_at(e, 1)) & (v <= F.element_at(e, -1))
    inner = F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda x: x < v))
    return F.when(inside, above).otherwise(F.lit(0)).cast("int")


def position_label(position) -> Column:
    p = _c(position)
    out = p
    for code, text in POSITION_LABELS.items():
        out = F.when(p == code, text).otherwise(out)
    return out


def correlation_strength(r) -> Column:
    a = F.abs(_c(r))
    return F.when(a >= 0.6, "strong").when(a >= 0.3, "medium").when(a.isNotNull(), "weak")


def trend_label(slope_per_month, cfg: Settings = DEFAULTS) -> Column:
    s = _c(slope_per_month)
    return (
        F.when(s.isNull(), "insufficient")
        .when(s > cfg.trend_band, "rising")
        .when(s < -cfg.trend_band, "falling")
        .otherwise("flat")
    )


def period_label(ts, split) -> Column:
    return F.when(_c(ts) < _c(split), "before").otherwise("after")


def pearson(x, y) -> Column:
    """Correlation aggregate over rows where both are known; NULL for a constant
    side, where the built-in one fails under ANSI rules."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def contains_any(name, words) -> Column:
    """True when the lower-cased name contains one of the words."""
    low = F.lower(_c(name))
    return reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words])


def name_has_any(name: str, words) -> bool:
    """The same test for a column name known on the driver."""
    return any(w.lower() in name.lower() for w in words)
