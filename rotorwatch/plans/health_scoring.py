"""From raw vibration and telemetry to scored rows and machine summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.operators.baseline import baseline_slice, detect_baseline
from rotorwatch.operators.clean import derive_features, filter_running, filter_spikes, smooth_features
from rotorwatch.operators.fleet import device_records, device_summary, scoring_status
from rotorwatch.operators.mapping import asof_current, asof_scada_wide
from rotorwatch.operators.model import predict_scores, score_rows, train_model
from rotorwatch.operators.telemetry import pivot_scada
from rotorwatch.session import materialize


class Scoring(NamedTuple):
    rows: DataFrame        # clean rows with current and telemetry
    candidates: DataFrame  # ranked baseline periods
    baseline: DataFrame    # rows of the chosen period
    model: DataFrame       # one row per machine and load bin
    scored: DataFrame      # rows with scores, alerts and smoothed scores (lazy)
    records: DataFrame     # one row per measuring point
    summary: DataFrame     # one row per machine
    status: DataFrame      # one row per measuring point: scored, or the step that failed


def aligned_rows(
    vib: DataFrame, current: DataFrame, device_dim: DataFrame,
    tolerance_s: int | None = None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Raw rows without spikes, with current. Spikes are judged row by row, so
    they are dropped before the join shuffles anything."""
    return asof_current(filter_spikes(derive_features(vib), cfg=cfg), current, device_dim, tolerance_s, cfg)


def clean_rows(
    vib: DataFrame, current: DataFrame, device_dim: DataFrame, telemetry: DataFrame | None = None,
    tag_dim: DataFrame | None = None, tolerance_s: int | None = None, cfg: Settings = DEFAULTS,
) -> DataFrame:
    """Aligned, running, smoothed rows; telemetry columns are added if given."""
    # The joined rows are read by the machine flags, the slice totals and the windows.
    aligned = materialize(aligned_rows(vib, current, device_dim, tolerance_s, cfg), "aligned")
    rows = smooth_features(filter_running(aligned, cfg=cfg), cfg=cfg)
    if telemetry is not None and tag_dim is not None:
        # Its rows are dealt by range, which reads them twice: once for the borders.
        rows = asof_scada_wide(materialize(rows, "smooth"), pivot_scada(telemetry, tag_dim), tolerance_s, cfg)
    return rows


def score_machines(
    vib: DataFrame, current: DataFrame, device_dim: DataFrame, telemetry: DataFrame | None = None,
    tag_dim: DataFrame | None = None, tolerance_s: int | None = None, cfg: Settings = DEFAULTS,
) -> Scoring:
    rows = materialize(
        clean_rows(vib, current, device_dim, telemetry, tag_dim, tolerance_s, cfg), "clean"
    )
    candidates = materialize(detect_baseline(rows, cfg=cfg), "candidates")
    baseline = materialize(baseline_slice(rows, candidates, device_dim), "baseline")
    model = materialize(train_model(baseline, cfg=cfg), "model")
    scored = predict_scores(rows, model, cfg=cfg)
    records = device_records(score_rows(rows, model, cfg=cfg), baseline, device_dim)
    status = scoring_status(vib, rows, baseline, model, scored)
    return Scoring(rows, candidates, baseline, model, scored, records, device_summary(records, cfg), status)
