"""Settings shared by all operators.

The first block holds fixed values that results depend on. The second block
holds execution knobs: they change how work is split, never what comes out.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # --- fixed values -------------------------------------------------------
    crest_spike: float = 20.0
    current_on: float = 1.0
    vrms_on: float = 0.1
    merge_tolerance_s: int = 5 * 60

    window_days: int = 14
    step_days: int = 1
    top_n: int = 3
    prefilter_n: int = 10
    cv_limits: dict = field(
        default_factory=lambda: {"accOA": 0.20, "Total_vRMS": 0.25, "Crest_Factor": 0.30}
    )

    n_bins: int = 3
    min_bin_rows: int = 15
    score_at_p95: float = 80.0
    features: tuple = ("Total_vRMS", "accOA", "Crest_Factor")
    smooth_rows: int = 3
    score_smooth_rows: int = 5

    alert_normal: float = 80.0
    alert_warning: float = 60.0
    trend_band: float = 1.0
    baseline_ok: float = 85.0

    gap_interval_min: float = 2.0
    gap_factor: float = 3.0

    corr_min_rows: int = 10
    constant_sigma: float = 1e-10

    # --- execution knobs ----------------------------------------------------
    range_parts: int = 0            # parts of a table in row order; 0: four for each core
    block_rows: int = 200_000       # without effect: rolling frames run over the same parts


DEFAULTS = Settings()

# Name fragments that identify a telemetry variable.
FREQUENCY_WORDS = ("頻率", "freq", "hz", "frequency")
POWER_WORDS = ("輸入功率", "power", "功率")
CURRENT_WORDS = ("電流", "current", "安培", "amp")
ENERGY_WORDS = ("用電量", "度數", "kwh", "energy", "電能")
FLOW_WORDS = ("流量", "flow", "nm3", "nm³", "cmm")
RUN_HOUR_WORDS = ("運轉時數", "運轉小時", "runhour", "runtime", "run_hour", "runhr")

# Column prefixes that mark vibration features, not telemetry.
FEATURE_PREFIXES = ("acc", "total_v", "crest_", "health", "load_bin", "alert_", "vel")

# The four metrics compared around a maintenance date.
DISPLAY_METRICS = ("velRMS", "velOA", "accRMS", "accOA")

# Text shown for the two measuring positions.
POSITION_LABELS = {"M1": "自由端 (Free End)", "M2": "驅動端 (Drive End)"}

DEFAULT_EVENT_NAME = "保養"
DEFAULT_CURRENT_TYPE = "電流"
