"""Search for each machine's steadiest period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotorwatch.config import DEFAULTS, Settings
from rotorwatch.functions.times import from_micros, micros
from rotorwatch.operators.mapping import one_per_device
from rotorwatch.operators.quantiles import window_percentiles

_DAY = 86_400_000_000
CANDIDATE_COLUMNS = (
    "rank", "start_date", "end_date", "accOA_median", "vRMS_median",
    "accOA_cv", "vRMS_cv", "cf_cv", "stability_score", "n_rows",
)


def variation(col: str) -> Column:
    """Sample standard deviation over mean; NULL for a zero or missing mean."""
    return F.stddev_samp(col) / F.nullif(F.avg(col), F.lit(0.0))


def _with_cells(df: DataFrame, key: str, cfg: Settings) -> DataFrame:
    """Number of the step a row falls into since the machine's first timestamp,
    and the last window of the machine.

    A window is a run of whole steps, so a row's cell tells all its windows. The
    last window may end up to one step after the data. A machine with less data
    than one window has a single window over all of it.
    """
    width, step = cfg.window_days * _DAY, cfg.step_days * _DAY
    if width % step:
        raise ValueError("window_days must be a multiple of step_days")
    span = df.groupBy(key).agg(
        micros(F.min("datetime")).alias("_t0"), micros(F.max("datetime")).alias("_t1")
    )
    length = F.col("_t1") - F.col("_t0")
    short = length < width
    last = F.when(short, F.lit(0)).otherwise(F.floor((length + step - width) / step))
    cell = F.when(short, F.lit(0)).otherwise(F.floor((micros("datetime") - F.col("_t0")) / step))
    return df.join(F.broadcast(span), key).withColumn("_cell", cell.cast("long")).withColumn("_last", last.cast("long"))


def _reach(cfg: Settings) -> tuple[Column, Column]:
    """First and last window that a cell belongs to."""
    reach = cfg.window_days // cfg.step_days - 1
    return F.greatest(F.lit(0).cast("long"), F.col("_cell") - reach), F.least(F.col("_last"), F.col("_cell"))


def _windows_of(df: DataFrame, cfg: Settings) -> DataFrame:
    """Copy each cell into its windows."""
    low, high = _reach(cfg)
    return df.withColumn("window_no", F.explode(F.when(low <= high, F.sequence(low, high))))


def _with_dates(df: DataFrame, cfg: Settings) -> DataFrame:
    width, step = cfg.window_days * _DAY, cfg.step_days * _DAY
    start = F.col("_t0") + F.col("window_no") * step
    end = F.when(F.col("_t1") - F.col("_t0") < width, F.col("_t1")).otherwise(start + width)
    return df.withColumn("start_date", from_micros(start)).withColumn("end_date", from_micros(end))


def sliding_windows(df: DataFrame, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Copy each row into the windows it belongs to, with their dates."""
    rows = _with_dates(_windows_of(_with_cells(df, key, cfg), cfg), cfg)
    return rows.drop("_t0", "_t1", "_cell", "_last")


def _combined(parts, of):
    """Mean and sum of squared deviations of a window from those of its cells."""
    zero = F.lit(0.0)
    n = F.aggregate(parts, zero, lambda a, x: a + x[f"n_{of}"])
    total = F.aggregate(parts, zero, lambda a, x: a + F.coalesce(x[f"n_{of}"] * x[f"mean_{of}"], zero))
    return n, total / F.nullif(n, zero)


def _window_moments(cells: DataFrame, key: str, cfg: Settings) -> DataFrame:
    """Row count, and count and variation of every feature, per window.

    Moments are taken once per cell; a window joins at most its own cells.
    """
    per_cell = cells.groupBy(key, "_t0", "_t1", "_last", "_cell").agg(
        F.count("*").alias("n"),
        *[x for c in cfg.features for x in (
            F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"),
            (F.var_pop(c) * F.count(c)).alias(f"m2_{c}"),
        )],
    )
    body = [f"{s}_{c}" for c in cfg.features for s in ("n", "mean", "m2")]
    out = _windows_of(per_cell, cfg).groupBy(key, "window_no", "_t0", "_t1").agg(
        F.sum("n").alias("n_rows"), F.collect_list(F.struct(*body)).alias("_cells")
    )
    zero = F.lit(0.0)
    out = out.withColumns({
        name: value for c in cfg.features
        for name, value in zip((f"n_{c}", f"mean_{c}"), _combined(F.col("_cells"), c))
    })
    variations = {}
    for c in cfg.features:
        spread = F.aggregate("_cells", zero, lambda a, x: a + F.coalesce(
            x[f"m2_{c}"] + x[f"n_{c}"] * F.pow(x[f"mean_{c}"] - F.col(f"mean_{c}"), F.lit(2.0)), zero))
        std = F.sqrt(spread / F.nullif(F.col(f"n_{c}") - 1, zero))
        variations[f"cv_{c}"] = std / F.nullif(F.col(f"mean_{c}"), zero)
    return out.withColumns(variations).drop("_cells")


def window_stability(df: DataFrame, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Medians, variations and the stability score of every valid window."""
    have = set(df.columns)
    narrow = df.select(
        key, "datetime",
        *[(F.col(c) if c in have else F.lit(None).cast("double")).alias(c) for c in cfg.features],
    )
    cells = _with_cells(narrow, key, cfg)
    group = [key, "window_no"]
    wanted = {"_acc": ("accOA", 0.5), "_vrms": ("Total_vRMS", 0.5)}
    medians = window_percentiles(cells, key, wanted, ["_cell", "_last"], lambda d: _windows_of(d, cfg))
    stats = _with_dates(_window_moments(cells, key, cfg).join(medians, group), cfg)
    few = lambda c, v: F.when(F.col(f"n_{c}") >= 2, v)
    return (
        stats.where(
            (F.col("n_rows") >= cfg.min_bin_rows)
            & (F.col("n_accOA") >= cfg.min_bin_rows)
            & F.col("cv_accOA").isNotNull()
        )
        .select(
            *group, "start_date", "end_date",
            F.round("_acc", 6).alias("accOA_median"),
            F.round(few("Total_vRMS", F.col("_vrms")), 6).alias("vRMS_median"),
            F.round("cv_accOA", 6).alias("accOA_cv"),
            F.round(few("Total_vRMS", F.col("cv_Total_vRMS")), 6).alias("vRMS_cv"),
            F.round(few("Crest_Factor", F.col("cv_Crest_Factor")), 6).alias("cf_cv"),
            F.round(F.col("_acc") * F.col("cv_accOA"), 6).alias("stability_score"),
            "n_rows",
        )
    )


def _steadiest(key):
    return Window.partitionBy(key).orderBy("stability_score", "start_date")


def steadiest_windows(windows: DataFrame, k: int, key="device_id") -> DataFrame:
    """The ``k`` windows of each machine with the lowest stability score."""
    return windows.withColumn("rank", F.row_number().over(_steadiest(key))).where(F.col("rank") <= k)


def cv_filter_relax(windows: DataFrame, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Keep windows below the variation limits; a feature without any value in
    the machine's windows is not tested, and if none passes all stay."""
    limits = {
        "accOA_cv": cfg.cv_limits["accOA"],
        "vRMS_cv": cfg.cv_limits["Total_vRMS"],
        "cf_cv": cfg.cv_limits["Crest_Factor"],
    }
    all_of_machine = Window.partitionBy(key)  # at most prefilter_n rows each
    ok = F.lit(True)
    for c, limit in limits.items():
        absent = F.count(c).over(all_of_machine) == 0
        ok = ok & (absent | F.coalesce(F.col(c) < limit, F.lit(False)))
    return (
        windows.withColumn("passes_cv", ok)
        .withColumn("_n", F.count_if("passes_cv").over(all_of_machine))
        .where(F.col("passes_cv") | (F.col("_n") == 0))
        .drop("_n")
    )


def rank_candidates(windows: DataFrame, top_n: int | None = None, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    best = steadiest_windows(windows.drop("rank"), top_n or cfg.top_n, key)
    return best.select(key, *CANDIDATE_COLUMNS)


def detect_baseline(df: DataFrame, top_n: int | None = None, key="device_id", cfg: Settings = DEFAULTS) -> DataFrame:
    """Ranked baseline candidates of every machine."""
    pool = steadiest_windows(window_stability(df, key, cfg), cfg.prefilter_n, key)
    return rank_candidates(cv_filter_relax(pool, key, cfg), top_n, key, cfg)


def manual_baseline(df: DataFrame, device_dim: DataFrame) -> DataFrame:
    """Rows inside the period given by hand for their machine, both ends included."""
    given = one_per_device(device_dim).where(
        F.col("train_start").isNotNull() & F.col("train_end").isNotNull()
    ).select("devicename", "train_start", "train_end")
    return df.join(F.broadcast(given), "devicename").where(
        (F.col("datetime") >= F.col("train_start")) & (F.col("datetime") <= F.col("train_end"))
    )


def baseline_slice(
    df: DataFrame, candidates: DataFrame, device_dim: DataFrame | None = None, key="device_id"
) -> DataFrame:
    """Rows of each machine's baseline, with ``is_manual``.

    A period given by hand wins; if it holds no rows the best candidate is used,
    whose end is exclusive.
    """
    best = candidates.where(F.col("rank") == 1).select(key, "start_date", "end_date")
    in_auto = (F.col("datetime") >= F.col("start_date")) & (F.col("datetime") < F.col("end_date"))
    if device_dim is None:
        return df.join(F.broadcast(best), key).where(in_auto).select(*df.columns, F.lit(False).alias("is_manual"))
    given = (
        manual_baseline(df, device_dim)
        .groupBy(key).agg(F.min("train_start").alias("_m0"), F.max("train_end").alias("_m1"))
    )
    bounds = best.join(given, key, "full_outer")
    in_manual = (F.col("datetime") >= F.col("_m0")) & (F.col("datetime") <= F.col("_m1"))
    by_hand = F.col("_m0").isNotNull()
    return (
        df.join(F.broadcast(bounds), key)
        .where(F.when(by_hand, in_manual).otherwise(in_auto))
        .select(*df.columns, by_hand.alias("is_manual"))
    )
