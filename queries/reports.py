"""Fleet tables, correlation, trend lines, maintenance effect, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as i
from queries.joins import asof_wide_sql
from queries.registry import STEPS, query, r
from queries.rows import rolling, rounded
from queries.telemetry import _VARS
from rotorwatch.config import DISPLAY_METRICS
from rotorwatch.functions import scoring as labels
from rotorwatch.operators import correlation, fleet, maintenance, quantiles, stats
from rotorwatch.plans import correlation_report, maintenance_effect

# --- fleet ------------------------------------------------------------------

STEPS["valid"] = "SELECT * FROM vib WHERE HealthScore IS NOT NULL AND HealthScore <> 0"
STEPS["valid_span"] = "SELECT device_id, min(datetime) AS t0, max(datetime) AS t1 FROM valid GROUP BY 1"
STEPS["health_stats"] = f"""
SELECT t.device_id, n_total, n_valid, n_total - n_valid AS n_excluded,
 {r('100e0 * (n_total - n_valid) / n_total', 1)} AS excluded_pct, mean, median, std, min, max, date_start, date_end
FROM (SELECT device_id, count(*) AS n_total FROM vib GROUP BY 1) t
JOIN (SELECT device_id, count(*) AS n_valid, {r('avg(HealthScore)', 2)} AS mean,
  {r('quantile_cont(HealthScore, 0.5)', 2)} AS median, {r('stddev_samp(HealthScore)', 2)} AS std,
  {r('min(HealthScore)', 2)} AS min, {r('max(HealthScore)', 2)} AS max, min(datetime) AS date_start, max(datetime) AS date_end
 FROM valid GROUP BY 1) v USING (device_id)"""
STEPS["trends"] = """
SELECT device_id, n AS n_valid, k * 30 AS slope, b AS intercept FROM (
 SELECT device_id, count(*) AS n, regr_slope(HealthScore, d) AS k, regr_intercept(HealthScore, d) AS b
 FROM (SELECT v.device_id, HealthScore, (epoch_us(datetime) - epoch_us(t0)) / 86400000000e0 AS d
  FROM valid v JOIN valid_span s USING (device_id)) GROUP BY 1)"""
STEPS["trend_rows"] = f"""
SELECT device_id, n_valid, {r('slope', 2)} AS slope_per_month, {r('intercept', 4)} AS intercept,
 CASE WHEN slope IS NULL THEN 'insufficient' WHEN slope > 1 THEN 'rising' WHEN slope < -1 THEN 'falling' ELSE 'flat' END AS trend_label
FROM trends"""
STEPS["half_rows"] = f"""
SELECT device_id, {r('a', 2)} AS first_half_mean, {r('b', 2)} AS second_half_mean, {r('(b - a) / nullif(a, 0) * 100', 1)} AS half_change_pct
FROM (SELECT device_id, avg(HealthScore) FILTER (WHERE early) AS a, avg(HealthScore) FILTER (WHERE NOT early) AS b
 FROM (SELECT v.device_id, HealthScore, epoch_us(datetime) < epoch_us(t0) + (epoch_us(t1) - epoch_us(t0)) // 2 AS early
  FROM valid v JOIN valid_span USING (device_id)) GROUP BY 1)"""


def recent_sql(days):
    return f"""
SELECT v.device_id, {r('avg(HealthScore)', 2)} AS recent_mean, count(*) AS recent_n
FROM valid v JOIN valid_span s USING (device_id) WHERE v.datetime >= s.t1 - INTERVAL {days} DAY GROUP BY 1"""


STEPS["daily_scores"] = f"""
SELECT device_id, CAST(datetime AS DATE) AS date, {r('avg(HealthScore)', 2)} AS avg_score, count(*) AS n_valid FROM valid GROUP BY 1, 2"""


@query("device_health_stats", "SELECT * FROM health_stats")
def health_stats(spark, sf):
    return fleet.device_health_stats(i.vib(spark, sf))


@query("health_trend", "SELECT * FROM trend_rows")
def trend(spark, sf):
    df = fleet.health_trend(i.vib(spark, sf))
    return df.withColumn("intercept", F.round("intercept", 4))


@query("trend_label", "SELECT device_id, trend_label FROM trend_rows")
def trend_labels(spark, sf):
    return fleet.health_trend(i.vib(spark, sf)).select("device_id", "trend_label")


@query("half_period_change", "SELECT * FROM half_rows")
def halves(spark, sf):
    return fleet.half_period_change(i.vib(spark, sf))


@query("recent_window_mean", recent_sql(7))
def recent(spark, sf):
    return fleet.recent_window_mean(i.vib(spark, sf), days=7)


@query("daily_device_scores", "SELECT * FROM daily_scores")
def daily(spark, sf):
    return fleet.daily_device_scores(i.vib(spark, sf))


@query("daily_fleet_average", f"""
SELECT date, {r('CAST(sum(CAST(avg_score AS DECIMAL(18,2))) AS DOUBLE) / count(*)', 2)} AS avg_score,
 count(avg_score) AS n_devices FROM daily_scores
WHERE date >= (SELECT max(date) - 9 FROM daily_scores) GROUP BY 1""")
def fleet_daily(spark, sf):
    return fleet.daily_fleet_average(fleet.daily_device_scores(i.vib(spark, sf)), days=10)


@query("fleet_ranking", "SELECT device_id, mean, n_valid FROM health_stats ORDER BY mean, device_id")
def ranking(spark, sf):
    return fleet.fleet_ranking(fleet.device_health_stats(i.vib(spark, sf))).select("device_id", "mean", "n_valid")


STEPS["recent30"] = recent_sql(30)


@query("fleet_overview", """
SELECT s.*, t.slope_per_month, t.intercept, t.trend_label, h.first_half_mean, h.second_half_mean, h.half_change_pct,
 c.recent_mean, c.recent_n
FROM health_stats s JOIN trend_rows t USING (device_id) JOIN half_rows h USING (device_id) JOIN recent30 c USING (device_id)""")
def overview(spark, sf):
    df = fleet.health_summary(i.vib(spark, sf))
    return df.withColumn("intercept", F.round("intercept", 4))


# --- correlation ------------------------------------------------------------

_FEATS = ("Total_vRMS", "accOA", "Crest_Factor")
_ALL_FEATS = (*_FEATS, "HealthScore")
STEPS["vib_on"] = "SELECT * FROM spikeless WHERE Total_vRMS > 0.1"
STEPS["vib_clean"] = rolling(_FEATS, "vib_on", 1, 1)
STEPS["paired"] = asof_wide_sql("vib_clean")
STEPS["pair_rows"] = " UNION ALL ".join(
    f"""SELECT device_id, '{v}' AS variable_type, '{f}' AS vibration_feature, "{v}" AS x, {f} AS y FROM paired
 WHERE "{v}" IS NOT NULL AND {f} IS NOT NULL""" for v in _VARS for f in _ALL_FEATS)
_PART = "OVER (PARTITION BY device_id, variable_type, vibration_feature"
STEPS["pair_ranks"] = f"""
SELECT *, rank() {_PART} ORDER BY x) + (count(*) {_PART}, x) - 1) / 2e0 AS rx,
 rank() {_PART} ORDER BY y) + (count(*) {_PART}, y) - 1) / 2e0 AS ry FROM pair_rows"""
STEPS["pair_corr"] = f"""
SELECT device_id, variable_type, vibration_feature, {r('corr(x, y)', 4)} AS pearson_r, {r('corr(rx, ry)', 4)} AS spearman_r,
 count(*) AS n_samples FROM pair_ranks GROUP BY 1, 2, 3
HAVING count(*) >= 10 AND stddev_pop(x) >= 1e-10 AND stddev_pop(y) >= 1e-10"""
_NO_HS = "FROM pair_corr WHERE vibration_feature <> 'HealthScore'"


def _paired(spark, sf):
    return correlation_report.paired_rows(
        i.vib(spark, sf), i.telemetry(spark, sf), i.tag_dim(spark, sf), i.TOLERANCE_S)


def _correlations(spark, sf, score=False):
    return correlation_report.correlation_report(
        i.vib(spark, sf), i.telemetry(spark, sf), i.tag_dim(spark, sf), score, i.TOLERANCE_S)


_CORR = ("device_id", "variable_type", "vibration_feature", "pearson_r", "spearman_r", "n_samples")


@query("correlation_matrix", f"SELECT * {_NO_HS}")
def corr(spark, sf):
    return _correlations(spark, sf).select(*_CORR)


STEPS["pair_tails"] = """
SELECT *, least(1e0, sqrt(low * low + (1 - low * low) * least(1e0, 60 / greatest(a - 1, 5e-1)))) AS high
FROM (SELECT device_id, variable_type, vibration_feature, side, (n - 2) / 2e0 AS a, least(1e0, abs(rho)) AS low
 FROM (SELECT device_id, variable_type, vibration_feature, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman
  FROM pair_ranks GROUP BY 1, 2, 3 HAVING count(*) >= 10 AND stddev_pop(x) >= 1e-10 AND stddev_pop(y) >= 1e-10)
 UNPIVOT (rho FOR side IN (pearson, spearman)))"""
STEPS["pair_p"] = """
SELECT device_id, variable_type, vibration_feature, side, CASE WHEN p < 1e-300 THEN 0e0 ELSE least(1e0, p) END AS p
FROM (SELECT device_id, variable_type, vibration_feature, side,
  2 / sqrt(pi()) * exp(any_value(lgamma(a + 5e-1) - lgamma(a))) * any_value(high - low) / 4000 / 3
  * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
   * pow(greatest(0e0, 1 - pow(low + (high - low) * k / 4000, 2)), a - 1)) AS p
 FROM pair_tails, range(4001) g(k) GROUP BY 1, 2, 3, 4)"""


@query("correlation_p_values", f"""
SELECT c.*, format('{{:.2e}}', a.p) AS pearson_p, format('{{:.2e}}', b.p) AS spearman_p
FROM (SELECT * {_NO_HS}) c JOIN pair_p a USING (device_id, variable_type, vibration_feature)
JOIN pair_p b USING (device_id, variable_type, vibration_feature) WHERE a.side = 'pearson' AND b.side = 'spearman'""")
def corr_p(spark, sf):
    return _correlations(spark, sf).select(*_CORR, "pearson_p", "spearman_p")


@query("correlation_with_score", "SELECT * FROM pair_corr")
def corr_score(spark, sf):
    return _correlations(spark, sf, score=True).select(*_CORR)


@query("correlation_pivot", "SELECT device_id, variable_type, " + ", ".join(
    f"max(pearson_r) FILTER (WHERE vibration_feature = '{f}') AS {f}" for f in _FEATS) + f" {_NO_HS} GROUP BY 1, 2")
def corr_pivot(spark, sf):
    return correlation.correlation_pivot(_correlations(spark, sf), _FEATS)


@query("topk_correlations", f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY abs(pearson_r) DESC, variable_type, vibration_feature) AS INTEGER) AS rank
 {_NO_HS}) WHERE rank <= 6""")
def corr_top(spark, sf):
    return correlation.topk_correlations(_correlations(spark, sf)).select(*_CORR, "rank")


@query("correlation_strength", f"""
SELECT device_id, variable_type, vibration_feature, CASE WHEN abs(pearson_r) >= 0.6 THEN 'strong'
 WHEN abs(pearson_r) >= 0.3 THEN 'medium' ELSE 'weak' END AS strength {_NO_HS}""")
def strength(spark, sf):
    return _correlations(spark, sf).select(*_CORR[:3], labels.correlation_strength("pearson_r").alias("strength"))


@query("average_rank", """
SELECT row_id, rank() OVER (PARTITION BY device_id ORDER BY velRMS)
 + (count(*) OVER (PARTITION BY device_id, velRMS) - 1) / 2e0 AS avg_rank FROM vib""")
def ranks(spark, sf):
    rows = i.vib(spark, sf)
    table = quantiles.average_ranks(rows, ["device_id"], "velRMS", "avg_rank")
    return rows.join(table, ["device_id", "velRMS"]).select("row_id", "avg_rank")


# --- export and maintenance -------------------------------------------------

STEPS["exported"] = """
SELECT e.* RENAME (HealthScore AS health_score), e."電流" AS cur FROM exported_all e
WHERE CASE WHEN e."電流" IS NOT NULL THEN e."電流" > 1 ELSE Total_vRMS > 0.1 END"""
STEPS["in_range"] = """
SELECT s.device_id, m.event_ts, m.event_name, max(m.event_ts) OVER (PARTITION BY s.device_id) AS split_date
FROM (SELECT device_id, devicename, min(datetime) t0, max(datetime) t1 FROM exported GROUP BY 1, 2) s
JOIN maintenance m ON m.device_id = s.devicename WHERE m.event_ts BETWEEN t0 AND t1"""
STEPS["group_choice"] = """
SELECT device_id, CASE WHEN count("頻率") >= 10 THEN '頻率' WHEN count(cur) > 0 THEN 'current' END AS group_col
FROM exported GROUP BY 1"""
STEPS["group_rows"] = """
SELECT * FROM (SELECT e.*, c.group_col, CASE c.group_col WHEN '頻率' THEN e."頻率" WHEN 'current' THEN e.cur END AS g,
 CASE WHEN e.datetime < x.split_date THEN 'before' ELSE 'after' END AS period
FROM exported e JOIN group_choice c USING (device_id)
JOIN (SELECT DISTINCT device_id, split_date FROM in_range) x USING (device_id)) WHERE g IS NOT NULL"""
STEPS["effect_edges"] = """
SELECT device_id, list_sort(list_distinct(quantile_cont(g, [0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]))) AS e, count(*) AS n
FROM group_rows GROUP BY 1 HAVING count(*) >= 20"""
STEPS["effect_rows"] = """
SELECT *, CASE WHEN len(e) > 1 THEN e[b + 1] ELSE 0 END AS bin_left, CASE WHEN len(e) > 1 THEN e[b + 2] ELSE 0 END AS bin_right
FROM (SELECT r.*, x.e, CASE WHEN len(x.e) > 1 THEN len(list_filter(x.e[2:len(x.e) - 1], lambda v: v < r.g)) ELSE 0 END AS b
 FROM group_rows r JOIN effect_edges x USING (device_id))"""


def _sides(c, src=None):
    src = src or c
    m = "quantile_cont({s}, 0.5) FILTER (WHERE period = '{p}')"
    return m.format(s=src, p="before"), m.format(s=src, p="after")


def _effect_sql():
    out = []
    for c in DISPLAY_METRICS:
        a, b = _sides(c)
        out += [f"{r(a)} AS {c}_before", f"{r(b)} AS {c}_after",
                f"{r(f'({a} - {b}) / nullif({a}, 0) * 100', 4)} AS {c}_improve_pct"]
    a, b = _sides("current", "cur")
    gap = f"abs({a} - {b}) / nullif({a}, 0) * 100"
    out += [f"{r(a)} AS current_before", f"{r(b)} AS current_after", f"{r(gap, 4)} AS current_diff_pct",
            f"{gap} < 10 AS load_comparable"]
    a, b = _sides("health_score")
    out += [f"{r(a)} AS score_before", f"{r(b)} AS score_after", f"{r(f'{b} - {a}')} AS score_delta"]
    return f"""
SELECT device_id, CAST(b AS DOUBLE) AS effect_bin, {r('bin_left')} AS bin_left, {r('bin_right')} AS bin_right,
 count(*) FILTER (WHERE period = 'before') AS n_before, count(*) FILTER (WHERE period = 'after') AS n_after, {', '.join(out)}
FROM effect_rows GROUP BY device_id, b, bin_left, bin_right
HAVING count(*) FILTER (WHERE period = 'before') > 0 AND count(*) FILTER (WHERE period = 'after') > 0"""


def _exported(spark, sf):
    return maintenance_effect.export_rows(
        i.vib(spark, sf), i.telemetry(spark, sf), i.tag_dim(spark, sf), tolerance_s=i.TOLERANCE_S)


@query("export_rows", f"""
SELECT row_id, device_id, {r('Total_vRMS')} AS Total_vRMS, {r('cur')} AS "current", {r('"頻率"')} AS "頻率",
 {r('health_score')} AS health_score FROM exported""")
def exported(spark, sf):
    cols = ("Total_vRMS", "current", "頻率", "health_score")
    return rounded(_exported(spark, sf).select("row_id", "device_id", *cols), *cols)


@query("maintenance_in_range", "SELECT * FROM in_range")
def in_range(spark, sf):
    return maintenance.maintenance_in_range(_exported(spark, sf), i.maintenance(spark, sf))


@query("resolve_group_column", "SELECT * FROM group_choice")
def group_column(spark, sf):
    return maintenance.resolve_group_column(_exported(spark, sf), "current")


@query("effect_binning", f"""
SELECT row_id, CASE WHEN len(e) > 1 THEN 'quartile' ELSE 'single' END AS bin_method, CAST(b AS DOUBLE) AS effect_bin,
 {r('bin_left')} AS bin_left, {r('bin_right')} AS bin_right FROM effect_rows""")
def binned(spark, sf):
    rows = _exported(spark, sf)
    grouped = maintenance.with_group_value(rows, maintenance.resolve_group_column(rows, "current"))
    inside = maintenance.maintenance_in_range(rows, i.maintenance(spark, sf))
    df = maintenance.effect_binning(maintenance.label_period(grouped, inside))
    return rounded(df.select("row_id", "bin_method", "effect_bin", "bin_left", "bin_right"), "bin_left", "bin_right")


@query("maintenance_effect", _effect_sql())
def effect(spark, sf):
    df = maintenance_effect.maintenance_report(_exported(spark, sf), i.maintenance(spark, sf))
    pct = [c for c in df.columns if c.endswith("_pct")]
    six = [c for c, t in df.dtypes if t == "double" and c not in pct]
    return rounded(df, *six).select(*[F.round(c, 4).alias(c) if c in pct else F.col(c) for c in df.columns])


@query("alignment_coverage", f"""
SELECT device_id, count(*) AS n_rows, count("電流") AS n_aligned, {r('100e0 * count("電流") / count(*)', 4)} AS aligned_pct,
 max(datetime) FILTER (WHERE "電流" IS NOT NULL) AS last_aligned,
 max(datetime) FILTER (WHERE "電流" IS NOT NULL) < max(datetime) - INTERVAL 3 DAY AS ends_early
FROM exported_all GROUP BY 1 HAVING count("電流") > 0""")
def coverage(spark, sf):
    from queries.joins import spikeless_with_telemetry

    df = maintenance.alignment_coverage(spikeless_with_telemetry(spark, sf), "電流")
    return df.withColumn("aligned_pct", F.round("aligned_pct", 4))


_CMP = ", ".join(
    f"count({p}) AS {p}_n, {r(f'avg({p})', 5)} AS {p}_mean, {r(f'quantile_cont({p}, 0.5)', 5)} AS {p}_median, "
    f"{r(f'stddev_samp({p})', 5)} AS {p}_std" for p in ("before", "after"))
STEPS["cmp_rows"] = " UNION ALL ".join(
    f"""SELECT devicename, '{m}' AS metric, CASE WHEN datetime < TIMESTAMP '2024-01-18' THEN {m} END AS before,
 CASE WHEN datetime >= TIMESTAMP '2024-01-18' THEN {m} END AS after FROM vib""" for m in DISPLAY_METRICS)
STEPS["compared"] = f"""
SELECT devicename, metric, {_CMP}, {r('avg(after) - avg(before)', 5)} AS diff,
 {r('(avg(after) - avg(before)) / nullif(avg(before), 0) * 100', 1)} AS change_pct FROM cmp_rows GROUP BY 1, 2"""


def _compared(spark, sf):
    from rotorwatch.functions.times import ntz

    rows = i.vib(spark, sf).withColumn("period", labels.period_label("datetime", ntz("2024-01-18 00:00:00")))
    return stats.before_after_compare(rows, keys=["devicename"])


@query("before_after_compare", "SELECT * FROM compared")
def compare(spark, sf):
    return _compared(spark, sf)


@query("before_after_diff", """
SELECT devicename, metric, before_mean AS before, after_mean AS after, diff, change_pct FROM compared""")
def compare_short(spark, sf):
    return stats.before_after_diff(_compared(spark, sf), ["devicename"])


@query("describe_stats", " UNION ALL ".join(f"""
SELECT device_id, '{m}' AS metric, count({m}) AS count, {r(f'avg({m})', 4)} AS mean, {r(f'stddev_samp({m})', 4)} AS std,
 {r(f'min({m})', 4)} AS min, {r(f'quantile_cont({m}, 0.5)', 4)} AS median, {r(f'max({m})', 4)} AS max FROM vib GROUP BY 1"""
    for m in DISPLAY_METRICS))
def describe(spark, sf):
    return stats.describe_stats(i.vib(spark, sf), DISPLAY_METRICS)


def _fit_cols(x, y):
    return (f"count(*) AS n, {r(f'regr_slope({y}, {x})', 5)} AS slope, {r(f'regr_intercept({y}, {x})', 5)} AS intercept, "
            f"{r(f'corr({y}, {x})', 5)} AS r")


@query("trendline_by_group", " UNION ALL ".join(f"""
SELECT v.device_id, '{x}' AS x_name, '{y}' AS y_name,
 CASE WHEN m.split_date IS NULL THEN 'all' WHEN v.datetime < m.split_date THEN 'before' ELSE 'after' END AS period,
 {_fit_cols(x, y)}
FROM vib v LEFT JOIN (SELECT device_id, max(event_ts) AS split_date FROM maintenance
 WHERE event_ts < TIMESTAMP '2024-02-01' GROUP BY 1) m ON v.devicename = m.device_id
GROUP BY 1, 2, 3, 4""" for x in ("velRMS",) for y in ("accOA", "velOA")))
def lines(spark, sf):
    from rotorwatch.functions.times import ntz

    rows = i.vib(spark, sf)
    last = i.maintenance(spark, sf).where(F.col("event_ts") < ntz("2024-02-01 00:00:00")).groupBy(
        F.col("device_id").alias("devicename")).agg(F.max("event_ts").alias("split_date"))
    split = rows.select("device_id", "devicename").distinct().join(last, "devicename")
    df = stats.trendline_by_group(rows, ["velRMS"], ["accOA", "velOA"], split=split)
    return df.select(*[F.round(c, 5).alias(c) if c in ("slope", "intercept", "r") else F.col(c) for c in df.columns])


STEPS["half_base"] = """
SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY datetime, row_id) AS rn, count(*) OVER (PARTITION BY device_id) AS n
FROM (SELECT a.device_id, a.datetime, a.row_id, CASE WHEN m THEN current_A ELSE accOA END AS x,
  CASE WHEN m THEN 'current_A' ELSE 'accOA' END AS x_name, Total_vRMS AS y
 FROM aligned a JOIN (SELECT device_id, count(current_A) > 0 AS m FROM aligned GROUP BY 1) USING (device_id))
WHERE x IS NOT NULL AND y IS NOT NULL"""


@query("early_late_trendline", f"""
SELECT device_id, x_name, CASE WHEN rn <= n // 2 THEN 'early' ELSE 'late' END AS half, {_fit_cols('x', 'y')}
FROM half_base WHERE half_base.n >= 6 GROUP BY 1, 2, 3""")
def early_late(spark, sf):
    from queries.rows import aligned_raw

    df = stats.early_late_trendline(aligned_raw(spark, sf))
    return df.select(*[F.round(c, 5).alias(c) if c in ("slope", "intercept", "r") else F.col(c) for c in df.columns])
