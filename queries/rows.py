"""Row-level rules: derived columns, filters, labels, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as i
from queries.registry import STEPS, query, r
from rotorwatch.functions import scoring
from rotorwatch.operators import clean, fleet, mapping, series, stats

STEPS["derived"] = """
SELECT *, sqrt(velRMS_x*velRMS_x + velRMS_y*velRMS_y + velRMS_z*velRMS_z) AS Total_vRMS,
 velPEAK / (velRMS + 1e-6) AS Crest_Factor FROM vib"""
STEPS["spikeless"] = "SELECT * FROM derived WHERE Crest_Factor <= 20"
STEPS["cur_rows"] = """
SELECT v.*, d.tagname AS cur_tag FROM spikeless v LEFT JOIN device_dim d ON v.devicename = d.devicename"""
# Two one-sided as-of joins; the nearer side wins, the earlier one on a tie.
STEPS["aligned"] = """
SELECT a.* EXCLUDE (cur_tag, bt, bv, ft, fv), CASE
  WHEN bt IS NOT NULL AND epoch_us(a.datetime) - epoch_us(bt) <= 1800000000
   AND (ft IS NULL OR epoch_us(a.datetime) - epoch_us(bt) <= epoch_us(ft) - epoch_us(a.datetime)) THEN bv
  WHEN ft IS NOT NULL AND epoch_us(ft) - epoch_us(a.datetime) <= 1800000000 THEN fv END AS current_A
FROM (
 SELECT l.*, b.datetime AS bt, b.value AS bv, f.datetime AS ft, f.value AS fv
 FROM cur_rows l
 ASOF LEFT JOIN telemetry b ON l.cur_tag = b.tagname AND l.datetime >= b.datetime
 ASOF LEFT JOIN telemetry f ON l.cur_tag = f.tagname AND l.datetime <= f.datetime
) a"""
STEPS["running"] = """
SELECT a.* FROM aligned a
LEFT JOIN (SELECT device_id, count(current_A) > 0 AS metered FROM aligned GROUP BY device_id) m USING (device_id)
WHERE CASE WHEN metered THEN current_A > 1 ELSE Total_vRMS > 0.1 END"""


def rolling(cols, table, before, after):
    win = (f"OVER (PARTITION BY device_id ORDER BY datetime, row_id "
           f"ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)")
    inner = ", ".join(f"quantile_cont({c}, 0.5) {win} AS m_{c}" for c in cols)
    part = "OVER (PARTITION BY device_id ORDER BY datetime, row_id"
    filled = ", ".join(
        f"coalesce(m_{c}, last_value(m_{c} IGNORE NULLS) {part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" first_value(m_{c} IGNORE NULLS) {part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in cols
    )
    drop = ", ".join([*cols, *[f"m_{c}" for c in cols]])
    return f"SELECT * EXCLUDE ({drop}), {filled} FROM (SELECT *, {inner} FROM {table})"


_FEATURES = ("Total_vRMS", "accOA", "Crest_Factor")
STEPS["cleaned"] = rolling(_FEATURES, "running", 1, 1)


def aligned_raw(spark, sf):
    rows = clean.filter_spikes(clean.derive_features(i.vib(spark, sf)))
    return mapping.asof_current(rows, i.telemetry(spark, sf), i.device_dim(spark, sf), i.TOLERANCE_S)


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("derive_features", f"""
SELECT row_id, device_id, {r('Total_vRMS')} AS Total_vRMS, {r('Crest_Factor')} AS Crest_Factor FROM derived""")
def derive(spark, sf):
    df = clean.derive_features(i.vib(spark, sf)).select("row_id", "device_id", "Total_vRMS", "Crest_Factor")
    return rounded(df, "Total_vRMS", "Crest_Factor")


@query("filter_spikes", f"SELECT row_id, device_id, {r('Crest_Factor')} AS Crest_Factor FROM spikeless")
def spikes(spark, sf):
    df = clean.filter_spikes(clean.derive_features(i.vib(spark, sf)))
    return rounded(df.select("row_id", "device_id", "Crest_Factor"), "Crest_Factor")


@query("filter_running", f"SELECT row_id, device_id, {r('current_A')} AS current_A FROM running")
def running(spark, sf):
    df = clean.filter_running(aligned_raw(spark, sf))
    return rounded(df.select("row_id", "device_id", "current_A"), "current_A")


@query("filter_running_hybrid", f"""
SELECT row_id, device_id, {r('current_A')} AS current_A FROM aligned
WHERE CASE WHEN current_A IS NOT NULL THEN current_A > 5 ELSE Total_vRMS > 0.1 END""")
def hybrid(spark, sf):
    df = clean.filter_running_hybrid(aligned_raw(spark, sf), "current_A", threshold=5.0)
    return rounded(df.select("row_id", "device_id", "current_A"), "current_A")


@query("clean_vibration", f"""
SELECT row_id, device_id, {', '.join(f'{r(c)} AS {c}' for c in _FEATURES)} FROM cleaned""")
def cleaned(spark, sf):
    df = clean.clean_vibration(aligned_raw(spark, sf))
    return rounded(df.select("row_id", "device_id", *_FEATURES), *_FEATURES)


@query("filter_valid_scores", f"""
SELECT device_id, count(*) FILTER (WHERE HealthScore IS NOT NULL AND HealthScore <> 0) AS n_valid,
 count(*) FILTER (WHERE HealthScore IS NULL OR HealthScore = 0) AS n_excluded,
 {r("100e0 * count(*) FILTER (WHERE HealthScore IS NULL OR HealthScore = 0) / count(*)", 1)} AS excluded_pct
FROM vib GROUP BY device_id""")
def valid_scores(spark, sf):
    rows = i.vib(spark, sf)
    totals = rows.groupBy("device_id").agg(F.count("*").alias("n"))
    valid = fleet.filter_valid_scores(rows).groupBy("device_id").agg(F.count("*").alias("n_valid"))
    left_out = F.col("n") - F.col("n_valid")
    return totals.join(valid, "device_id").select(
        "device_id", "n_valid", left_out.alias("n_excluded"),
        F.round(100.0 * left_out / F.col("n"), 1).alias("excluded_pct"),
    )


@query("position_label", """
SELECT DISTINCT device_id, CASE position WHEN 'M1' THEN '自由端 (Free End)' WHEN 'M2' THEN '驅動端 (Drive End)'
 ELSE position END AS label FROM vib""")
def label(spark, sf):
    return i.vib(spark, sf).select("device_id", scoring.position_label("position").alias("label")).distinct()


@query("alert_level", """
SELECT row_id, CASE WHEN HealthScore IS NULL THEN 'Unknown' WHEN HealthScore >= 80 THEN 'Normal'
 WHEN HealthScore >= 60 THEN 'Warning' ELSE 'Critical' END AS alert_level FROM vib""")
def alerts(spark, sf):
    return i.vib(spark, sf).select("row_id", scoring.alert_level("HealthScore").alias("alert_level"))


@query("score_transform", f"""
SELECT row_id, {r('least(100e0, greatest(0e0, 100e0 * exp(-0.5e0 * accOA)))')} AS score FROM vib""")
def transform(spark, sf):
    s = scoring.score_from_distance("accOA", F.lit(0.5))
    return i.vib(spark, sf).select("row_id", F.round(s, 6).alias("score"))


@query("normalize_time", f"""
SELECT row_id, {r('''CAST(epoch_us(v.datetime) - epoch_us(t0) AS DOUBLE)
 / CASE WHEN t1 = t0 THEN 1000000 ELSE epoch_us(t1) - epoch_us(t0) END''')} AS time_norm
FROM vib v JOIN (SELECT device_id, min(datetime) t0, max(datetime) t1 FROM vib GROUP BY 1) b USING (device_id)""")
def norm_time(spark, sf):
    df = stats.normalize_time(i.vib(spark, sf)).select("row_id", "time_norm")
    return rounded(df, "time_norm")


@query("parse_timestamps", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
 WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS datetime FROM events""")
def parse(spark, sf):
    from rotorwatch.sources.columns import parse_timestamp

    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "' 'yyyy-MM-dd'  'HH:mm:ss' '"))
        .when(kind == 2, F.date_format("ts", "yyyy/M/d HH:mm"))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("bad "), "event_type"))
    )
    return i.events(spark, sf).select("event_id", parse_timestamp(text).alias("datetime"))


@query("timestamp_audit", """
SELECT event_type, count(*) FILTER (WHERE event_id % 5 = 4) AS n_unparsed,
 count(*) FILTER (WHERE event_id % 5 = 3) AS n_odd_year FROM events GROUP BY event_type""")
def audit(spark, sf):
    from rotorwatch.sources.columns import parse_timestamp, timestamp_audit

    kind = F.col("event_id") % 5
    text = F.when(kind == 3, F.date_format("ts", "'1999'/MM/dd")).when(kind == 4, F.lit("--")).otherwise(
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    )
    rows = i.events(spark, sf).select("event_type", parse_timestamp(text).alias("datetime"))
    return timestamp_audit(rows, ["event_type"])


@query("parse_device_filename", r"""
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'ZP' || (user_id % 5) || '_' || (user_id % 3) END AS devicename,
 CASE WHEN event_id % 4 <> 3 THEN CASE WHEN event_id % 2 = 0 THEN 'M1' ELSE 'M2' END END AS position,
 CASE WHEN event_id % 4 <> 3 THEN 'ZP' || (user_id % 5) || '_' || (user_id % 3)
   || CASE WHEN event_id % 2 = 0 THEN '_M1' ELSE '_M2' END END AS device_id FROM events""")
def filename(spark, sf):
    from rotorwatch.sources.columns import device_from_path

    side = F.when(F.col("event_id") % 2 == 0, "m1").otherwise("M2")
    stem = F.format_string("ZP%d_%d", F.col("user_id") % 5, F.col("user_id") % 3)
    name = F.when(F.col("event_id") % 4 == 3, F.concat(stem, F.lit("_raw.csv"))).otherwise(
        F.concat(F.when(F.col("event_id") % 4 == 1, "冰水_").otherwise(""), stem, F.lit("_"), side,
                 F.lit("_Analytics_202401.csv"))
    )
    return i.events(spark, sf).select("event_id", *device_from_path(F.concat(F.lit("/data/in/"), name)))


@query("rolling_median_smooth", f"SELECT row_id, device_id, {r('HealthScore')} AS smooth FROM ({rolling(('HealthScore',), 'vib', 1, 1)})")
def smooth3(spark, sf):
    df = series.rolling_median(i.vib(spark, sf).select("device_id", "datetime", "row_id", "HealthScore"),
                               ["device_id"], ["HealthScore"], 3)
    return df.select("row_id", "device_id", F.round("HealthScore", 6).alias("smooth"))


@query("score_smooth", f"SELECT row_id, device_id, {r('HealthScore')} AS smooth FROM ({rolling(('HealthScore',), 'vib', 2, 2)})")
def smooth5(spark, sf):
    df = series.rolling_median(i.vib(spark, sf).select("device_id", "datetime", "row_id", "HealthScore"),
                               ["device_id"], ["HealthScore"], 5)
    return df.select("row_id", "device_id", F.round("HealthScore", 6).alias("smooth"))


@query("forward_backward_fill", f"""
SELECT row_id, device_id, {r('''coalesce(
 last_value(HealthScore IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY datetime, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(HealthScore IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY datetime, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS filled
FROM vib""")
def fill(spark, sf):
    df = series.fill_gaps(i.vib(spark, sf).select("device_id", "datetime", "row_id", "HealthScore"),
                          ["device_id"], ["HealthScore"])
    return df.select("row_id", "device_id", F.round("HealthScore", 6).alias("filled"))


@query("assign_load_bin", """
SELECT row_id, CAST(CASE WHEN velRMS < 0.9 OR velRMS > 1.3 THEN 0 WHEN velRMS <= 1.02 THEN 0
 WHEN velRMS <= 1.17 THEN 1 ELSE 2 END AS INTEGER) AS load_bin FROM vib""")
def bins(spark, sf):
    edges = F.array(*[F.lit(x) for x in (0.9, 1.02, 1.17, 1.3)])
    return i.vib(spark, sf).select("row_id", scoring.load_bin("velRMS", edges).alias("load_bin"))


@query("label_period", """
SELECT row_id, CASE WHEN v.datetime < m.split_date THEN 'before' ELSE 'after' END AS period
FROM vib v JOIN (SELECT device_id, max(event_ts) AS split_date FROM maintenance GROUP BY 1) m
 ON v.devicename = m.device_id""")
def period(spark, sf):
    split = i.maintenance(spark, sf).groupBy(F.col("device_id").alias("devicename")).agg(
        F.max("event_ts").alias("split_date"))
    return i.vib(spark, sf).join(split, "devicename").select(
        "row_id", scoring.period_label("datetime", "split_date").alias("period"))
