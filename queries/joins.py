"""Dimension joins, as-of joins and mapping checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as i
from queries.registry import STEPS, query, r
from queries.rows import aligned_raw, rounded
from queries.telemetry import _VARS
from rotorwatch.operators import clean, maintenance, mapping, telemetry
from rotorwatch.plans import health_scoring, validation



def asof_wide_sql(table):
    """Nearest telemetry timestamp of the device, all variables together."""
    v = ", ".join(
        f'CASE WHEN useb THEN b_{n} WHEN usef THEN f_{n} END AS "{v}"' for n, v in enumerate(_VARS))
    b = ", ".join(f'b."{v}" AS b_{n}, f."{v}" AS f_{n}' for n, v in enumerate(_VARS))
    drop = ", ".join(f"b_{n}, f_{n}" for n in range(len(_VARS)))
    return f"""
SELECT * EXCLUDE (bt, ft, useb, usef, {drop}), {v} FROM (
 SELECT *, coalesce(epoch_us(datetime) - epoch_us(bt) <= 1800000000
   AND (ft IS NULL OR epoch_us(datetime) - epoch_us(bt) <= epoch_us(ft) - epoch_us(datetime)), false) AS useb,
  coalesce(epoch_us(ft) - epoch_us(datetime) <= 1800000000, false) AS usef
 FROM (SELECT l.*, b.datetime AS bt, f.datetime AS ft, {b} FROM {table} l
  ASOF LEFT JOIN wide b ON l.devicename = b.device_id AND l.datetime >= b.datetime
  ASOF LEFT JOIN wide f ON l.devicename = f.device_id AND l.datetime <= f.datetime))"""


STEPS["exported_all"] = asof_wide_sql("spikeless")
STEPS["merged"] = asof_wide_sql("cleaned")


def spikeless_with_telemetry(spark, sf):
    rows = clean.filter_spikes(clean.derive_features(i.vib(spark, sf)))
    wide = telemetry.pivot_scada(i.telemetry(spark, sf), i.tag_dim(spark, sf), list(_VARS))
    return mapping.asof_scada_wide(rows, wide, i.TOLERANCE_S)


@query("asof_current", f"SELECT row_id, device_id, {r('current_A')} AS current_A FROM aligned")
def asof_current(spark, sf):
    return rounded(aligned_raw(spark, sf).select("row_id", "device_id", "current_A"), "current_A")


@query("asof_scada_wide", f"""
SELECT row_id, device_id, {', '.join(f'{r(chr(34) + v + chr(34))} AS "{v}"' for v in _VARS)} FROM exported_all""")
def asof_wide(spark, sf):
    df = spikeless_with_telemetry(spark, sf)
    return rounded(df.select("row_id", "device_id", *_VARS), *_VARS)


@query("align_with_diagnostics", """
SELECT s.device_id, t.tagname, CASE WHEN t.tagname IS NULL THEN 'not_mapped' WHEN c0 IS NULL THEN 'tag_absent'
 WHEN v1 < c0 OR c1 < v0 THEN 'no_overlap' ELSE 'aligned' END AS status, s.n_rows,
 count(a.current_A) AS n_aligned
FROM (SELECT device_id, devicename, min(datetime) v0, max(datetime) v1, count(*) n_rows FROM spikeless GROUP BY 1, 2) s
LEFT JOIN device_dim t ON s.devicename = t.devicename
LEFT JOIN (SELECT tagname, min(datetime) c0, max(datetime) c1 FROM telemetry GROUP BY 1) c ON t.tagname = c.tagname
LEFT JOIN aligned a ON a.device_id = s.device_id
GROUP BY s.device_id, t.tagname, status, s.n_rows""")
def diagnosed(spark, sf):
    rows = clean.filter_spikes(clean.derive_features(i.vib(spark, sf)))
    aligned, status = mapping.align_with_diagnostics(
        rows, i.telemetry(spark, sf), i.device_dim(spark, sf), i.TOLERANCE_S)
    n = aligned.groupBy("device_id").agg(
        F.count("*").alias("n_rows"), F.count("current_A").alias("n_aligned"))
    return status.join(n, "device_id")


@query("time_overlap_check", """
SELECT a.devicename, a_start, a_end, b_start, b_end, a_start <= b_end AND b_start <= a_end AS overlap
FROM (SELECT devicename, min(datetime) a_start, max(datetime) a_end FROM vib GROUP BY 1) a
JOIN (SELECT device_id AS devicename, min(datetime) b_start, max(datetime) b_end FROM telemetry GROUP BY 1) b
USING (devicename)""")
def overlap(spark, sf):
    tele = i.telemetry(spark, sf).withColumnRenamed("device_id", "devicename")
    return mapping.time_overlap_check(i.vib(spark, sf), tele, "devicename")


@query("map_devices", """
SELECT v.row_id, v.devicename, d.tagname, coalesce(d.machine_id, v.devicename) AS machine_id,
 coalesce(d.model_group, '') AS model_group FROM vib v LEFT JOIN device_dim d ON v.devicename = d.devicename""")
def map_devices(spark, sf):
    df = mapping.map_devices(i.vib(spark, sf), i.device_dim(spark, sf))
    return df.select("row_id", "devicename", "tagname", "machine_id", "model_group")


@query("device_match_check", """
SELECT DISTINCT v.devicename, v.devicename IN (SELECT trim(device_id) FROM tag_dim) AS matched FROM vib v""")
def match(spark, sf):
    return mapping.device_match_check(i.vib(spark, sf), i.tag_dim(spark, sf))


@query("mapping_chain_check", """
SELECT s.device_id, c.n_tags IS NOT NULL AS in_mapping, c.n_tags, c.n_found, c.has_current,
 v0 <= s1 AND s0 <= v1 AS overlap
FROM (SELECT device_id, devicename, min(datetime) v0, max(datetime) v1 FROM vib GROUP BY 1, 2) s
LEFT JOIN (
 SELECT d.device_id, count(*) n_tags, count(t0) n_found,
  bool_or(regexp_matches(lower(variable_type), '電流|current|安培|amp')) AS has_current, min(t0) s0, max(t1) s1
 FROM tag_dim d LEFT JOIN (SELECT tagname, min(datetime) t0, max(datetime) t1 FROM telemetry GROUP BY 1) t USING (tagname)
 GROUP BY 1) c ON s.devicename = c.device_id""")
def chain(spark, sf):
    return mapping.mapping_chain_check(i.vib(spark, sf), i.telemetry(spark, sf), i.tag_dim(spark, sf))


@query("distinct_names", """
SELECT 'vibration' AS source, devicename AS name FROM vib UNION SELECT 'mapping', device_id FROM tag_dim""")
def names(spark, sf):
    return mapping.distinct_names(i.vib(spark, sf), i.tag_dim(spark, sf))


@query("resolve_current_column", """
SELECT device_id, arg_min(variable_type, (lvl, variable_type)) AS current_col FROM (
 SELECT *, CASE WHEN variable_type = '電流' THEN 0 WHEN contains(lower(variable_type), '電流') THEN 1
  WHEN contains(lower(variable_type), 'current') THEN 3 WHEN contains(lower(variable_type), '安培') THEN 4
  WHEN contains(lower(variable_type), 'amp') THEN 5 END AS lvl FROM tag_dim) WHERE lvl IS NOT NULL GROUP BY 1""")
def current_column(spark, sf):
    return maintenance.resolve_current_column(i.tag_dim(spark, sf))


@query("validation_summary", """
SELECT s.device_id, s.position, coalesce(n, 0) AS row_count, time_start, time_end, has_current,
 bool_or(s.position = 'M1') OVER (PARTITION BY s.devicename) AS has_m1,
 bool_or(s.position = 'M2') OVER (PARTITION BY s.devicename) AS has_m2, coalesce(n, 0) >= 10 AS passed
FROM (SELECT device_id, devicename, position, count(current_A) > 0 AS has_current FROM aligned GROUP BY ALL) s
LEFT JOIN (SELECT device_id, count(*) n, min(datetime) time_start, max(datetime) time_end FROM running GROUP BY 1) c
USING (device_id)""")
def validation_table(spark, sf):
    return validation.validate_inputs(
        i.vib(spark, sf), i.telemetry(spark, sf), i.device_dim(spark, sf), i.TOLERANCE_S)


@query("clean_with_telemetry", f"""
SELECT row_id, device_id, {r('accOA')} AS accOA, {r('current_A')} AS current_A,
 {', '.join(f'{r(chr(34) + v + chr(34))} AS "{v}"' for v in _VARS)} FROM merged""")
def clean_merged(spark, sf):
    df = health_scoring.clean_rows(
        i.vib(spark, sf), i.telemetry(spark, sf), i.device_dim(spark, sf), i.telemetry(spark, sf),
        i.tag_dim(spark, sf), i.TOLERANCE_S)
    cols = ("accOA", "current_A", *_VARS)
    return rounded(df.select("row_id", "device_id", *cols), *cols)
