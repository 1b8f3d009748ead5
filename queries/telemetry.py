"""Telemetry, counters, gaps and energy."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as i
from queries.registry import STEPS, query, r
from queries.rows import rounded
from rotorwatch.operators import energy, mapping, telemetry
from rotorwatch.plans import specific_power

_VARS = ("流量", "用電量", "運轉時數", "電流", "頻率")
_AVG = ", ".join(f'avg(value) FILTER (WHERE variable_type = \'{v}\') AS "{v}"' for v in _VARS)
STEPS["mapped"] = """
SELECT t.row_id, t.datetime, t.tagname, t.value, d.variable_type, d.device_id
FROM telemetry t JOIN tag_dim d ON t.tagname = d.tagname"""
STEPS["wide"] = f"SELECT device_id, datetime, {_AVG} FROM mapped WHERE value IS NOT NULL GROUP BY device_id, datetime"
STEPS["deltas"] = """
SELECT *, CASE WHEN value - lag(value) OVER w >= 0 THEN value - lag(value) OVER w END AS delta,
 coalesce(value - lag(value) OVER w < 0, false) AS is_reset
FROM counters WINDOW w AS (PARTITION BY tagname ORDER BY datetime, row_id)"""
STEPS["gaps"] = """
SELECT tagname, prev AS gap_start, datetime AS gap_end,
 CAST(round_even((epoch_us(datetime) - epoch_us(prev)) / 3600000000e0, 2) AS DOUBLE) AS gap_hours
FROM (SELECT *, lag(datetime) OVER (PARTITION BY tagname ORDER BY datetime, row_id) AS prev FROM counters)
WHERE (epoch_us(datetime) - epoch_us(prev)) / 60000000e0 > 6"""
STEPS["role_var"] = """
SELECT device_id, role, arg_min(variable_type, row_no) AS variable_type FROM (
 SELECT *, unnest([CASE WHEN regexp_matches(lower(variable_type), '用電量|度數|kwh|energy|電能') THEN 'kwh' END,
  CASE WHEN regexp_matches(lower(variable_type), '流量|flow|nm3|nm³|cmm') THEN 'flow' END,
  CASE WHEN regexp_matches(lower(variable_type), '運轉時數|運轉小時|runhour|runtime|run_hour|runhr') THEN 'run' END]) AS role
 FROM tag_dim) WHERE role IS NOT NULL GROUP BY ALL"""
STEPS["first_tag"] = """
SELECT device_id, variable_type, arg_min(tagname, row_no) AS tagname, count(*) AS n_tags, count(*) > 1 AS ambiguous
FROM tag_dim GROUP BY ALL"""
STEPS["role_tag"] = """
SELECT v.device_id, v.role, f.tagname FROM role_var v JOIN first_tag f USING (device_id, variable_type)
WHERE v.device_id IN (SELECT device_id FROM role_var WHERE role IN ('kwh','flow') GROUP BY 1 HAVING count(*) = 2)"""
STEPS["tag_daily"] = """
SELECT tagname, CAST(datetime AS DATE) AS date, sum(delta) AS total FROM deltas GROUP BY ALL"""
STEPS["energy_days"] = """
SELECT t.device_id, d.date, max(total) FILTER (WHERE role = 'kwh') AS kwh_sum,
 max(total) FILTER (WHERE role = 'flow') AS flow_sum, max(total) FILTER (WHERE role = 'run') AS running_hours
FROM tag_daily d JOIN role_tag t USING (tagname) GROUP BY ALL"""
STEPS["power_days"] = "SELECT *, flow_sum / nullif(kwh_sum, 0) AS specific_power FROM energy_days"
STEPS["energy_cut"] = """
SELECT s.device_id, max(m.event_ts) AS split_date
FROM (SELECT device_id, min(date) AS d0, max(date) AS d1 FROM power_days GROUP BY 1) s
JOIN maintenance m USING (device_id) WHERE m.event_ts BETWEEN d0 AND d1 GROUP BY 1"""
STEPS["energy_cmp"] = """
SELECT device_id, count(*) FILTER (WHERE pre) AS n_pre, count(*) FILTER (WHERE NOT pre) AS n_post,
 quantile_cont(specific_power, 0.5) FILTER (WHERE pre) AS sp_pre,
 quantile_cont(specific_power, 0.5) FILTER (WHERE NOT pre) AS sp_post,
 quantile_cont(running_hours, 0.5) FILTER (WHERE pre) AS runhr_pre,
 quantile_cont(running_hours, 0.5) FILTER (WHERE NOT pre) AS runhr_post,
 coalesce(sum(flow_sum) FILTER (WHERE NOT pre), 0) AS flow_post,
 coalesce(sum(kwh_sum) FILTER (WHERE NOT pre), 0) AS kwh_post
FROM (SELECT p.*, CAST(p.date AS TIMESTAMP) < c.split_date AS pre FROM power_days p JOIN energy_cut c USING (device_id))
GROUP BY 1"""


@query("map_tags", "SELECT row_id, tagname, device_id, variable_type FROM mapped")
def map_tags(spark, sf):
    df = telemetry.map_tags(i.telemetry(spark, sf), i.tag_dim(spark, sf))
    return df.select("row_id", "tagname", "device_id", "variable_type")


@query("pivot_scada", f"""
SELECT device_id, datetime, {', '.join(f'{r(chr(34) + v + chr(34))} AS "{v}"' for v in _VARS)} FROM wide""")
def pivot(spark, sf):
    df = telemetry.pivot_scada(i.telemetry(spark, sf), i.tag_dim(spark, sf), list(_VARS))
    return rounded(df, *_VARS)


@query("counter_delta", f"SELECT row_id, tagname, {r('delta')} AS delta FROM deltas")
def delta(spark, sf):
    df = telemetry.counter_delta(i.counters(spark, sf))
    return rounded(df.select("row_id", "tagname", "delta"), "delta")


@query("counter_resets", """
SELECT tagname, count(*) AS n_rows, count(*) FILTER (WHERE is_reset) AS n_resets FROM deltas GROUP BY 1""")
def resets(spark, sf):
    return telemetry.counter_resets(i.counters(spark, sf))


@query("counter_daily_sum", f"SELECT tagname, date, {r('total')} AS total FROM tag_daily")
def daily(spark, sf):
    return rounded(telemetry.counter_daily_sum(i.counters(spark, sf)), "total")


@query("detect_gaps", "SELECT * FROM gaps")
def gaps(spark, sf):
    return telemetry.detect_gaps(i.counters(spark, sf))


@query("topk_gaps", """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tagname ORDER BY gap_hours DESC, gap_start) AS INTEGER) AS rank
 FROM gaps) WHERE rank <= 20""")
def top_gaps(spark, sf):
    return telemetry.topk_gaps(telemetry.detect_gaps(i.counters(spark, sf)), "tagname", 20)


@query("energy_gaps", """
SELECT t.device_id, t.role AS tag, g.gap_start, g.gap_end, g.gap_hours FROM gaps g JOIN role_tag t USING (tagname)""")
def used_gaps(spark, sf):
    return specific_power.energy_gaps(i.counters(spark, sf), i.tag_dim(spark, sf))


@query("distinct_tags_count", """
SELECT 'telemetry_tags' AS source, count(*) AS n_rows, count(DISTINCT tagname) AS n_names FROM telemetry
UNION ALL SELECT 'mapped_tags', count(*), count(DISTINCT tagname) FROM tag_dim
UNION ALL SELECT 'mapped_devices', count(*), count(DISTINCT device_id) FROM tag_dim""")
def counts(spark, sf):
    return telemetry.tag_counts(i.telemetry(spark, sf), i.tag_dim(spark, sf))


@query("resolve_variable_by_keyword", "SELECT * FROM role_var")
def by_keyword(spark, sf):
    return energy.resolve_variable_by_keyword(i.tag_dim(spark, sf))


@query("first_tag_for_variable", "SELECT * FROM first_tag")
def first_tag(spark, sf):
    return energy.first_tag_for_variable(i.tag_dim(spark, sf))


@query("outer_join_daily", f"""
SELECT device_id, date, {r('kwh_sum')} AS kwh_sum, {r('flow_sum')} AS flow_sum, {r('running_hours')} AS running_hours
FROM energy_days""")
def outer_daily(spark, sf):
    df = energy.outer_join_daily(i.counters(spark, sf), energy.role_tags(i.tag_dim(spark, sf)))
    return rounded(df, "kwh_sum", "flow_sum", "running_hours")


def _power(spark, sf):
    return energy.daily_specific_power(
        energy.outer_join_daily(i.counters(spark, sf), energy.role_tags(i.tag_dim(spark, sf))))


@query("daily_specific_power", f"""
SELECT device_id, date, {r('kwh_sum')} AS kwh_sum, {r('flow_sum')} AS flow_sum,
 {r('running_hours')} AS running_hours, {r('specific_power')} AS specific_power FROM power_days""")
def power(spark, sf):
    return rounded(_power(spark, sf), "kwh_sum", "flow_sum", "running_hours", "specific_power")


@query("missing_days", """
SELECT device_id, count(*) AS n_days, count(*) FILTER (WHERE kwh_sum IS NULL) AS n_missing_kwh,
 count(*) FILTER (WHERE flow_sum IS NULL) AS n_missing_flow FROM power_days GROUP BY 1""")
def missing(spark, sf):
    return energy.missing_days(_power(spark, sf))


@query("energy_before_after", f"""
SELECT device_id, n_pre, n_post, {r('sp_pre')} AS sp_pre, {r('sp_post')} AS sp_post,
 {r('runhr_pre')} AS runhr_pre, {r('runhr_post')} AS runhr_post,
 {r('(sp_post - sp_pre) / nullif(sp_pre, 0) * 100')} AS improve_pct,
 {r('CASE WHEN n_post > 0 AND sp_pre > 0 THEN flow_post / sp_pre - kwh_post END', 4)} AS kwh_saved,
 {r('CASE WHEN n_post > 0 AND sp_pre > 0 THEN (flow_post / sp_pre - kwh_post) * 3.5e0 END', 4)} AS cost_saved
FROM energy_cmp""")
def energy_cmp(spark, sf):
    report = specific_power.energy_report(
        i.counters(spark, sf), i.tag_dim(spark, sf), i.maintenance(spark, sf), price=3.5)
    df = rounded(report.comparison, "sp_pre", "sp_post", "runhr_pre", "runhr_post", "improve_pct")
    return df.withColumn("kwh_saved", F.round("kwh_saved", 4)).withColumn("cost_saved", F.round("cost_saved", 4))


@query("run_hours_confound", f"""
SELECT device_id, {r('runhr_pre')} AS runhr_pre, {r('runhr_post')} AS runhr_post,
 {r('abs(runhr_pre - runhr_post)')} AS runhr_diff, abs(runhr_pre - runhr_post) > 1 AS confounded
FROM energy_cmp WHERE runhr_pre IS NOT NULL AND runhr_post IS NOT NULL""")
def confound(spark, sf):
    report = specific_power.energy_report(
        i.counters(spark, sf), i.tag_dim(spark, sf), i.maintenance(spark, sf))
    return rounded(energy.run_hours_confound(report.comparison), "runhr_pre", "runhr_post", "runhr_diff")


@query("union_dates", """
SELECT DISTINCT t.device_id, d.date FROM tag_daily d JOIN role_tag t USING (tagname)""")
def dates(spark, sf):
    used = i.counters(spark, sf).drop("device_id").join(energy.role_tags(i.tag_dim(spark, sf)), "tagname")
    daily_rows = telemetry.counter_daily_sum(used, ("device_id", "role", "tagname"))
    return energy.union_dates(*[daily_rows.where(F.col("role") == x) for x in energy.ROLES])


@query("semi_join_tags", "SELECT row_id, tagname FROM telemetry WHERE tagname IN (SELECT tagname FROM tag_dim)")
def semi(spark, sf):
    df = mapping.semi_join_tags(i.telemetry(spark, sf), i.tag_dim(spark, sf))
    return df.select("row_id", "tagname")


_DIFF = """
SELECT tagname, 'mapped_not_seen' AS problem FROM (SELECT tagname FROM tag_dim EXCEPT SELECT tagname FROM seen_tags)
UNION ALL
SELECT tagname, 'seen_not_mapped' FROM (SELECT tagname FROM seen_tags EXCEPT SELECT tagname FROM tag_dim)"""
STEPS["seen_tags"] = "SELECT tagname FROM telemetry UNION ALL SELECT tagname FROM counters"


def _seen(spark, sf):
    return i.telemetry(spark, sf).unionByName(i.counters(spark, sf))


@query("anti_join_tags", _DIFF)
def anti(spark, sf):
    return mapping.anti_join_tags(_seen(spark, sf), i.tag_dim(spark, sf))


@query("except_tags", _DIFF)
def excepts(spark, sf):
    return mapping.except_tags(_seen(spark, sf), i.tag_dim(spark, sf))


@query("union_files", """
SELECT row_id, datetime, tagname, value, CAST(NULL AS VARCHAR) AS unit FROM telemetry
UNION ALL SELECT row_id, datetime, tagname, value, 'cents' FROM counters""")
def union_files(spark, sf):
    a = i.telemetry(spark, sf).drop("device_id")
    b = i.counters(spark, sf).drop("device_id").withColumn("unit", F.lit("cents"))
    return a.unionByName(b, allowMissingColumns=True)


