"""Readers and writers: each query writes files derived from the tables, reads
them back through the library and returns what came out."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import inputs as i
from queries.registry import query, r
from queries.reports import _correlations, _exported
from queries.rows import rounded
from queries.stages import scoring
from rotorwatch.config import DISPLAY_METRICS
from rotorwatch.operators import fleet, model, stats
from rotorwatch.plans import specific_power, validation
from rotorwatch.session import scratch_path
from rotorwatch.sources import readers, sinks

_STAMP = "yyyy/M/d HH:mm:ss.SSSSSS"


def _csv(df, path, **options):
    w = df.write.option("header", "true")
    for k, v in options.items():
        w = w.option(k, v)
    w.csv(path)


def _text_time(df):
    return df.withColumn("datetime", F.date_format("datetime", _STAMP)).withColumnRenamed("datetime", "Date Time")


@query("read_csv_multi_encoding", """
SELECT row_id, 'utf8' AS part, '電流 ' || device_id AS label FROM vib WHERE position = 'M1'
UNION ALL SELECT row_id, 'cp950', '頻率 ' || device_id FROM vib WHERE position = 'M2'
UNION ALL SELECT row_id, 'latin1', '°é§ ' || device_id FROM telemetry""")
def encodings(spark, sf):
    path = scratch_path(spark, "encodings")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows, tele = i.vib(spark, sf), i.telemetry(spark, sf)
    for name, enc, df, text in (
        ("utf8", "UTF-8", rows.where("position = 'M1'"), "電流 "),
        ("cp950", "x-windows-950", rows.where("position = 'M2'"), "頻率 "),
        ("latin1", "ISO-8859-1", tele, "°é§ "),
    ):
        out = df.select("row_id", F.lit(name).alias("part"), F.concat(F.lit(text), "device_id").alias("label"))
        _csv(out, f"{path}/{name}", encoding=enc)
    got = readers.read_csv_multi_encoding(spark, path)
    return got.select(F.col("row_id").cast("long"), "part", "label")


@query("load_vibration", f"""
SELECT datetime, devicename, position, device_id, {r('accOA')} AS accOA, {r('velPEAK')} AS velPEAK,
 {r('HealthScore')} AS HealthScore FROM vib""")
def vibration(spark, sf):
    path = scratch_path(spark, "vibration")
    rows = i.vib(spark, sf)
    file = F.concat(F.lit("冰水_"), "device_id", F.lit("_Analytics_202401"))
    out = _text_time(rows.drop("devicename", "position", "row_id")).withColumn("file", file).drop("device_id")
    out.write.partitionBy("file").option("header", "true").csv(path)
    df = readers.load_vibration(spark, path)
    cols = ("accOA", "velPEAK", "HealthScore")
    return rounded(df.select("datetime", "devicename", "position", "device_id", *cols), *cols)


@query("load_report", """
SELECT CASE event_id % 5 WHEN 0 THEN 'slashes' WHEN 1 THEN 'zone' WHEN 2 THEN 'compact' WHEN 3 THEN 'broken' ELSE 'untimed' END AS part,
 event_id % 5 <> 4 AS has_time, count(*) AS n_rows,
 count(*) FILTER (WHERE event_id % 5 = 4 OR (event_id % 5 = 3 AND user_id % 2 = 0)) AS n_unparsed,
 count(*) FILTER (WHERE event_id % 5 = 3 AND user_id % 2 <> 0) AS n_odd_year
FROM events GROUP BY 1, 2""")
def report(spark, sf):
    path = scratch_path(spark, "report")
    kind, stamp = F.col("event_id") % 5, "yyyy-MM-dd HH:mm:ss"
    layouts = {
        "slashes": F.date_format("ts", "yyyy/M/d HH:mm"), "zone": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'"),
        "compact": F.date_format("ts", "yyyyMMdd"),
        "broken": F.when(F.col("user_id") % 2 == 0, F.lit("soon")).otherwise(F.date_format("ts", "'1999'-MM-dd HH:mm")),
        "untimed": F.date_format("ts", stamp),
    }
    for k, (name, text) in enumerate(layouts.items()):
        header = "when" if name == "untimed" else "Date Time"
        _csv(i.events(spark, sf).where(kind == k).select(text.alias(header), "value"), f"{path}/{name}")
    part = F.element_at(F.split("file", "/"), -2)
    return readers.load_report(spark, path).groupBy(part.alias("part"), F.col("time_column").isNotNull().alias("has_time")).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_unparsed", "n_odd_year")])


def _long(spark, sf, tag, value):
    path = scratch_path(spark, "long")
    rows = _text_time(i.telemetry(spark, sf))
    bad = F.when(F.col("row_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string"))
    _csv(rows.select("Date Time", F.col("tagname").alias(tag), bad.alias(value)), path)
    return path


_LONG_SQL = f"SELECT datetime, tagname, {r('CASE WHEN row_id % 10 <> 0 THEN value END')} AS value FROM telemetry"


@query("load_current", _LONG_SQL)
def current(spark, sf):
    df = readers.load_current(spark, _long(spark, sf, "My TagId", "Eval"))
    return rounded(df.drop("row_id"), "value")


@query("load_other_data", _LONG_SQL)
def other(spark, sf):
    df = readers.load_other_data(spark, _long(spark, sf, "Sensor", "Current"))
    return rounded(df.drop("row_id"), "value")


@query("load_device_mapping", "SELECT tagname, devicename, machine_id, model_group, train_start, train_end FROM device_dim")
def device_mapping(spark, sf):
    path = scratch_path(spark, "devices")
    dates = {c: F.date_format(c, "yyyy/M/d") for c in ("train_start", "train_end")}
    _csv(i.device_dim(spark, sf).drop("row_no").withColumns(dates), path)
    return readers.load_device_mapping(spark, path).drop("row_no")


@query("load_tag_mapping", "SELECT tagname, variable_type, device_id, unit FROM tag_dim")
def tag_mapping(spark, sf):
    path = scratch_path(spark, "tags")
    dim = i.tag_dim(spark, sf)
    _csv(dim.select(F.concat(F.lit(" "), "tagname").alias("TagName"), F.col("variable_type").alias("Variable-Type"),
                    F.col("device_id").alias("Device ID"), F.col("unit").alias("UNIT")), path)
    return readers.load_tag_mapping(spark, path).drop("row_no")


@query("load_maintenance_log", """
SELECT device_id, event_ts, CASE WHEN event_name = '換油' THEN '保養' ELSE event_name END AS event_name FROM maintenance""")
def maintenance_log(spark, sf):
    path = scratch_path(spark, "log")
    name = F.when(F.col("event_name") != "換油", F.col("event_name"))
    _csv(i.maintenance(spark, sf).select(
        F.col("device_id").alias("Device"), F.date_format("event_ts", "yyyy/MM/dd").alias("日期"), name.alias("項目")), path)
    return readers.load_maintenance_log(spark, path)


@query("load_metrics", f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE row_id % 7 = 0) AS n_incomplete FROM vib""")
def metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    bad = F.when(F.col("row_id") % 7 == 0, "-").otherwise(F.col("velOA").cast("string"))
    _csv(i.vib(spark, sf).select(*[bad.alias(m) if m == "velOA" else F.col(m) for m in DISPLAY_METRICS]), path)
    return readers.metrics_audit(readers.load_metrics(spark, path))


@query("sink_scores", f"""
SELECT device_id, datetime, load_bin, {r('health_score', 4)} AS health_score, alert_level,
 {r('health_score_smooth', 4)} AS health_score_smooth FROM scored""")
def scores(spark, sf):
    path = scratch_path(spark, "scores")
    scored = scoring(spark, sf).scored
    sinks.sink_scores(scored, path, load_columns=("頻率",))
    df = sinks.read_table(spark, path, scored.schema)
    return df.select("device_id", "datetime", "load_bin", F.round("health_score", 4).alias("health_score"),
                     "alert_level", F.round("health_score_smooth", 4).alias("health_score_smooth"))


@query("sink_candidates", "SELECT device_id, rank, start_date, end_date, stability_score, n_rows FROM candidates")
def candidates(spark, sf):
    path = scratch_path(spark, "candidates")
    best = scoring(spark, sf).candidates
    sinks.sink_candidates(best, path)
    return sinks.read_table(spark, path, best.schema).select(
        "device_id", "rank", "start_date", "end_date", "stability_score", "n_rows")


@query("sink_device_summary", f"""
SELECT machine_id, min({r('latest', 1)}) AS overall_score, CAST(sum(data_count) AS BIGINT) AS data_count FROM records GROUP BY 1""")
def summary(spark, sf):
    path = scratch_path(spark, "summary")
    sinks.sink_device_summary(scoring(spark, sf).summary, path)
    df = readers.read_csv_multi_encoding(spark, path)
    return df.select("machine_id", F.col("overall_score").cast("double"), F.col("data_count").cast("long"))


@query("sink_validation", """
SELECT s.device_id, s.position, coalesce(n, 0) AS row_count, has_current
FROM (SELECT device_id, position, count(current_A) > 0 AS has_current FROM aligned GROUP BY ALL) s
LEFT JOIN (SELECT device_id, count(*) n FROM running GROUP BY 1) c USING (device_id)""")
def validated(spark, sf):
    path = scratch_path(spark, "validation")
    table = validation.validate_inputs(
        i.vib(spark, sf), i.telemetry(spark, sf), i.device_dim(spark, sf), i.TOLERANCE_S)
    sinks.sink_validation(table, path)
    df = readers.read_csv_multi_encoding(spark, path)
    return df.select("device_id", "position", F.col("row_count").cast("long"), F.col("has_current").cast("boolean"))


@query("sink_correlation", """
SELECT device_id, variable_type, vibration_feature, pearson_r, n_samples FROM pair_corr WHERE vibration_feature <> 'HealthScore'""")
def correlations(spark, sf):
    path = scratch_path(spark, "correlation")
    table = _correlations(spark, sf)
    sinks.sink_correlation(table, path)
    return sinks.read_table(spark, path, table.schema).select(
        "device_id", "variable_type", "vibration_feature", "pearson_r", "n_samples")


@query("sink_export", f"""
SELECT datetime, device_id, {r('cur')} AS "current", {r('health_score')} AS health_score FROM exported""")
def export(spark, sf):
    path = scratch_path(spark, "export")
    table = _exported(spark, sf)
    sinks.sink_export(table, path)
    cols = ("current", "health_score")
    return rounded(sinks.read_table(spark, path, table.schema).select("datetime", "device_id", *cols), *cols)


@query("sink_energy", f"""
SELECT 'daily' AS part, device_id, count(*) AS n_rows, {r('sum(flow_sum)', 4)} AS total FROM power_days GROUP BY 1, 2
UNION ALL SELECT 'gaps', t.device_id, count(*), {r('sum(gap_hours)', 4)} FROM gaps g JOIN role_tag t USING (tagname) GROUP BY 1, 2""")
def energy(spark, sf):
    path = scratch_path(spark, "energy")
    report = specific_power.energy_report(i.counters(spark, sf), i.tag_dim(spark, sf), i.maintenance(spark, sf))
    sinks.sink_energy(report.daily, report.gaps, path)
    parts = [
        sinks.read_table(spark, f"{path}/{p}", table.schema).groupBy(F.lit(p).alias("part"), "device_id").agg(
            F.count("*").alias("n_rows"), F.round(F.sum(c), 4).alias("total"))
        for p, table, c in (("daily", report.daily, "flow_sum"), ("gaps", report.gaps, "gap_hours"))
    ]
    return parts[0].unionByName(parts[1])


@query("sink_health_tables", """
SELECT 'all_devices_summary' AS part, count(*) AS n_rows FROM health_stats
UNION ALL SELECT 'all_devices_valid_scores', count(*) FROM valid
UNION ALL SELECT 'daily_per_device', count(*) FROM daily_scores
UNION ALL SELECT 'daily_fleet_average', count(DISTINCT date) FROM daily_scores""")
def health_tables(spark, sf):
    path = scratch_path(spark, "health")
    rows = i.vib(spark, sf)
    valid = fleet.filter_valid_scores(rows).select("device_id", "datetime", F.col("HealthScore").alias("score"))
    daily = fleet.daily_device_scores(rows)
    sinks.sink_health_tables(fleet.health_summary(rows), valid, daily, fleet.daily_fleet_average(daily), path)
    names = ("all_devices_summary", "all_devices_valid_scores", "daily_per_device", "daily_fleet_average")
    parts = [
        readers.read_csv_multi_encoding(spark, f"{path}/{n}").agg(F.lit(n).alias("part"), F.count("*").alias("n_rows"))
        for n in names
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("sink_before_after", "SELECT devicename, metric, before_mean, change_pct FROM compared")
def before_after(spark, sf):
    from queries.reports import _compared

    path = scratch_path(spark, "before-after")
    table = _compared(spark, sf)
    sinks.sink_before_after(table, stats.before_after_diff(table, ["devicename"]), path)
    df = readers.read_csv_multi_encoding(spark, f"{path}/summary")
    return df.select("devicename", "metric", *[F.col(c).cast("double") for c in ("before_mean", "change_pct")])


@query("model_table_save_load", f"""
SELECT row_id, {r('health_score', 4)} AS health_score FROM scored""")
def save_load(spark, sf):
    path = scratch_path(spark, "model")
    run = scoring(spark, sf)
    sinks.save_model(run.model, path)
    df = model.score_rows(run.rows, sinks.load_model(spark, path))
    return df.select("row_id", F.round("health_score", 4).alias("health_score"))
