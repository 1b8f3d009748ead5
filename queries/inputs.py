"""Machine data derived from the ``events`` table, once for Spark, once as SQL.

Six measuring points (three devices, two positions), current and frequency
telemetry, three kinds of counters, and the dimensions that belong to them.
Everything is a row-wise function of ``events``, so it grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.registry import STEPS
from rotorwatch.functions.times import ntz

TOLERANCE_S = 30 * 60

_VIB = """
event_id AS row_id, ts AS datetime,
'ZP1_' || CAST(user_id % 3 AS STRING) AS devicename,
CASE WHEN user_id % 2 = 0 THEN 'M1' ELSE 'M2' END AS position,
'ZP1_' || CAST(user_id % 3 AS STRING) || CASE WHEN user_id % 2 = 0 THEN '_M1' ELSE '_M2' END AS device_id,
5e-1 + (event_id % 11) * 5e-2 AS velRMS_x,
6e-1 + (event_id % 7) * 4e-2 AS velRMS_y,
4e-1 + (event_id % 5) * 3e-2 AS velRMS_z,
8e-1 + (event_id % 13) * 5e-2 AS velRMS,
9e-1 + (event_id % 17) * 5e-2 AS velOA,
(8e-1 + (event_id % 13) * 5e-2) * (2e0 + value * (1 + 4 * (user_id % 3) * (user_id % 3)) / 2.0007e2) AS velPEAK,
2e-1 + value / 4.0007e2 AS accRMS,
3e-1 + value * (1 + 4 * (user_id % 3) * (user_id % 3)) / 2.0003e3 + (event_id % 19) * 2e-3 AS accOA,
CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 0e0
 ELSE least(1e2, greatest(0e0, 9e1 - value / 1.0003e1 + ((user_id % 3) - 1) * day(ts) * 5e-1)) END AS HealthScore
"""

_TELEMETRY = """
event_id AS row_id, ts AS datetime, 'ZP1_' || CAST(user_id % 3 AS STRING) AS device_id,
CASE event_type WHEN 'signup' THEN 'CUR_' ELSE 'FREQ_' END || CAST(user_id % 3 AS STRING) AS tagname,
CASE event_type WHEN 'signup' THEN value / 1e1 ELSE 4e1 + (event_id % 4) * 5e0 END AS value
"""

# Counters run with the clock at one to three cents a second plus a little noise,
# wrap at 100000 cents, and so need no running sum over a whole tag.
_COUNTERS = """
event_id AS row_id, ts AS datetime, 'ZP1_' || CAST(user_id % 3 AS STRING) AS device_id,
CASE event_type WHEN 'error' THEN 'KWH_' WHEN 'purchase' THEN 'FLOW_' ELSE 'RUN_' END
 || CAST(user_id % 3 AS STRING) AS tagname,
((CAST({seconds} AS BIGINT) * (1 + user_id % 3) + CAST(floor(value) AS BIGINT)) % 100000) / 1e2 AS value
"""


def split_lines(columns: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _of_types(spark, sf_dir, types, columns):
    rows = events(spark, sf_dir).where(F.col("event_type").isin(*types))
    return rows.selectExpr(*split_lines(columns))


def vib(spark, sf_dir) -> DataFrame:
    return _of_types(spark, sf_dir, ("view", "click"), _VIB)


def telemetry(spark, sf_dir) -> DataFrame:
    return _of_types(spark, sf_dir, ("signup", "purchase"), _TELEMETRY)


def counters(spark, sf_dir) -> DataFrame:
    seconds = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
    return _of_types(spark, sf_dir, ("error", "purchase", "signup"), _COUNTERS.format(seconds=seconds))


_UNMAPPED = ("FREQ_2", "KWH_2", "FLOW_2", "RUN_1", "RUN_2")
_GHOST = ("GHOST_9", "電流", "ZP9_9", "A")
_KINDS = {
    "CUR": ("電流", "A", 1), "FREQ": ("頻率", "Hz", 2), "KWH": ("用電量", "kWh", 3),
    "FLOW": ("流量", "m3", 4), "RUN": ("運轉時數", "hr", 5),
}


def tag_dim(spark, sf_dir) -> DataFrame:
    """Tags that occur in the data, five of them left unmapped, plus one that
    never reports."""
    seen = telemetry(spark, sf_dir).select("tagname", "device_id").union(
        counters(spark, sf_dir).select("tagname", "device_id")
    ).distinct().where(~F.col("tagname").isin(*_UNMAPPED))
    kind = F.substring_index("tagname", "_", 1)

    def pick(i):
        return F.create_map(*[F.lit(x) for k, v in _KINDS.items() for x in (k, v[i])])[kind]

    known = seen.select(
        "tagname", pick(0).alias("variable_type"), "device_id", pick(1).alias("unit"),
        pick(2).cast("long").alias("row_no"),
    )
    ghost = seen.agg(F.count("*").alias("n")).select(
        *[F.lit(v).alias(c) for c, v in zip(("tagname", "variable_type", "device_id", "unit"), _GHOST)],
        F.lit(9).cast("long").alias("row_no"),
    )
    return known.unionByName(ghost)


def _device_numbers(spark, sf_dir):
    return events(spark, sf_dir).select((F.col("user_id") % 3).alias("k")).distinct()


def device_dim(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("ZP1_"), F.col("k").cast("string"))
    given = F.col("k") == 1
    return _device_numbers(spark, sf_dir).where("k < 2").select(
        F.concat(F.lit("CUR_"), F.col("k").cast("string")).alias("tagname"),
        name.alias("devicename"), name.alias("machine_id"), F.lit("Pump_A").alias("model_group"),
        F.when(given, ntz("2024-01-03 00:00:00")).alias("train_start"),
        F.when(given, ntz("2024-01-17 00:00:00")).alias("train_end"),
        F.col("k").alias("row_no"),
    )


_LOG = [
    (0, "ZP1_0", "2024-01-12 00:00:00", "換油"),
    (0, "ZP1_0", "2024-01-18 00:00:00", "保養"),
    (1, "ZP1_1", "2024-01-20 00:00:00", "換油"),
    (2, "ZP1_2", "2025-06-01 00:00:00", "保養"),
    (2, "ZP9_9", "2024-01-10 00:00:00", "換油"),
]


def maintenance(spark, sf_dir) -> DataFrame:
    lines = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), ntz(t).alias("t"), F.lit(n).alias("n"))
        for k, d, t, n in _LOG
    ])
    mine = F.filter(lines, lambda x: x["k"] == F.col("k"))
    return _device_numbers(spark, sf_dir).select(F.explode(mine).alias("x")).select(
        F.col("x.d").alias("device_id"), F.col("x.t").alias("event_ts"), F.col("x.n").alias("event_name")
    )


def _sql_log():
    return ", ".join(f"({k}, '{d}', TIMESTAMP '{t}', '{n}')" for k, d, t, n in _LOG)


def _sql_kinds():
    return ", ".join(f"('{k}', '{v}', '{u}', {n})" for k, (v, u, n) in _KINDS.items())


STEPS["vib"] = f"SELECT {_VIB.strip()} FROM events WHERE event_type IN ('view','click')"
STEPS["telemetry"] = f"SELECT {_TELEMETRY.strip()} FROM events WHERE event_type IN ('signup','purchase')"
STEPS["counters"] = (
    "SELECT " + _COUNTERS.format(
        seconds="((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000)"
    ).strip() + " FROM events WHERE event_type IN ('error','purchase','signup')"
)
STEPS["tag_dim"] = f"""
SELECT s.tagname, k.variable_type, s.device_id, k.unit, CAST(k.row_no AS BIGINT) AS row_no
FROM (SELECT tagname, device_id FROM telemetry UNION SELECT tagname, device_id FROM counters) s
JOIN (VALUES {_sql_kinds()}) k(kind, variable_type, unit, row_no) ON split_part(s.tagname, '_', 1) = k.kind
WHERE s.tagname NOT IN {_UNMAPPED}
UNION ALL SELECT 'GHOST_9', '電流', 'ZP9_9', 'A', 9"""
STEPS["device_dim"] = """
SELECT 'CUR_' || k AS tagname, 'ZP1_' || k AS devicename, 'ZP1_' || k AS machine_id, 'Pump_A' AS model_group,
 CASE WHEN k = 1 THEN TIMESTAMP '2024-01-03' END AS train_start,
 CASE WHEN k = 1 THEN TIMESTAMP '2024-01-17' END AS train_end, k AS row_no
FROM (SELECT DISTINCT user_id % 3 AS k FROM events) WHERE k < 2"""
STEPS["maintenance"] = f"""
SELECT l.device_id, l.event_ts, l.event_name
FROM (SELECT DISTINCT user_id % 3 AS k FROM events) e
JOIN (VALUES {_sql_log()}) l(k, device_id, event_ts, event_name) ON e.k = l.k"""
