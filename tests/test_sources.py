import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotorwatch.sources import columns, readers, sinks


def write(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def test_encodings_and_headers_mix(spark, tmp_path):
    d = tmp_path / "in"
    write(d, "a.csv", "名稱,x\n電流,1\n", "utf-8-sig")
    write(d, "b.csv", "名稱,y\n頻率,2\n", "cp950")
    write(d, "c.csv", "x,y\né,3\n", "latin1")
    got = {(r["名稱"], r.x, r.y) for r in readers.read_csv_multi_encoding(spark, str(d)).collect()}
    assert got == {("電流", "1", None), ("頻率", None, "2"), (None, "é", "3")}
    assert len(readers.catalogue(spark, str(d)).layouts) == 3


def test_thousands_of_files_bring_their_layouts_to_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    d = tmp_path / "in"
    heads = (("datetime,tagname,value", "utf-8"), ("值,Tag,DateTime", "cp950"), ("é,value,time,tag", "latin1"))
    for k in range(5000):
        head, enc = heads[k % 3]
        row = dict(datetime=f"2026-01-01 00:{k % 60:02d}", value=str(k), tagname=f"t{k % 7}")
        row |= {"DateTime": row["datetime"], "time": row["datetime"], "值": "電", "é": "è", "Tag": "x", "tag": "y"}
        write(d, f"{k}.csv", head + "\n" + ",".join(row[h] for h in head.split(",")) + "\n", enc)
    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    files = readers.catalogue(spark, str(d))
    assert [len(x) for x in collected] == [3] and len(files.layouts) == 3 and files.catalogue.count() == 5000
    df = readers.load_current(spark, str(d))
    assert [len(x) for x in collected] == [3, 3]
    got = df.groupBy("tagname").count().toPandas().set_index("tagname")["count"]
    assert got.sum() == 3333 and got["y"] == 1666 and df.agg(F.sum("value")).first()[0] == sum(k for k in range(5000) if k % 3 != 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" csv") == 1  # one scan for all layouts


def test_cells_of_lines(spark, tmp_path):
    """Quotes, separators within quotes, short and long lines, blank lines, a header that occurs again."""
    d = write(tmp_path / "in", "a.csv", 'a,b,c\n"x, y","say ""hi""",\n1\n1,2,3,4\n\n  ,"", z\na,b,c\n')
    got = [tuple(r) for r in readers.read_csv_multi_encoding(spark, d).collect()]
    plain = [tuple(r) for r in spark.read.schema("a string, b string, c string").option("header", "true").csv(d).collect()]
    assert sorted(got, key=str) == sorted(plain, key=str) and len(got) == 5


def test_mapping_rows_follow_files_and_lines(spark, tmp_path):
    d = tmp_path / "tags"
    write(d, "1.csv", "unit,tagname,variable_type,device_id\nA,t1,freq,Z\nA,t2,freq,Z\n")
    write(d, "0.csv", "tagname,variable_type,device_id\nt0,freq,Z\n" + "t9,freq,Z\n" * 50)
    write(d, "2.csv", "tagname,variable_type,device_id\nt3,freq,Z\n")
    got = [r.tagname for r in readers.load_tag_mapping(spark, str(d)).orderBy("row_no").collect()]
    assert got == ["t0"] + ["t9"] * 50 + ["t1", "t2", "t3"]


def test_vibration_files(spark, tmp_path):
    d = tmp_path / "vib"
    head = "Date,accOA,velRMS_x,velRMS_y,velRMS_z,velPEAK,velRMS,Health_Score\n"
    write(d, "冰水_ZP1_2_M1_Analytics_202601.csv", head + "2026/1/15 08:00:00,0.45,0.82,1.12,0.67,2.31,1.23,88\n")
    write(d, "ZP1_2_m1_analytics_b.csv", head + "2026/1/15  08:10:00 ,bad,0.85,1.15,0.69,2.38,1.26,\nnonsense,1,1,1,1,1,1,1\n")
    write(d, "other.csv", head + "2026/1/15 08:00:00,1,1,1,1,1,1,1\n")
    write(d, "ZP9_M2_Analytics.csv", "when,accOA\n2026/1/15 08:00:00,1\n")
    got = readers.load_vibration(spark, str(d)).orderBy("datetime").collect()
    assert [(r.device_id, r.devicename, r.position) for r in got] == [("ZP1_2_M1", "ZP1_2", "M1")] * 2
    assert (got[0].accOA, got[1].accOA, got[0].HealthScore, got[1].HealthScore) == (0.45, None, 88.0, None)
    assert got[1].datetime == pd.Timestamp("2026-01-15 08:10:00")


@pytest.mark.parametrize("header", ["datetime,tagname,value", "Timestamp,TAG,Reading", "time,Sensor,Current"])
def test_long_tables(spark, tmp_path, header):
    d = write(tmp_path / "long", "x.csv", header + "\n2026/1/15 08:00:00,T1,12.4\n2026/1/15 08:01,T1,oops\n,T1,3\n")
    got = readers.load_other_data(spark, d).orderBy("datetime").collect()
    assert [(r.tagname, r.value) for r in got] == [("T1", 12.4), ("T1", None)]


def test_files_without_tag_or_value_are_skipped(spark, tmp_path):
    d = write(tmp_path / "cur", "a.csv", "date,name,num\n2026/1/1,x,1\n")
    assert readers.load_current(spark, d).count() == 0
    write(tmp_path / "cur", "b.csv", "date,my_tag_no,interval\n2026/1/1,x,1\n")
    assert [(r.tagname, r.value) for r in readers.load_current(spark, d).collect()] == [("x", 1.0)]


def test_device_mapping(spark, tmp_path):
    d = write(tmp_path / "m", "m.csv", " tagname ,devicename,machine_id,model_group,train_start\nT,Z,Z,G,2026/3/1\nT2,Z2,Z2,G,\n")
    got = readers.load_device_mapping(spark, d).orderBy("tagname").collect()
    assert got[0].train_start == pd.Timestamp("2026-03-01") and got[1].train_start is None and got[0].train_end is None
    bad = write(tmp_path / "bad", "m.csv", "tagname,devicename\nT,Z\n")
    with pytest.raises(ValueError, match="machine_id"):
        readers.load_device_mapping(spark, bad)


def test_tag_mapping_and_log(spark, tmp_path):
    d = write(tmp_path / "t", "t.csv", "TagName,Variable Type,device-id\n T1 ,頻率, Z \n")
    got = readers.load_tag_mapping(spark, d).first()
    assert (got.tagname, got.variable_type, got.device_id, got.unit) == ("T1", "頻率", "Z", "")
    assert readers.load_tag_mapping(spark, write(tmp_path / "u", "t.csv", "a,b\n1,2\n")).count() == 0
    d = write(tmp_path / "log", "l.csv", "Device_ID,date,event_name\nZ,2026-03-15,換油\nZ,bad,x\nZ,2026/4/2,\n")
    got = readers.load_maintenance_log(spark, d).orderBy("event_ts").collect()
    assert [(r.event_ts, r.event_name) for r in got] == [(pd.Timestamp("2026-03-15"), "換油"), (pd.Timestamp("2026-04-02"), "保養")]


def test_metrics(spark, tmp_path):
    d = write(tmp_path / "a", "m.csv", "velRMS,velOA,accRMS,accOA,more\n1,2,3,4,5\n1,x,3,4,5\n")
    df = readers.load_metrics(spark, d)
    assert tuple(readers.metrics_audit(df).first()) == (2, 1)
    with pytest.raises(ValueError, match="accOA"):
        readers.load_metrics(spark, write(tmp_path / "b", "m.csv", "velRMS,velOA,accRMS\n1,2,3\n"))


def test_timestamps(spark):
    texts = ["2026/1/5 8:00:00", " 2026-01-05  08:00 ", "2026-01-05", "2026-01-05T08:00:00", "2026/01/05 08:00:00.250",
             "1999/1/1", "", "32/13/2026", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", columns.parse_timestamp("t").alias("datetime"))
    got = [r.datetime for r in rows.orderBy("k").collect()]
    day = pd.Timestamp("2026-01-05")
    eight = day + pd.Timedelta(hours=8)
    assert got == [eight, eight, day, eight, eight + pd.Timedelta(milliseconds=250), pd.Timestamp("1999-01-01"), None, None, None]
    assert tuple(columns.timestamp_audit(rows).first()) == (3, 1)


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), ("",), (None,), (" 2 ",)], "t string")
    assert [r.v for r in df.select(columns.number("t").alias("v")).collect()] == [1.5, None, None, None, None, 2.0]


def test_partitioned_csv_round_trip(spark, make, frame, tmp_path):
    df = make(frame(accOA=[1.0, 2.5]))
    path = str(tmp_path / "out")
    sinks.write_table(df, path, "csv", by="device_id", bom=True)
    part = next((tmp_path / "out" / "device_id=P1_M1").glob("*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfdevicename,")
    back = readers.read_csv_multi_encoding(spark, path)
    assert back.columns[0] == "devicename" and back.count() == 2
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_table(df, path, "csv", by="device_id")


def test_timestamp_layouts(spark):
    import datetime as dt

    from rotorwatch.sources.columns import parse_timestamp

    at = dt.datetime
    want = {
        "2024-01-02 03:04:05.1234567": at(2024, 1, 2, 3, 4, 5, 123456), "2024/1/2 3:4:5.5": at(2024, 1, 2, 3, 4, 5, 500000),
        "2024-01-02T03:04:05Z": at(2024, 1, 2, 3, 4, 5), "2024-01-02 03:04:05.123456789+08:00": at(2024, 1, 2, 3, 4, 5, 123456),
        "20240102": at(2024, 1, 2), "2024-01-02 10:00 PM": at(2024, 1, 2, 22), "1/2/2024 12:30:00 am": at(2024, 1, 2, 0, 30),
        "2024-02-30": None, "13:00": None, "x": None, "2024-01-02 13:00 PM": None, "": None, "2024-1-2 3:4": at(2024, 1, 2, 3, 4),
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.t: r.x for r in rows.select("t", parse_timestamp("t").alias("x")).collect()}
        gap = spark.createDataFrame([("2024/03/10 02:30:00",)], "t string").select(parse_timestamp("t").cast("string")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want and gap == "2024-03-10 02:30:00"


def test_inputs_that_are_absent_empty_or_odd(spark, tmp_path):
    from rotorwatch.sources import readers

    absent, empty, odd = str(tmp_path / "no"), tmp_path / "empty", tmp_path / "odd"
    empty.mkdir()
    odd.mkdir()
    for path in (absent, str(empty)):
        assert readers.load_vibration(spark, path).count() == 0
        assert readers.load_current(spark, path).count() == 0
        assert readers.load_device_mapping(spark, path).columns[0] == "tagname"
        assert readers.load_tag_mapping(spark, path).count() == 0
        assert readers.load_maintenance_log(spark, path).count() == 0
    (odd / "a.csv").write_text("datetime,tagname,value\n2024-01-01,t,1\n")
    (odd / "b.CSV").write_text("datetime,tagname,value,Value\n2024-01-02,t,2,9\n")
    assert sorted(r.value for r in readers.load_current(spark, str(odd)).collect()) == [1.0, 2.0]


def test_load_report(spark, tmp_path):
    d = tmp_path / "in"
    write(d, "a.csv", "date,x\n2026/1/15,1\nsoon,2\n1999-01-01,3\n")
    write(d, "b.CSV", "x,y\n1,2\n")
    write(d, "c.csv", "date,z\n")
    got = {r.file[-5:]: tuple(r)[1:] for r in readers.load_report(spark, str(d)).collect()}
    assert got == {"a.csv": ("date", 3, 1, 1, ["soon"]), "b.CSV": (None, 1, 1, 0, []), "c.csv": ("date", 0, 0, 0, [])}
    assert readers.load_report(spark, str(tmp_path / "none")).count() == 0


def test_pattern_is_matched_once(spark):
    plan = spark.range(1).select(columns.parse_timestamp(F.lit("x").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("AM|PM") == 1


def test_texts_that_look_like_parts(spark):
    odd = ["\x01|2024|1|2|3|4|5|6|", "2024-01-02|", "\x01"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    assert [r.x for r in rows.select(columns.parse_timestamp("t").alias("x")).collect()] == [None, None, None]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_run_for_some_devices_leaves_the_others(spark, make, frame, tmp_path, fmt):
    path, read = str(tmp_path / "scores"), lambda: sorted(
        (r.device_id, float(r.health_score)) for r in spark.read.option("header", "true").format(fmt).load(path).collect())
    both = pd.concat([frame(device=d, health_score=[s, s + 1]) for d, s in (("P1_M1", 10.0), ("P2_M1", 20.0))])
    sinks.sink_scores(make(both), path, fmt)
    again = make(frame(device="P1_M1", health_score=[70.0]))
    for _ in range(2):
        sinks.sink_scores(again, path, fmt)
        assert read() == [("P1_M1", 70.0), ("P2_M1", 20.0), ("P2_M1", 21.0)]
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.sink_scores(again, path, fmt, mode="errorifexists")


def test_every_table_by_device_is_replaced_by_device(spark, make, tmp_path):
    rows = lambda *d: make(pd.DataFrame({"device_id": d, "x": 1.0, "pearson_raw": 0.5, "spearman_raw": 0.5}))
    for name, sink in (("c", sinks.sink_candidates), ("r", sinks.sink_correlation), ("e", sinks.sink_export)):
        path = str(tmp_path / name)
        sink(rows("a", "a", "b"), path)
        sink(rows("a"), path)
        assert sorted(r.device_id for r in sinks.read_table(spark, path).collect()) == ["a", "b"]
    path = str(tmp_path / "energy")
    sinks.sink_energy(rows("a", "b"), rows("b"), path)
    sinks.sink_energy(rows("b"), rows("b", "b"), path)
    assert sinks.read_table(spark, f"{path}/daily").count() == 2 and sinks.read_table(spark, f"{path}/gaps").count() == 2


def test_a_table_without_rows_is_read_back(spark, make, tmp_path):
    """Counters that report all the time have no gap."""
    days, path = make(pd.DataFrame({"device_id": ["a"], "x": [1.0]})), str(tmp_path / "energy")
    sinks.sink_energy(days, days.where("x > 1"), path)
    gaps = sinks.read_table(spark, f"{path}/gaps", days.schema)
    assert gaps.columns == ["device_id", "x"] and gaps.count() == 0
    assert [tuple(r) for r in sinks.read_table(spark, f"{path}/daily", days.schema).select("device_id", "x").collect()] == [("a", 1.0)]


def test_energy_of_counters_without_gaps(spark, tmp_path):
    from queries.files import energy

    spark.sql("""
        SELECT id AS event_id, timestampadd(MINUTE, id, timestamp_ntz'2024-01-01 00:00:00') AS ts, t * 3L AS user_id,
         CASE t WHEN 0 THEN 'error' WHEN 1 THEN 'purchase' ELSE 'signup' END AS event_type, 1.0D AS value
        FROM (SELECT id, explode(array(0, 1, 2)) AS t FROM range(3000))""").write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.part, r.device_id, r.n_rows) for r in energy(spark, str(tmp_path)).collect()] == [("daily", "ZP1_0", 3)]


def test_models_are_published_as_a_whole(spark, tmp_path):
    path, model = str(tmp_path / "model"), lambda k: spark.range(k).select("id", F.lit(k).alias("k"))
    with pytest.raises(FileNotFoundError):
        sinks.load_model(spark, path)
    assert sinks.save_model(model(3), path) == 1
    broken = model(5).withColumn("k", F.when(F.col("id") == 4, F.raise_error(F.lit("fails half-way"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="half-way"):
        sinks.save_model(broken, path)
    assert sinks.model_versions(spark, path) == [1] and sinks.load_model(spark, path).count() == 3
    assert not [f for f in (tmp_path / "model").iterdir() if f.name.startswith("_writing")]
    # Load, change and save on one path; the loaded table stays readable.
    first = sinks.load_model(spark, path)
    assert sinks.save_model(first.where("id > 0"), path) == 2
    assert (first.count(), sinks.load_model(spark, path).count(), sinks.load_model(spark, path, 1).count()) == (3, 2, 3)
    (tmp_path / "model" / "_writing-of-a-lost-job").mkdir()
    assert sinks.save_model(model(7), path, keep=2) == 3
    assert sinks.model_versions(spark, path) == [2, 3] and sinks.load_model(spark, path).count() == 7


def test_two_writers_get_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "model")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: sinks.save_model(spark.range(k), path), [1, 2, 3, 4]))
    assert sorted(numbers) == [1, 2, 3, 4] and sorted(sinks.load_model(spark, path, n).count() for n in numbers) == [1, 2, 3, 4]
