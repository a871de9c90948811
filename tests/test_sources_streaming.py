import datetime as dt
import gzip
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope import vocabulary as V
from emberscope.operators.grid import GridSpec
from emberscope.plans.gold import gold_full
from emberscope.plans.medallion import Tables, build
from emberscope.plans.silver import silver_fires
from emberscope.sources import landing as L
from emberscope.sources import tables as S
from emberscope.sources.files import load_schema, schema_log, wider
from emberscope.streaming.ingest import EMPTY, INVALID, FileSource, ingest, ingest_all, publish_batch, rejected_table
from emberscope.streaming.scoring import drain, forecast_stream, scored_stream

HEADER = "latitude,longitude,acq_date,acq_time,confidence,frp"


@pytest.fixture
def schema(spark, request):
    name = f"s_{request.node.name.split('[')[0]}"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines))


def source(tmp_path, schema, fmt="csv", declared=V.FIRE_SCHEMA, **more):
    return FileSource(f"{tmp_path}/in", f"{schema}.t", f"{tmp_path}/checkpoint", f"{tmp_path}/schema", fmt, declared, **more)


def test_ingest_is_incremental_and_ignores_other_files(spark, tmp_path, schema):
    src = source(tmp_path, schema)
    put(src.path, "nasa_20200101.csv", HEADER, "-31.2,-64.4,2020-01-01,5,n,1.5")
    put(src.path, "nasa_20200106.csv", HEADER)
    put(src.path, "notes.txt", "not,a,detection")
    assert ingest(spark, src) == 1
    assert ingest(spark, src) == 0
    put(src.path, "nasa_20200111.csv", HEADER, "-31.2,-64.4,2020-01-11,45,h,2.5")
    assert ingest(spark, src) == 1
    rows = spark.read.table(src.table).collect()
    assert len(rows) == 2 and all(r.ingestion_timestamp and r.source_filename.endswith(".csv") for r in rows)
    batch = spark.read.schema(V.FIRE_SCHEMA).option("header", True).option("pathGlobFilter", "*.csv").csv(src.path)
    assert batch.exceptAll(spark.read.table(src.table).select(*V.FIRE_SCHEMA.fieldNames())).isEmpty()


def test_rows_of_many_batches_are_all_counted(spark, tmp_path, schema):
    src = source(tmp_path, schema, options={"maxFilesPerTrigger": "1"})
    for i in range(3):
        put(src.path, f"a{i}.csv", HEADER, *["-31.2,-64.4,2020-01-01,5,n,1.5"] * (i + 1))
    key = "spark.sql.streaming.numRecentProgressUpdates"
    kept = spark.conf.get(key)
    try:
        assert ingest(spark, src) == 6
        spark.conf.set(key, "1")
        put(src.path, "b.csv", HEADER, "-31.2,-64.4,2020-01-02,5,n,1.5")
        put(src.path, "c.csv", HEADER, "-31.2,-64.4,2020-01-02,5,n,1.5")
        assert ingest(spark, src) == 2
    finally:
        spark.conf.set(key, kept)


def test_csv_rescue_keeps_the_raw_line(spark, tmp_path, schema):
    src = source(tmp_path, schema)
    put(src.path, "a.csv", HEADER, "-31.2,-64.4,2020-01-01,5,n,1.5", "-31.3,-64.4,2020-01-01,late,n,1.5", "-31.4,-64.4,2020-01-01,7,n,1.5,extra")
    ingest(spark, src)
    got = {r.latitude: (r.acq_time, r.frp, r["_rescued_data"]) for r in spark.read.table(src.table).collect()}
    assert got["-31.2"] == (5, 1.5, None)
    assert got["-31.3"] == (None, 1.5, "-31.3,-64.4,2020-01-01,late,n,1.5")
    assert got["-31.4"] == (7, 1.5, "-31.4,-64.4,2020-01-01,7,n,1.5,extra")


def document(cell, **more):
    hourly = {"date": ["2020-01-01 00:00:00+00:00"], "temperature_2m": [21.5], **more.pop("hourly", {})}
    return json.dumps({"cell_id": cell, "request_latitude": -31.2, "request_longitude": -64.4, "elevation_val": 5.0, "hourly": hourly, **more}, indent=1)


def test_json_documents_and_rescue(spark, tmp_path, schema):
    src = source(tmp_path, schema, "json", V.WEATHER_SCHEMA)
    put(src.path, "weather_a.json", document("a"))
    put(src.path, "weather_b.json", document("b", owner="x", hourly={"cape": [1.0]}))
    put(src.path, "weather_c.json", "this is not JSON")
    assert ingest(spark, src) == 3
    rows = {r.source_filename.rsplit("/")[-1]: r for r in spark.read.table(src.table).collect()}
    assert rows["weather_a.json"]["_rescued_data"] is None and rows["weather_a.json"].hourly.temperature_2m == [21.5]
    assert json.loads(rows["weather_b.json"]["_rescued_data"]) == {"owner": "x", "hourly.cape": "[1.0]"}
    assert rows["weather_c.json"]["_rescued_data"] == "this is not JSON" and rows["weather_c.json"].cell_id is None


def test_schema_is_inferred_once_and_remembered(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=None)
    put(src.path, "a.csv", "id,day,x", "1,2020-01-01,0.5")
    ingest(spark, src)
    first = load_schema(spark, src.schema_path)
    assert [f.dataType for f in first] == [T.IntegerType(), T.DateType(), T.DoubleType()]
    put(src.path, "b.csv", "id,day,x", "2,2020-01-02,0.5,surplus")
    ingest(spark, src)
    assert load_schema(spark, src.schema_path) == first
    assert {(r.id, r["_rescued_data"]) for r in spark.read.table(src.table).collect()} == {(1, None), (2, "2,2020-01-02,0.5,surplus")}


def test_declared_columns_may_be_added_later(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=T.StructType.fromDDL("id int"), rescue=False)
    put(src.path, "a.csv", "id", "1")
    ingest(spark, src)
    put(src.path, "b.csv", "id,x", "2,0.5")
    ingest(spark, FileSource(**{**src.__dict__, "schema": T.StructType.fromDDL("id int, x double")}))
    assert {(r.id, r.x) for r in spark.read.table(src.table).collect()} == {(1, None), (2, 0.5)}


def test_one_failing_source_does_not_stop_the_others(spark, tmp_path, schema):
    good = source(tmp_path, schema)
    put(good.path, "a.csv", HEADER, "-31.2,-64.4,2020-01-01,5,n,1.5")
    bad = FileSource(f"{tmp_path}/nowhere", f"{schema}.bad", f"{tmp_path}/c2", f"{tmp_path}/s2", "csv", V.FIRE_SCHEMA)
    odd = FileSource(good.path, f"{schema}.odd", f"{tmp_path}/c3", f"{tmp_path}/s3", "xml", V.FIRE_SCHEMA)
    got = {r.table.split(".")[1]: (r.ok, r.rows, bool(r.error)) for r in ingest_all(spark, [bad, odd, good]).collect()}
    assert got == {"bad": (False, None, True), "odd": (False, None, True), "t": (True, 1, False)}


FULL = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight"
ROW = "-31.22,-64.41,330.5,0.39,0.36,2020-08-23,1805,N,VIIRS,h,2,290.1,9.5,D"


def test_columns_are_matched_by_header(spark, tmp_path, schema):
    src = source(tmp_path, schema)
    put(src.path, "a.csv", HEADER, "-31.2,-64.4,2020-01-01,5,n,1.5")
    put(src.path, "b.csv", "FRP,longitude,latitude,note,acq_time,acq_date,confidence", "2.5,-64.4,-31.2,hello,45,2020-01-02,h", "x,-64.4,-31.3,,46,2020-01-02,h")
    put(src.path, "c.csv", FULL, ROW)
    assert ingest(spark, src) == 4
    rows = {r.latitude: r for r in spark.read.table(src.table).filter("acq_date > '2020-01-01'").collect()}
    assert (rows["-31.2"].longitude, rows["-31.2"].frp, rows["-31.2"].confidence) == ("-64.4", 2.5, "h")
    assert json.loads(rows["-31.2"]["_rescued_data"]) == {"note": "hello"}
    assert rows["-31.3"].frp is None and rows["-31.3"]["_rescued_data"] == "x,-64.4,-31.3,,46,2020-01-02,h"
    assert (rows["-31.22"].confidence, rows["-31.22"].frp) == ("h", 9.5)
    assert json.loads(rows["-31.22"]["_rescued_data"])["satellite"] == "N"


def test_inferred_columns_are_matched_by_header(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=None)
    put(src.path, "a.csv", "a,b", "1,x")
    put(src.path, "b.csv", "b,a", "y,2")
    assert ingest(spark, src) == 2
    assert {(r.a, r.b, r["_rescued_data"]) for r in spark.read.table(src.table).collect()} == {(1, "x", None), (2, "y", None)}


def test_all_detection_columns_reach_silver_and_the_label(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=V.FIRE_SCHEMA_FULL)
    put(src.path, "a.csv", FULL, ROW)
    ingest(spark, src)
    fires = silver_fires(spark.read.table(src.table))
    r = fires.first()
    assert (r.satellite, r.bright_ti4, r.daynight, r.confidence, r.hora_join) == ("N", 330.5, "D", "h", 18) and r["_rescued_data"] is None
    weather = spark.createDataFrame([(-31.2, -64.4)], "latitude double, longitude double").select(
        "*", F.lit("c").alias("grid_id"), F.lit(1.0).alias("elevation"), F.timestamp_seconds(F.lit(1598205600)).alias("timestamp_clima"),
        F.to_date(F.lit("2020-08-23")).alias("fecha_join"), F.lit(18).alias("hora_join"), *[F.lit(1.0).alias(v) for v in V.CLIMATE_VARIABLES])
    assert (gold_full(weather, fires).first().target, gold_full(weather, fires).first().fire_intensity) == (1, 9.5)


def test_a_repeated_batch_counts_once(spark, schema):
    df = spark.range(10).withColumn("s", F.lit("a"))
    df.limit(0).write.saveAsTable(f"{schema}.t")
    for rows in (df, df.limit(4), df):
        publish_batch(rows, f"{schema}.t", "/checkpoint", 3)
    publish_batch(df, f"{schema}.t", "/checkpoint", 4)
    spark.catalog.refreshTable(f"{schema}.t")
    assert spark.read.table(f"{schema}.t").count() == 20


def test_files_come_in_bounded_batches(spark, tmp_path, schema):
    src = source(tmp_path, schema, options={"maxFilesPerTrigger": "2"})
    for i in range(5):
        put(src.path, f"{i}.csv", HEADER, f"-31.{i},-64.4,2020-01-01,5,n,1.5")
    assert ingest(spark, src) == 5 and spark.read.table(src.table).count() == 5
    assert len(os.listdir(f"{src.checkpoint}/offsets")) >= 3


def test_replace_after_a_crash_while_staging(spark, schema):
    name = f"{schema}.t"
    S.replace_table(spark.range(2), name)
    home = S.table_location(spark, name)
    spark.range(1).write.parquet(f"{home}__staging")  # files without a catalog entry
    S.replace_table(spark.range(7), name)
    assert S.read_table(spark, name).count() == 7
    spark.range(1).write.parquet(f"{home}_new__staging")  # of a first write that was cut short
    S.append_merging(spark.range(3), f"{name}_new")
    assert spark.read.table(f"{name}_new").count() == 3
    with pytest.raises(ValueError, match="staging"):
        S._clear_staging(spark, name)


def test_files_of_an_earlier_session_are_kept(spark, schema):
    """The default catalog is in memory: a new session finds files under the name of a table it does not know."""
    name = f"{schema}.t"
    home = S._home(spark, name)
    spark.range(5).write.parquet(home)
    S.append_merging(spark.range(3).withColumn("x", F.lit("new")), name)
    assert spark.read.table(name).count() == 8 and spark.read.table(name).filter("x = 'new'").count() == 3
    S.replace_table(S.read_table(spark, name).filter("x IS NULL"), name)
    assert S.read_table(spark, name).count() == 5
    spark.range(6).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(S._home(spark, f"{name}2"))
    assert S.read_table(spark, f"{name}2").filter("part = 1").count() == 3
    spark.range(4).write.parquet(S._home(spark, f"{name}3"))
    S.replace_table(spark.range(2), f"{name}3")
    assert S.read_table(spark, f"{name}3").count() == 2


def test_two_sessions_append_to_one_table(tmp_path):
    code = (
        "import sys; from emberscope.session import build_session; from emberscope.sources import tables as S\n"
        f"spark = build_session('two', 'local[1]', spark__sql__warehouse__dir='{tmp_path}/w', spark__ui__enabled='false', spark__driver__memory='1g')\n"
        "S.append_merging(spark.range(5), 'default.t'); print('rows', S.read_table(spark, 'default.t').count())"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = [subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300).stdout for _ in range(2)]
    assert ["rows 5" in said[0], "rows 10" in said[1]] == [True, True], said


@pytest.mark.parametrize("staged", [True, False])
def test_recovery_without_a_catalog(spark, schema, staged):
    name = f"{schema}.t"
    spark.range(2).write.parquet(S._home(spark, f"{name}__backup"))
    if staged:
        spark.range(7).write.parquet(S._home(spark, f"{name}__staging"))
    assert S.read_table(spark, name).count() == (7 if staged else 2)
    S.append_merging(spark.range(1), name)
    assert S.read_table(spark, name).count() == (8 if staged else 3)


ODD = ["x y.csv", "x%20y.csv", "x[1].csv", "x{1,2}.csv", "q?.csv", "st*r.csv", "a#b.csv", "über.csv"]


@pytest.mark.parametrize("header", ["true", "false"])
def test_files_of_any_name_are_read_once(spark, tmp_path, schema, header):
    src = source(tmp_path, schema, declared=T.StructType.fromDDL("a int, b int"), options={"header": header})
    head = ["a,b"] if header == "true" else []
    put(src.path, "plain.csv", *head, "0,0")
    assert ingest(spark, src) == 1
    for i, name in enumerate(ODD, 1):
        put(src.path, name, *head, f"{i},1")
    assert ingest(spark, src) == len(ODD) and ingest(spark, src) == 0
    assert sorted(r.a for r in spark.read.table(src.table).collect()) == list(range(len(ODD) + 1))


def test_exact_header_names_go_first(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=T.StructType.fromDDL("a int, b int"))
    put(src.path, "one.csv", "A,a,b", "1,2,3")
    put(src.path, "two.csv", "B,A", "4,5")
    put(src.path, "three.csv", "\ufeffa,b", "6,7")
    assert ingest(spark, src) == 3
    got = {(r.a, r.b, r["_rescued_data"]) for r in spark.read.table(src.table).collect()}
    assert got == {(2, 3, '{"A":"1"}'), (5, 4, None), (6, 7, None)}


def test_bad_files_are_set_aside(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=T.StructType.fromDDL("a int, b int"), options={"pathGlobFilter": "*.csv*"})
    put(src.path, "good.csv", "a,b", "1,2")
    put(src.path, "empty.csv")
    put(src.path, "blank.csv", "", "  ")
    put(src.path, "message.csv", "Invalid API call.")
    put(src.path, "worded.csv", "a,b", "3,4")
    lines = b"a,b\n" + b"".join(b"%d,%d\n" % (i, i * 7919 % 1_000_003) for i in range(100_000))
    with open(f"{src.path}/cut.csv.gz", "wb") as f:
        f.write(gzip.compress(lines)[:200_000])
    with open(f"{src.path}/whole.csv.gz", "wb") as f:
        f.write(gzip.compress(b"a,b\n5,6\n"))
    with open(f"{src.path}/noise.csv.gz", "wb") as f:
        f.write(b"this was never compressed")
    status = ingest_all(spark, [src]).first()
    assert (status.ok, status.rows, status.rejected) == (True, 3, 5)
    assert sorted(r.a for r in spark.read.table(src.table).collect()) == [1, 3, 5]
    why = {r.file.rsplit("/")[-1]: r.reason for r in spark.read.table(rejected_table(src.table)).collect()}
    assert (why["empty.csv"], why["blank.csv"], why["message.csv"]) == (EMPTY, EMPTY, INVALID)
    assert why["cut.csv.gz"].startswith("unreadable") and why["noise.csv.gz"].startswith("unreadable") and len(why) == 5
    put(src.path, "later.csv")  # nothing but a bad file
    put(src.path, "more.csv", "a,b", "7,8")
    assert ingest(spark, src) == 1 and spark.read.table(rejected_table(src.table)).count() == 6


def test_faults_that_are_not_of_a_file_stop_the_source(spark, tmp_path, schema, monkeypatch):
    src = source(tmp_path, schema, declared=T.StructType.fromDDL("a int"), options={"mode": "FAILFAST"}, rescue=False)
    put(src.path, "a.csv", "a", "1")

    def full(*_):
        raise OSError("no space left")

    with monkeypatch.context() as patch:
        patch.setattr("emberscope.streaming.ingest.publish_batch", full)
        assert not ingest_all(spark, [src]).first().ok
    assert not spark.catalog.tableExists(rejected_table(src.table))
    put(src.path, "b.csv", "a", "x")  # not to be read in this mode
    status = ingest_all(spark, [src]).first()
    assert (status.ok, status.rows, status.rejected) == (True, 1, 1)


def test_bad_documents_are_set_aside(spark, tmp_path, schema):
    src = source(tmp_path, schema, "json", V.WEATHER_SCHEMA)
    put(src.path, "weather [a].json", document("a"))
    put(src.path, "weather_b.json", "Invalid request")
    put(src.path, "weather_c.json")
    status = ingest_all(spark, [src]).first()
    assert (status.ok, status.rows, status.rejected) == (True, 1, 2)


def test_a_remembered_schema_grows_by_versions(spark, tmp_path, schema):
    src = source(tmp_path, schema, declared=None)
    put(src.path, "a.csv", "id,day", "1,2020-01-01")
    ingest(spark, src)
    put(src.path, "b.csv", "x,ID,id2", "5,2,7")
    put(src.path, "c.csv", "id,x", "3,0.5")
    ingest(spark, src)
    put(src.path, "d.csv", "id,x", "oops,1")
    ingest(spark, src)
    got = {(r.id, str(r.day), r.x, r.id2, r["_rescued_data"]) for r in spark.read.table(src.table).collect()}
    assert got == {(1, "2020-01-01", None, None, None), (2, "None", 5.0, 7, None), (3, "None", 0.5, None, None), (None, "None", 1.0, None, "oops,1")}
    log = {r.version: [f.name for f in T.StructType.fromJson(json.loads(r.schema))] for r in schema_log(spark, src.schema_path).collect()}
    assert log == {1: ["id", "day"], 2: ["id", "day", "x", "id2"]} or log == {1: ["id", "day"], 2: ["id", "day", "id2", "x"]}


def test_types_merge_in_any_order():
    kinds = [T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.StringType(), T.BooleanType()]
    for a in kinds:
        for b in kinds:
            assert wider(a, b) == wider(b, a)
            for c in kinds:
                assert wider(wider(a, b), c) == wider(a, wider(b, c)) or T.StringType() in (a, b, c, wider(wider(a, b), c), wider(a, wider(b, c)))
    assert wider(T.DateType(), T.TimestampType()) == T.TimestampType() and wider(T.IntegerType(), T.DateType()) == T.StringType()


def test_late_cells_and_earlier_hours_are_scored(spark, tmp_path):
    def lot(cell, days):
        return [(cell, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), float(h)) for h in range(24 * days)]

    for part in (lot("a", 10), lot("b", 10) + lot("a", 2)):
        spark.createDataFrame(part, "k string, ts timestamp, x double").write.mode("append").parquet(f"{tmp_path}/feed")
        feed = forecast_stream(spark, f"{tmp_path}/feed", "k string, ts timestamp, x double")
        drain(scored_stream(feed, ["k"], "ts", lambda d: d), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("k").count().collect() and spark.read.parquet(f"{tmp_path}/out").count() == 480


def test_replace_by_a_query_over_itself(spark, schema):
    name = f"{schema}.t"
    S.replace_table(spark.range(5), name)
    S.replace_table(S.read_table(spark, name).selectExpr("id * 2 AS twice", "'x' AS s"), name)
    assert {(r.twice, r.s) for r in S.read_table(spark, name).collect()} == {(i * 2, "x") for i in range(5)}
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


@pytest.mark.parametrize(
    ("tables", "outcome", "value"),
    [
        (["t__backup", "t__staging"], "finished swap", "t__staging"),
        (["t__backup"], "restored backup", "t__backup"),
        (["t__backup", "t"], "dropped backup", "t"),
        (["t", "t__staging"], "clean", "t"),
    ],
)
def test_recovery_from_every_crash(spark, schema, tables, outcome, value):
    for t in tables:
        spark.sql(f"CREATE TABLE {schema}.{t} USING parquet AS SELECT '{t}' AS v")
    assert S.recover(spark, f"{schema}.t") == outcome
    assert [r.v for r in S.read_table(spark, f"{schema}.t").collect()] == [value]
    S.replace_table(spark.range(1), f"{schema}.t")
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_append_merges_columns(spark, schema):
    name = f"{schema}.t"
    S.append_merging(spark.createDataFrame([(1, "a")], "id int, s string"), name)
    S.append_merging(spark.createDataFrame([(0.5, 2)], "x double, id int"), name)
    assert {tuple(r) for r in spark.read.table(name).collect()} == {(1, "a", None), (2, None, 0.5)}


def test_layout_keeps_rows_and_narrows_files(spark, tmp_path):
    df = spark.range(1600).selectExpr("id", "(id div 2) div 20 AS r", "(id div 2) % 20 AS c").repartition(5)
    path = f"{tmp_path}/z"
    S.layout_morton(df, F.col("r"), F.col("c"), 8).write.parquet(path)
    back = spark.read.parquet(path)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    spans = back.groupBy(F.input_file_name()).agg((F.max("r") - F.min("r")).alias("r"), (F.max("c") - F.min("c")).alias("c")).collect()
    assert len(spans) > 4 and sum((s.r + 1) * (s.c + 1) for s in spans) < 8 * 40 * 20 / 2


def test_layout_splits_one_hot_cell(spark):
    hot = spark.range(4000).selectExpr("id", "if(id % 3 = 0, id % 50, 7) AS r", "if(id % 3 = 0, id % 20, 7) AS c")
    sizes = [r["count"] for r in S.layout_morton(hot, F.col("r"), F.col("c"), 8).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 4000 / 4


def test_layouts_have_more_partitions_for_more_rows(spark, monkeypatch):
    """Each partition is sorted in one task, whose rows once grew with the table."""
    monkeypatch.setattr(S, "ROWS_PER_PARTITION", 500)
    df = spark.range(5000).selectExpr("id % 97 AS r", "id % 89 AS c", "id")
    for laid in (S.layout_morton(df, F.col("r"), F.col("c"), 4), S.layout_sorted(df, ["r", "id"], 4)):
        sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) < 1000
    assert S.layout_sorted(df.limit(10), ["r"], 4).rdd.getNumPartitions() == 4


def test_export_by_year(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.datetime(2020 + i % 3, 1, 1)) for i in range(9)], "id int, ts timestamp")
    S.export_by_year(df, "ts", f"{tmp_path}/x")
    assert sorted(d for d in os.listdir(f"{tmp_path}/x") if d.startswith("year")) == ["year=2020", "year=2021", "year=2022"]
    assert spark.read.parquet(f"{tmp_path}/x").filter("year = 2021").count() == 3


def test_date_chunks(spark):
    bounds = spark.sql("SELECT date'2020-01-01' AS a, date'2025-12-30' AS b")
    rows = L.date_chunks(bounds, "a", "b").collect()
    assert len(rows) == 439 and rows[0].name == "nasa_20200101.csv" and rows[-1].chunk_start == dt.date(2025, 12, 30)
    landed = spark.createDataFrame([("nasa_20200106.csv",), ("other.csv",)], "name string")
    assert L.pending(L.date_chunks(bounds, "a", "b"), landed).count() == 438


@pytest.mark.parametrize("group", [1, 3, 100])
def test_cell_batches(spark, group):
    cells = spark.range(13).selectExpr("id", "concat('c', id) AS cell")
    got = {r.batch: r.cells for r in L.cell_batches(cells, "cell", F.floor(F.col("id") / group), ["id"]).collect()}
    assert got == {0: [f"c{i}" for i in range(5)], 1: [f"c{i}" for i in range(5, 10)], 2: ["c10", "c11", "c12"]}
    assert L.cell_batches(cells.limit(0), "cell", F.col("id"), ["id"]).count() == 0


def test_payloads_and_audit(spark, tmp_path):
    put(f"{tmp_path}/in", "nasa_20200101.csv", HEADER, "1,2")
    put(f"{tmp_path}/in", "nasa_20200106.csv", "Invalid MAP_KEY.")
    put(f"{tmp_path}/in", "readme.md", "Invalid")
    good, bad = L.split_payloads(L.read_payloads(spark, f"{tmp_path}/in"), "value")
    assert [os.path.basename(r.source_filename) for r in good.collect()] == ["nasa_20200101.csv"]
    assert [os.path.basename(r.source_filename) for r in bad.collect()] == ["nasa_20200106.csv"]
    r = L.landing_audit(L.file_listing(spark, f"{tmp_path}/in", ".csv"), 160).first()
    assert (r.files, r.first_name, r.last_name, r.last_length, r.progress_pct) == (2, "nasa_20200101.csv", "nasa_20200106.csv", 16, 1.3)
    put(f"{tmp_path}/w", "weather_a.json", document("a"))
    v = L.document_variables(L.read_payloads(spark, f"{tmp_path}/w", ".json")).first()
    assert (v.n_variables, v.variables) == (2, ["date", "temperature_2m"])
    listing = L.file_listing(spark, f"{tmp_path}/in", ".csv")
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_scoring_stream_counts_repeats_once(spark, tmp_path):
    rows = [("a", dt.datetime(2020, 1, 1, h), float(h)) for h in range(5)]
    df = spark.createDataFrame(rows + rows[:3], "k string, ts timestamp, x double")
    for part in (df, df.limit(0).unionByName(df.filter("hour(ts) = 4"))):
        part.write.mode("append").parquet(f"{tmp_path}/feed")
        feed = forecast_stream(spark, f"{tmp_path}/feed", df.schema)
        drain(scored_stream(feed, ["k"], "ts", lambda d: d.withColumn("score", F.col("x") / 10)), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted(r.score for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [0.0, 0.1, 0.2, 0.3, 0.4]


def test_build_twice_gives_the_same_tables(spark, tmp_path, schema):
    grid = GridSpec.of_degrees((-31.3, -31.1, -64.5, -64.3))
    hours = [f"2020-08-23 {h:02d}:00:00+00:00" for h in range(24)]
    for lat in (-31.3, -31.2):
        for lon in (-64.5, -64.4):
            series = {v: [float(h) for h in range(24)] for v in V.CLIMATE_VARIABLES}
            doc = {"cell_id": f"{lat}_{lon}", "request_latitude": lat, "request_longitude": lon, "elevation_val": 1.0, "hourly": {"date": hours, **series}}
            put(f"{tmp_path}/weather", f"weather_{lat}_{lon}.json", json.dumps(doc))
    put(f"{tmp_path}/fires", "nasa_20200823.csv", HEADER, "-31.22,-64.41,2020-08-23,1805,h,9.5", "-31.22,-64.41,2020-08-23,1805,h,9.5")
    names = Tables(**{f: f"{schema}.{f}" for f in Tables.__dataclass_fields__})
    args = (f"{tmp_path}/fires", f"{tmp_path}/weather", f"{tmp_path}/state", grid, names)
    for run in (1, 2):
        status = build(spark, *args, layers=(), layout_partitions=4)
        assert [r.ok for r in status.collect()] == [True, True]
        gold, features = spark.read.table(names.gold_full), spark.read.table(names.gold_features)
        assert gold.count() == features.count() == 96 and gold.filter("target = 1").count() == 1
        assert gold.filter("timestamp_clima = '2020-08-23 18:00:00' AND latitude = -31.2 AND longitude = -64.4").first()["fire_confidence"] == 3
    assert features.columns[-8:] == ["precip_acum_7d", "precip_acum_3d", "temp_max_3d", "fire_spread_index", "hour_sin", "hour_cos", "month_sin", "month_cos"]


def test_a_build_broadcasts_only_what_it_knows_the_size_of(spark, tmp_path, schema, monkeypatch):
    """The planner goes by compressed files and takes an exploded row for one: once 27 rows for each node searched went through the driver."""
    grid = GridSpec.of_degrees((-31.6, -30.6, -65.0, -64.0))
    hours = [f"2020-08-23 {h:02d}:00:00+00:00" for h in range(24)]
    series = {v: [float(h) for h in range(24)] for v in V.CLIMATE_VARIABLES}
    put(f"{tmp_path}/weather", "weather.json", json.dumps({"cell_id": "a", "request_latitude": -31.2, "request_longitude": -64.4, "elevation_val": 1.0, "hourly": {"date": hours, **series}}))
    put(f"{tmp_path}/fires", "nasa_20200823.csv", HEADER, "-31.22,-64.41,2020-08-23,1805,h,9.5")
    names = Tables(**{f: f"{schema}.{f}" for f in Tables.__dataclass_fields__})
    sent = {}

    def spied(write):
        def noted(self, place, *args, **kwargs):
            plan = self._df._jdf.queryExecution().executedPlan().toString()
            what = os.path.basename(place).split("-")[0].removeprefix(f"{schema}.").removesuffix("__staging")
            sent[what] = sent.get(what, 0) + plan.count("BroadcastExchange")
            return write(self, place, *args, **kwargs)

        return noted

    for name in ("parquet", "saveAsTable"):
        monkeypatch.setattr(DataFrameWriter, name, spied(getattr(DataFrameWriter, name)))
    status = build(spark, f"{tmp_path}/fires", f"{tmp_path}/weather", f"{tmp_path}/state", grid, names, layers=(), training=f"{schema}.blocks_of_all")
    assert [r.ok for r in status.collect()] == [True, True]
    assert {"nearest", "open", "links", "blocks", "closed", "gold_full", "gold_features"} <= sent.keys()
    # the grid and the lists of its links; the grid of the search meets the cubes that many nodes share, if there are any
    assert {what: n for what, n in sent.items() if n and what != "grid"} == {"silver_weather": 1, "training": 1}
    built = spark.read.table(f"{schema}.blocks_of_all")
    assert built.count() == 4 and built.filter("target = 1").count() == 1


def test_files_of_one_document_are_written_whole_and_once(spark, tmp_path):
    path = tmp_path / "documents"
    docs = spark.range(50).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("ñ \n"), F.col("id").cast("string"))).alias("text"), F.array(F.lit(1.5), F.lit(None)).alias("a"))
    L.write_documents(docs, str(path), partitions=4)
    names = sorted(p.name for p in path.iterdir())
    # no checksum, marker or hidden file beside them: they cost as much as the documents
    assert len(names) == 50 and all(n.startswith("part-") and n.endswith(".json") for n in names)
    assert sorted(map(str, spark.read.schema(docs.schema).json(str(path)).collect())) == sorted(map(str, docs.collect()))
    listed = L.listed_payloads(spark, str(path), ".json")
    audit = L.landing_audit(listed, 100, [F.count("value").alias("read")]).first()
    assert (audit.files, audit.read, audit.first_name, audit.progress_pct) == (50, 50, names[0], 50.0)
