import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberscope import vocabulary as V
from emberscope.functions.indices import confidence_label
from emberscope.operators.dedup import keep_first
from emberscope.operators.nested import build_documents, to_json_text, unreadable, zip_explode
from emberscope.plans.features import gold_features, stateless_features
from emberscope.plans import gold as G
from emberscope.plans.gold import fires_without_weather, gold_full
from emberscope.plans.silver import hourly_arrays, silver_fires, silver_weather
from emberscope.sources.files import parse_json

DAY = dt.date(2020, 8, 23)


def fires(spark, rows):
    return spark.createDataFrame(rows, V.FIRE_SCHEMA)


def test_silver_fires_times_and_casts(spark):
    rows = [("-31.2", "-64.4", DAY, t, "n", 1.0) for t in (5, 45, 930, 2359, 2460)] + [("here", "-64.4", DAY, 100, "l", 2.0)]
    got = {r.acq_time: r for r in silver_fires(fires(spark, rows)).collect()}
    assert [got[t].time_str for t in (5, 45, 930, 2359)] == ["0005", "0045", "0930", "2359"]
    assert [got[t].hora_join for t in (5, 45, 930, 2359)] == [0, 0, 9, 23]
    assert got[2460].timestamp_incendio is None and got[2460].hora_join is None
    assert got[100].latitude is None and got[100].fecha_join == DAY
    assert got[930].timestamp_incendio == dt.datetime(2020, 8, 23, 9, 30)


def test_dedup_is_deterministic_for_any_order(spark):
    rows = [("-31.2", "-64.4", DAY, 5, c, f) for c, f in (("n", 3.0), ("h", 9.0), ("h", 1.0), (None, 7.0))] * 2
    for variant in (rows, rows[::-1]):
        (row,) = silver_fires(fires(spark, variant).repartition(3)).collect()
        assert (row.confidence, row.frp) == (None, 7.0)


def test_keep_first_groups_null_keys_and_honours_order(spark):
    df = spark.createDataFrame([(None, 1, "b"), (None, 2, "a"), ("k", 3, "c")], "k string, n int, s string")
    assert {(r.k, r.n) for r in keep_first(df, ["k"]).collect()} == {(None, 1), ("k", 3)}
    assert {(r.k, r.n) for r in keep_first(df, ["k"], ["s"]).collect()} == {(None, 2), ("k", 3)}
    assert keep_first(df.select("k"), ["k"]).count() == 2


def documents(spark, hourly):
    """Bronze documents from (cell, hourly dict) pairs."""
    rows = []
    for i, series in enumerate(hourly):
        rows.append((f"c{i}", -31.24, -64.44, 512.345, {f: series.get(f) for f in V.WEATHER_SCHEMA["hourly"].dataType.fieldNames()}))
    return spark.createDataFrame(rows, V.WEATHER_SCHEMA).withColumn("source_filename", F.lit("f"))


GRID = [("-31.2_-64.4", -31.2, -64.4)]


def silver(spark, bronze, **more):
    grid = spark.createDataFrame(GRID, "grid_id string, latitude_centroid double, longitude_centroid double")
    return silver_weather(bronze, grid, 1, **more)


def test_weather_rows_from_parallel_arrays(spark):
    full = {v: [1.0, 2.0] for v in V.CLIMATE_VARIABLES}
    bronze = documents(
        spark,
        [
            {**full, "date": ["2020-01-01 00:00:00+00:00", "2020-01-01 01:00:00+00:00"]},
            {**full, "time": ["2020-01-02T00:00", "2020-01-02T01:00"], "snow_depth": [7.0]},
            {**full, "date": ["2020-01-03 00:00:00+00:00"], "snow_depth": None},
        ],
    )
    df = silver(spark, bronze)
    assert df.columns == V.SILVER_WEATHER_KEYS + V.CLIMATE_VARIABLES + V.SILVER_WEATHER_TAIL
    rows = df.collect()
    assert len(rows) == 6 and {r.grid_id for r in rows} == {"-31.2_-64.4"} and {r.elevation for r in rows} == {512.35}
    by_time = {r.timestamp_clima: r for r in rows}
    assert by_time[dt.datetime(2020, 1, 2, 1)].snow_depth is None
    assert by_time[dt.datetime(2020, 1, 2, 0)].snow_depth == 7.0
    assert by_time[None].temperature_2m == 2.0
    # With strict parity the document with an absent series is lost, and reported.
    assert silver(spark, bronze, strict=True).count() == 4
    arrays = hourly_arrays(bronze)
    assert [r.cell_id for r in unreadable(bronze, arrays, strict=True).collect()] == ["c2"]
    assert unreadable(bronze, arrays).count() == 0


def test_zip_of_nothing_yields_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, [], [])], "id int, a array<int>, b array<int>")
    arrays = {"a": F.col("a"), "b": F.col("b")}
    assert zip_explode(df, ["id"], arrays).count() == 0
    assert unreadable(df, arrays).count() == 2


def test_documents_round_trip_with_nan_and_absent_variable(spark):
    rows = [("x", dt.datetime(2020, 1, 1, h), float(h) if h != 2 else float("nan"), 1.5) for h in range(5)]
    df = spark.createDataFrame(rows, "cell_id string, ts timestamp, temperature_2m double, elevation_val double")
    docs = build_documents(df.repartition(4), "cell_id", "ts", ["temperature_2m"], ["elevation_val"])
    text = to_json_text(docs)
    assert "snow_depth" not in text.first()["value"] and '"temperature_2m":[0.0,1.0,null,3.0,4.0]' in text.first()["value"]
    bronze = text.select(*parse_json(F.col("value"), V.WEATHER_SCHEMA), F.lit("f").alias("source_filename"))
    assert bronze.filter("_rescued_data is not null").count() == 0
    got = sorted((r.timestamp_clima, r.temperature_2m) for r in silver(spark, bronze).collect())
    assert got == [(r[1], None if r[2] != r[2] else r[2]) for r in rows]


def test_document_size_is_bounded_by_the_period(spark):
    hours = spark.range(24 * 10).selectExpr("'x' AS cell_id", "timestamp'2020-01-01' + make_interval(0,0,0,0,id,0,0) AS ts", "1.0D AS v")
    docs = build_documents(hours, "cell_id", "ts", ["v"], period_days=3)
    sizes = [len(r.hourly.date) for r in docs.collect()]
    assert sum(sizes) == 240 and max(sizes) == 72


def weather(spark, cells=(("-31.2_-64.4", -31.2, -64.4),), hours=24, start="2020-08-23"):
    cell = spark.createDataFrame(list(cells), "grid_id string, latitude double, longitude double")
    numbers = {v: (F.col("h") + i).cast("double") for i, v in enumerate(V.CLIMATE_VARIABLES)}
    return (
        cell.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
        .withColumn("timestamp_clima", F.expr(f"timestamp'{start}' + make_interval(0,0,0,0,h,0,0)"))
        .withColumns(numbers)
        .withColumns({"fecha_join": F.to_date("timestamp_clima"), "hora_join": F.hour("timestamp_clima"), "elevation": F.lit(500.0), "source_filename": F.lit("f")})
        .select(*V.SILVER_WEATHER_KEYS, *V.CLIMATE_VARIABLES, *V.SILVER_WEATHER_TAIL)
    )


@pytest.mark.parametrize(
    ("mode", "accepted", "codes"),
    [("lexical", None, {1: 2, 2: 1, 3: 2, 4: 0, 5: 0}), ("ordinal", None, {1: 3, 2: 3, 3: 2, 4: 0, 5: 3}), ("ordinal", ("n", "h"), {1: 3, 2: 3, 3: 2, 4: 0, 5: 3})],
)
def test_label_join_confidence_modes(spark, mode, accepted, codes):
    levels = {1: "hn", 2: "hl", 3: "nl", 4: "z", 5: "hz"}
    rows = [("-31.24", "-64.36", DAY, 100 * hour + i, c, float(i)) for hour, cs in levels.items() for i, c in enumerate(cs)]
    rows.append(("-31.24", "-64.36", DAY, 600, None, 4.0))
    gold = gold_full(weather(spark), silver_fires(fires(spark, rows)), mode, accepted)
    got = {r.timestamp_clima.hour: r for r in gold.collect()}
    assert len(got) == 24
    assert {h: got[h].fire_confidence for h in codes} == codes
    assert got[0].target == 0 and got[0].fire_intensity == 0 and got[0].fire_confidence == 0
    assert got[1].target == 1 and got[1].fire_intensity == 1.0
    assert got[4].target == (0 if accepted else 1) == got[6].target


def test_gold_shape_and_known_point(spark):
    w = weather(spark)
    rows = [("-31.2", "-64.4", DAY, 1805, "h", 9.5), ("10.0", "10.0", DAY, 1800, "h", 1.0), ("-31.2", "-64.4", dt.date(2019, 1, 1), 100, "n", 2.0)]
    f = silver_fires(fires(spark, rows))
    gold = gold_full(w, f)
    assert gold.count() == w.count() and "snow_depth" not in gold.columns
    point = gold.filter("timestamp_clima = '2020-08-23 18:00:00' AND latitude = -31.2 AND longitude = -64.4").collect()
    assert [(r.target, r.fire_intensity, r.fire_confidence) for r in point] == [(1, 9.5, 3)]
    assert gold.filter("fire_confidence IS NULL").count() == 0
    lost = fires_without_weather(w, f).collect()
    assert {(r.fecha_join, r.hora_join, r.latitude, r.longitude) for r in lost} == {(DAY, 18, 10.0, 10.0), (dt.date(2019, 1, 1), 1, -31.2, -64.4)}


def test_features_keep_the_first_week_and_drop_incomplete_rows(spark):
    cells = [("a", -31.2, -64.4), (None, -31.3, -64.4)]
    gold = gold_full(weather(spark, cells, hours=200), silver_fires(fires(spark, []))).withColumn(
        "relative_humidity_2m", F.when(F.col("timestamp_clima") != F.lit("2020-08-24 00:00:00").cast("timestamp"), F.col("relative_humidity_2m"))
    )
    rows = {r.timestamp_clima: r for r in gold_features(gold).collect()}
    assert len(rows) == 199 and {r.grid_id for r in rows.values()} == {"a"}
    first, last = min(rows), max(rows)
    assert rows[first].precip_acum_7d == 3.0
    # precipitation is hour number + 3; the frame holds 169 and 73 rows.
    assert rows[last].precip_acum_7d == sum(h + 3 for h in range(199 - 168, 200))
    assert rows[last].precip_acum_3d == sum(h + 3 for h in range(199 - 72, 200))
    assert rows[last].temp_max_3d == 199.0
    r = rows[last]
    assert r.fire_spread_index == pytest.approx(r.wind_speed_10m * r.temperature_2m / (r.relative_humidity_2m + 1))


def test_rows_equal_hours_without_gaps(spark):
    gold = gold_full(weather(spark, [("a", -31.2, -64.4), ("b", -31.3, -64.4)], hours=400), silver_fires(fires(spark, [])))
    by_rows, by_hours = gold_features(gold), gold_features(gold, gap_free=True)
    assert by_rows.count() == 800
    assert by_rows.exceptAll(by_hours).isEmpty() and by_hours.exceptAll(by_rows).isEmpty()


def test_cyclic_encoding(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 1, 6), 1.0, 1.0, -1.0)], "timestamp_clima timestamp, wind_speed_10m double, temperature_2m double, relative_humidity_2m double")
    r = stateless_features(df).first()
    assert (r.hour_sin, r.month_cos) == (pytest.approx(1.0), pytest.approx(1.0))
    assert r.hour_cos == pytest.approx(0.0, abs=1e-12) and r.month_sin == pytest.approx(0.0, abs=1e-12)
    assert r.fire_spread_index is None


def test_confidence_labels(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "c int")
    assert [r[0] for r in df.select(confidence_label(F.col("c"))).collect()] == ["Desconocido", "Baja (Low)", "Nominal", "Alta (High)", "Desconocido"]


def test_label_join_leaves_stored_hours_where_they_are(spark, tmp_path):
    hours = [(f"c{i}", dt.datetime(2020, 1, 1, h), dt.date(2020, 1, 1), h, -31.0 - i / 10, -64.0) for i in range(20) for h in range(24)]
    weather = spark.createDataFrame(hours, "grid_id string, timestamp_clima timestamp, fecha_join date, hora_join int, latitude double, longitude double")
    weather = weather.withColumns({"elevation": F.lit(1.0)} | {v: F.lit(1.0) for v in V.CLIMATE_VARIABLES})
    fires = spark.createDataFrame([(-31.04, -64.0, dt.date(2020, 1, 1), 3, "h", 2.5), (10.0, 10.0, dt.date(2020, 1, 1), 3, "h", 2.5)], "latitude double, longitude double, fecha_join date, hora_join int, confidence string, frp double")
    spark.sql("CREATE SCHEMA IF NOT EXISTS bucketed")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        G.store_keyed(weather, "bucketed.weather", 4)
        # as with detections too many to broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = G.gold_full(spark.read.table("bucketed.weather"), fires)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        plain = G.gold_full(weather, fires)
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        # the detections' exchange, by which they are snapped, is the only one
        assert plan.count("Exchange hashpartitioning") == 1 and plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        scan = plan[: plan.index("FileScan")].rsplit("+-", 3)
        assert "Bucketed: true" in plan and "Exchange" not in scan[-1]
        assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect())) and stored.filter("target = 1").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP SCHEMA bucketed CASCADE")
