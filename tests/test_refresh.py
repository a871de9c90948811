"""The build in increments against the full build."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from emberscope import vocabulary as V
from emberscope.operators.grid import GridSpec
from emberscope.plans.medallion import Tables, build
from emberscope.plans.refresh import reached, refresh

GRID = GridSpec(-3250, -3220, -6500, -6470, 10)
HEADER = "latitude,longitude,acq_date,acq_time,confidence,frp"


@pytest.fixture
def schema(spark, request):
    name = f"s_{request.node.name}"
    for kind in ("full", "parts"):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}_{kind}")
    yield name
    for kind in ("full", "parts"):
        spark.sql(f"DROP SCHEMA {name}_{kind} CASCADE")


def tables(schema):
    names = ["landing_grid", "bronze_fires", "bronze_weather", "silver_grid", "silver_fires", "silver_weather", "gold_full", "gold_features"]
    return Tables(**{n: f"{schema}.{n}" for n in names})


def document(cell, start, hours, rng, gap=0.0):
    times = [start + dt.timedelta(hours=h) for h in range(hours) if rng.random() >= gap]
    hourly = {"time": [t.strftime("%Y-%m-%dT%H:%M") for t in times]}
    hourly |= {v: [None if rng.random() < 0.01 else rng.randint(0, 40) for _ in times] for v in V.CLIMATE_VARIABLES}
    lat, lon = -32.5 + 0.1 * (cell // 3), -65.0 + 0.1 * (cell % 3)
    return json.dumps({"cell_id": str(cell), "request_latitude": lat, "request_longitude": lon, "elevation_val": 1.0, "hourly": hourly})


def put(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)


def detections(days, rng):
    return "\n".join([HEADER, *(f"{-32.5 + 0.1 * rng.randint(0, 3):.2f},{-65 + 0.1 * rng.randint(0, 3):.2f},{d},{rng.randint(0, 23) * 100},{rng.choice('lnh')},{rng.randint(1, 50)}" for d in days)])


def rows(spark, table, but=()):
    df = spark.read.table(table).drop("year", "part", "fecha_procesamiento", "ingestion_timestamp", *but)
    numbers = {f.name: F.round(F.col(f.name), 9) for f in df.schema if f.dataType.typeName() == "double"}
    return sorted(map(str, df.withColumns(numbers).collect()))


def files(spark, table):
    return {(r.year, r.part): r.f for r in spark.read.table(table).groupBy("year", "part").agg(F.array_sort(F.collect_set("_metadata.file_path")).alias("f")).collect()}


def test_drops_of_files_equal_the_full_build(spark, tmp_path, schema):
    rng = random.Random(3)
    w, f, own, whole = f"{tmp_path}/w", f"{tmp_path}/f", tables(f"{schema}_parts"), tables(f"{schema}_full")

    def run():
        return refresh(spark, f, w, f"{tmp_path}/state", GRID, own, layers=(), parts=4)

    days = [f"2019-12-{d}" for d in range(28, 32)] + [f"2020-01-0{d}" for d in range(1, 8)]
    for cell in range(4):
        put(w, f"weather_{cell}.json", document(cell, dt.datetime(2019, 12, 20), 24 * 20, rng, gap=0.2))
    put(w, "weather_9.json", json.dumps({"cell_id": "9", "request_latitude": 1.0, "request_longitude": 1.0, "hourly": {"time": ["2020-01-01T00:00", "never"], "temperature_2m": [1, 2]}}))
    put(f, "a.csv", detections(days * 6, rng))
    assert run().filter("NOT ok").isEmpty()
    first = {t: files(spark, t) for t in own.derived()}
    # nothing new
    run()
    assert {t: files(spark, t) for t in own.derived()} == first
    # an earlier month of one cell, in a late file, whose rows move the frames across the turn of the year; some hours again
    put(w, "weather_0b.json", document(0, dt.datetime(2019, 12, 27), 24 * 3, rng))
    run()
    second = {t: files(spark, t) for t in own.derived()}
    moved = {p for p in second[own.silver_weather] if second[own.silver_weather][p] != first[own.silver_weather].get(p)}
    assert len(moved) == 1 and {y for y, _ in moved} == {2019}
    part = next(iter(moved))[1]
    changed = {p for p in second[own.gold_features] if second[own.gold_features][p] != first[own.gold_features].get(p)}
    assert changed == {(2019, part), (2020, part)}
    assert second[own.silver_fires] == first[own.silver_fires]
    # detections and a new cell
    put(f, "b.csv", detections(days[:3], rng))
    put(w, "weather_7.json", document(7, dt.datetime(2020, 1, 1), 24 * 5, rng))
    run()
    build(spark, f, w, f"{tmp_path}/state2", GRID, whole, layers=())
    for a, b in zip(own.derived(), whole.derived(), strict=True):
        assert rows(spark, a) == rows(spark, b), a
    # other settings: in full
    refresh(spark, f, w, f"{tmp_path}/state", GRID, own, layers=(), parts=2)
    assert rows(spark, own.gold_features) == rows(spark, whole.gold_features)


def test_reach_is_counted_by_cell(spark):
    days = [("a", y, 0) for y in (2018, 2019, 2020) for _ in range(5)] + [("b", y, 0) for y in (2018, 2021) for _ in range(2)]
    gold = spark.createDataFrame(days, "grid_id string, year int, part int")
    assert reached(gold, [(2018, 0)], rows=5) == [(2018, 0), (2019, 0), (2021, 0)]
    assert reached(gold, [(2018, 0)], rows=6) == [(2018, 0), (2019, 0), (2020, 0), (2021, 0)]
    assert reached(gold, [(2021, 0)], rows=2, back=True) == [(2018, 0), (2020, 0), (2021, 0)]
    assert reached(gold, [(None, 0)]) == []
