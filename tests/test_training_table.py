import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberscope.operators.blocks import roll_up
from emberscope.plans import features as P
from emberscope.plans.features import closed_blocks, memory_features, training_table
from emberscope.session import Scratch

START = dt.datetime(2024, 1, 1, 3, 30)
KINDS = ["decimal(8,2)", "double"]
VALUES = ["temperature_2m", "relative_humidity_2m", "vapour_pressure_deficit", "precipitation", "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "et0_fao_evapotranspiration"]


def hourly(spark, kind, cells=3, hours=2200):
    """Hours at half past, over several chunks of time, with unknown values, a missing day and missing single hours."""
    rng, rows = random.Random(5), []
    for c in range(cells):
        for h in range(hours):
            if (c == 1 and 300 <= h < 324) or rng.random() < 0.01:
                continue
            values = [None if rng.random() < 0.2 else rng.randrange(0, 4000) / 100 for _ in VALUES]
            values[3] = None if rng.random() < 0.02 else float(rng.random() < 0.05)
            rows.append((f"c{c}", START + dt.timedelta(hours=h), *values, rng.choice([None, 1.0, 2.0, 2.0, 3.0]), int(rng.random() < 0.05)))
    rows.append((None, START, *[1.0] * len(VALUES), 1.0, 1))
    names = ", ".join(f"{v} double" for v in VALUES)
    df = spark.createDataFrame(rows, f"grid_id string, timestamp_clima timestamp_ntz, {names}, weather_code double, target int")
    return df.withColumns({v: F.col(v).cast(kind) for v in VALUES if v != "wind_direction_10m"})


@pytest.mark.parametrize("kind", KINDS)
def test_blocks_carry_what_the_hours_say_at_their_last_hour(spark, kind):
    df = hourly(spark, kind).localCheckpoint()
    scratch = Scratch(spark)
    blocks = closed_blocks(df.filter("grid_id IS NOT NULL"), scratch)
    memory = memory_features(df).filter("hour(timestamp_clima) % 6 = 5 AND grid_id IS NOT NULL")
    carried = [c for c in memory.columns if c not in df.columns]
    assert [blocks.schema[c].dataType for c in carried] == [memory.schema[c].dataType for c in carried]
    want = {(r.grid_id, r.timestamp_clima): [r[c] for c in carried] for r in memory.collect()}
    got = {(r.grid_id, r["__closed"]): [r[c] for c in carried] for r in blocks.filter("__closed IS NOT NULL").collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    for k, values in want.items():
        assert [v is None for v in got[k]] == [v is None for v in values]
        known = [(a, b) for a, b in zip(got[k], values) if b is not None]
        # sums of doubles differ in the last digits
        assert all(a == (pytest.approx(b, rel=1e-9, abs=1e-9) if kind == "double" else b) for a, b in known)


def test_one_mode_is_as_the_engine_counts_it(spark):
    df = hourly(spark, "decimal(8,2)").localCheckpoint()
    settings = {k: v for k, v in P.BLOCK.items() if k != "modes"}
    counted = roll_up(df, ["grid_id"], "timestamp_clima", modes=["weather_code"], **settings)
    whole = roll_up(df, ["grid_id"], "timestamp_clima", modes=["weather_code", "target"], **settings | {"maxima": ["wind_gusts_10m"]})
    assert counted.schema["precipitation"] == whole.schema["precipitation"]
    shared = [c for c in counted.columns if c not in ("target", "wind_direction_10m")]
    assert sorted(map(str, counted.select(shared).collect())) == sorted(map(str, whole.select(shared).collect()))


def test_training_table_reads_the_hours_once(spark, tmp_path):
    df = hourly(spark, "decimal(8,2)", cells=2, hours=50)
    path = str(tmp_path / "hours")
    df.write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            reads.add(len(part))
            yield part

    counted = spark.read.parquet(path).mapInPandas(seen, df.schema)
    links = spark.createDataFrame([("c0", "c1"), ("c1", "c0")], "grid_id string, neighbour string")
    out = training_table(counted, links, link_rows=4)
    assert out.count() > 0
    assert reads.value == df.count()
