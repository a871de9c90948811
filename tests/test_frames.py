"""Chunked frames against brute force on small series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberscope.functions.timekeys import HOUR
from emberscope.operators.frames import (
    Frame,
    ahead,
    as_of_join,
    dry_run,
    horizon_label,
    lagged,
    last_known,
    over_rows,
    over_time,
    row_index,
    rows_back,
    running_values,
    trailing,
)

START = dt.datetime(2023, 12, 25)


def series(seed, hours, gap=0.0, nulls=0.1, keys=("a", "b", None)):
    rng = random.Random(seed)
    rows = []
    for key in keys:
        for h in range(hours):
            if rng.random() < gap:
                continue
            value = None if rng.random() < nulls else rng.randint(0, 3)
            rows.append((key, START + dt.timedelta(hours=h), value, None if value is None else value + 0.25))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp, n int, x double").withColumn("d", F.col("x").cast("decimal(8,2)"))


def seconds(a, b):
    return int((a - b).total_seconds())


def pick(how, values):
    values = [v for v in values if v is not None]
    if how == "count":
        return len(values)
    if not values:
        return None
    return {"sum": sum(values), "max": max(values), "min": min(values), "mean": sum(values) / len(values)}[how]


@pytest.mark.parametrize("chunk", [5 * HOUR, 24 * HOUR, None])
@pytest.mark.parametrize("gap", [0.0, 0.3])
def test_over_time(spark, chunk, gap):
    rows = series(1, 60, gap)
    frames = [
        trailing("s", "n", "sum", 7 * HOUR),
        trailing("m", "d", "mean", 24 * HOUR),
        trailing("mx", "x", "sum", 7 * HOUR),
        trailing("c", "x", "count", 3 * HOUR),
        lagged("l", "n", 6 * HOUR),
        ahead("f", "n", "max", 12 * HOUR),
        Frame("lo", "x", "min", -2 * HOUR, 2 * HOUR),
        Frame("later", "n", "sum", 2 * HOUR, 5 * HOUR),
        Frame("earlier", "n", "sum", -9 * HOUR, -4 * HOUR),
    ]
    got = over_time(frame(spark, rows), ["k"], "ts", frames, chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        peers = [q for q in rows if q[0] == r["k"]]
        for f in frames:
            index = {"n": 2, "x": 3, "d": 3}[f.column]
            want = pick(f.how, [q[index] for q in peers if f.start <= seconds(q[1], r["ts"]) <= f.end])
            have = r[f.name]
            assert (have is None) == (want is None), (f, r)
            if want is not None:
                assert float(have) == pytest.approx(want), (f, r)


@pytest.mark.parametrize("gap", [0.0, 0.4])
def test_over_rows(spark, gap):
    rows = series(2, 80, gap)
    frames = [rows_back("s", "n", "sum", 16), rows_back("m", "x", "max", 7), rows_back("t", "d", "sum", 7)]
    got = over_rows(frame(spark, rows), ["k"], "ts", frames, chunk_rows=10).collect()
    assert len(got) == len(rows)
    for r in got:
        before = sorted((q for q in rows if q[0] == r["k"] and q[1] <= r["ts"]), key=lambda q: q[1])
        assert r["s"] == pick("sum", [q[2] for q in before[-17:]])
        assert r["m"] == pick("max", [q[3] for q in before[-8:]])
        want = pick("sum", [q[3] for q in before[-8:]])
        assert (None if r["t"] is None else float(r["t"])) == want


def test_frames_and_running_values_in_one_pass(spark):
    rows = series(9, 90, 0.2, nulls=0.3)
    frames = [trailing("s", "n", "sum", 7 * HOUR), ahead("f", "n", "max", 4 * HOUR)]
    extra = {"hi": ("max", F.col("n")), "total": ("sum", F.col("n"))}
    got = over_time(frame(spark, rows), ["k"], "ts", frames, 10 * HOUR, extra).collect()
    assert len(got) == len(rows)
    for r in got:
        peers = [q for q in rows if q[0] == r["k"]]
        before = [q[2] for q in peers if q[1] <= r["ts"]]
        assert (r["hi"], r["total"]) == (pick("max", before), pick("sum", before))
        assert r["s"] == pick("sum", [q[2] for q in peers if 0 <= seconds(r["ts"], q[1]) < 7 * HOUR])
        assert r["f"] == pick("max", [q[2] for q in peers if 0 < seconds(q[1], r["ts"]) <= 4 * HOUR])


def test_row_index(spark):
    rows = series(3, 100, 0.3)
    got = row_index(frame(spark, rows), ["k"], "ts", chunk_seconds=9 * HOUR).collect()
    for key in ("a", "b", None):
        mine = sorted((r["ts"], r["row_index"]) for r in got if r["k"] == key)
        assert [i for _, i in mine] == list(range(1, len(mine) + 1))


def test_running_and_last_known(spark):
    rows = series(4, 90, 0.2, nulls=0.5)
    df = frame(spark, rows)
    got = running_values(
        df, ["k"], "ts", {"hi": ("max", F.col("n")), "lo": ("min", F.col("n")), "total": ("sum", F.col("n"))}, 7 * HOUR
    )
    got = last_known(got, ["k"], "ts", "n", "known", 7 * HOUR).collect()
    assert len(got) == len(rows)
    for r in got:
        before = sorted((q for q in rows if q[0] == r["k"] and q[1] <= r["ts"]), key=lambda q: q[1])
        values = [q[2] for q in before if q[2] is not None]
        assert (r["hi"], r["lo"], r["total"]) == (pick("max", values), pick("min", values), pick("sum", values))
        assert r["known"] == (values[-1] if values else None)


def test_dry_run(spark):
    rows = series(5, 120, 0.0, nulls=0.05)
    rows = [(k, ts, None if n is None else (1 if n == 3 else 0), x) for k, ts, n, x in rows]
    got = dry_run(frame(spark, rows), ["k"], "ts", "n", chunk_seconds=6 * HOUR).collect()
    for r in got:
        run = 0
        for q in sorted((q for q in rows if q[0] == r["k"] and q[1] <= r["ts"]), key=lambda q: q[1]):
            run = run + 1 if q[2] == 0 else 0
        assert r["dry_hours"] == run


def test_horizon_label(spark):
    rows = series(6, 50, 0.0, nulls=0.0, keys=("a",))
    rows = [(k, ts, int(n == 3), x) for k, ts, n, x in rows]
    last = max(q[1] for q in rows)
    for r in horizon_label(frame(spark, rows), ["k"], "ts", "n").collect():
        if seconds(last, r["ts"]) < 12 * HOUR:
            assert r["target_ahead"] is None
        else:
            assert r["target_ahead"] == max(q[2] for q in rows if 0 < seconds(q[1], r["ts"]) <= 12 * HOUR)


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", START + dt.timedelta(days=d), d) for d in range(0, 100, 7)] + [("z", START, 0)], "k string, ts timestamp, id int")
    marks = [("a", START + dt.timedelta(days=d), float(d)) for d in (3, 21, 60)]
    right = spark.createDataFrame(marks, "k string, since timestamp, ndvi double")
    got = as_of_join(left, right, ["k"], "ts", "since", "ndvi", chunk_seconds=10 * 24 * HOUR).collect()
    assert len(got) == 16
    for r in got:
        want = [v for k, since, v in marks if k == r["k"] and since <= r["ts"]]
        assert r["ndvi"] == (want[-1] if want else None)


def test_input_order_does_not_matter(spark):
    rows = series(7, 40, 0.2)
    frames = [rows_back("s", "n", "sum", 5)]
    one = over_rows(frame(spark, rows), ["k"], "ts", frames, 8)
    two = over_rows(frame(spark, rows[::-1]).repartition(3), ["k"], "ts", frames, 8)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_a_key_is_cut_into_chunks_in_the_plan(spark):
    df = frame(spark, series(8, 20))
    plan = over_time(df, ["k"], "ts", [trailing("s", "n", "sum", HOUR)])._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "__chunk" in exchanges[0]


def test_as_of_join_has_no_window_over_the_probes(spark):
    left = spark.createDataFrame([(1, dt.datetime(2020, 1, 1) + dt.timedelta(days=d), d) for d in range(300)] + [(None, dt.datetime(2020, 1, 1), -1)], "k int, ts timestamp, n int")
    right = spark.createDataFrame([(1, dt.datetime(2020, 1, 10), 1.0), (1, dt.datetime(2020, 1, 10), 2.0), (1, dt.datetime(2020, 5, 1), None), (1, dt.datetime(2020, 7, 1), 3.0)], "k int, since timestamp, v double")
    joined = as_of_join(left, right, ["k"], "ts", "since", "v", chunk_seconds=30 * 24 * HOUR)
    got = {r.n: r.v for r in joined.collect()}
    assert got == {d: None if d < 9 else 2.0 if d < 182 else 3.0 for d in range(-1, 300)}
