"""Scoring a feed with features that reach into history, against the plain computation over all hours."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from emberscope.functions.timekeys import HOUR
from emberscope.operators.frames import ahead, lagged, over_time, trailing
from emberscope.operators.modeling import fit_boosted, fit_forest, fit_margin, score
from emberscope.streaming.scoring import BATCH, LiveScores, forecast_stream, score_batch, score_with_history

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "k string, ts timestamp, x long"
FRAMES = [lagged("lag", "x", 6 * HOUR), trailing("sum", "x", "sum", 24 * HOUR)]


@pytest.fixture
def schema(spark, request):
    name = f"s_{request.node.name}"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")
    yield name
    spark.sql(f"DROP SCHEMA {name} CASCADE")


def hours(spark, key, first, last, value=1):
    return spark.createDataFrame([(key, T0 + dt.timedelta(hours=h), value * h) for h in range(first, last)], SCHEMA)


def live(tmp_path, schema, **more):
    return LiveScores(["k"], "ts", ["x"], FRAMES, f"{schema}.scored", f"{tmp_path}/checkpoint", **more)


def values(df):
    return sorted(tuple(r) for r in df.select(F.coalesce("k", F.lit("")), "ts", "x", "lag", "sum").collect())


def test_features_equal_the_batch_plan(spark, tmp_path, schema):
    own = live(tmp_path, schema)
    history = hours(spark, "a", 0, 100).unionByName(hours(spark, None, 0, 100)).unionByName(hours(spark, "c", 0, 100))
    feed = hours(spark, "a", 100, 200).unionByName(hours(spark, None, 100, 150)).unionByName(hours(spark, "b", 90, 120))
    lots = [feed.filter("hour(ts) < 12 AND k = 'a'"), feed.filter("NOT (hour(ts) < 12 AND k <=> 'a')").unionByName(feed.filter("k = 'a'"))]
    lots[0].write.parquet(f"{tmp_path}/feed")
    assert score_with_history(forecast_stream(spark, f"{tmp_path}/feed", SCHEMA), history, own) == lots[0].count()
    first = {tuple(r) for r in spark.read.table(own.table).select("ts", "lag", "sum").collect()}
    lots[1].write.mode("append").parquet(f"{tmp_path}/feed")
    score_with_history(forecast_stream(spark, f"{tmp_path}/feed", SCHEMA), history, own)
    assert score_with_history(forecast_stream(spark, f"{tmp_path}/feed", SCHEMA), history, own) == 0
    got = spark.read.table(own.table)
    assert first <= {tuple(r) for r in got.select("ts", "lag", "sum").collect()}  # not scored again
    plain = over_time(history.unionByName(feed), ["k"], "ts", FRAMES)
    late = plain.join(feed.select(F.col("k").alias("k2"), F.col("ts").alias("t2")), F.col("k").eqNullSafe(F.col("k2")) & (F.col("ts") == F.col("t2"))).drop("k2", "t2")
    # the first lot was scored without the hours that came later
    assert values(got.filter(F.col(BATCH) > 0)) == values(late.exceptAll(late.filter("hour(ts) < 12 AND k = 'a'")))
    assert got.count() == feed.count()


def test_history_goes_before_the_feed_and_repeats_count_once(spark, tmp_path, schema):
    own = live(tmp_path, schema)
    feed = hours(spark, "a", 8, 14, 100).unionByName(hours(spark, "a", 8, 14, 50)).unionByName(spark.createDataFrame([("a", None, 1)], SCHEMA))
    got = score_batch(feed, hours(spark, "a", 0, 10), own, 0).orderBy("ts").collect()
    assert [(r.ts.hour, r.x) for r in got] == [(h, 50 * h) for h in range(10, 14)]
    assert got[0].lag == 4 and got[-1]["sum"] == sum(range(10)) + 50 * (10 + 11 + 12 + 13)
    assert score_batch(feed.limit(0), hours(spark, "a", 0, 10), own, 0).count() == 0


def test_a_repeated_batch_replaces_itself(spark, tmp_path, schema):
    own, history = live(tmp_path, schema), hours(spark, "a", 0, 10)
    hours(spark, "a", 10, 20).coalesce(1).write.parquet(f"{tmp_path}/feed")
    failing = {"left": 1}

    def finish(rows):
        if failing["left"]:
            failing["left"] -= 1
            raise OSError("lost")
        return rows

    own = live(tmp_path, schema, finish=finish)
    with pytest.raises(Exception, match="lost"):
        score_with_history(forecast_stream(spark, f"{tmp_path}/feed", SCHEMA), history, own)
    assert score_with_history(forecast_stream(spark, f"{tmp_path}/feed", SCHEMA), lambda s: history, own) == 10
    rows = spark.read.table(own.table)
    # the same batch once more, as after a crash behind its write
    again = score_batch(hours(spark, "a", 10, 20), history, own, 0)
    assert rows.count() == 10 and values(again) == values(rows)


def test_frames_look_back_only(tmp_path):
    with pytest.raises(ValueError, match="ahead"):
        LiveScores(["k"], "ts", ["x"], [ahead("y", "x", "max", HOUR)], "t", str(tmp_path))


def test_models_score_after_an_observation(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3
    rows = spark.createDataFrame([(float(i % 7), float(i), i % 2) for i in range(40)], "a double, b double, target int")
    for model in (fit_forest(rows, ["a", "b"], trees=3, depth=2), fit_margin(rows, ["a", "b"]), fit_boosted(rows, ["a", "b"], rounds=2, depth=2)):
        assert score(model, rows).count() == 40


def test_rows_without_a_feature_keep_no_score(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i), i % 2) for i in range(40)], "a double, b double, target int")
    model = fit_forest(rows, ["a", "b"], trees=3, depth=2)
    some = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert [r.score is None for r in score(model, some, keep_incomplete=True).collect()] == [False, True, True]
    assert score(model, some).count() == 1
