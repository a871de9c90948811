import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberscope.functions.indices import climate_segment
from emberscope.operators import analysis as A
from emberscope.operators import quality as Q
from emberscope.operators.blocks import block_deltas, roll_up
from emberscope.operators.evaluation import (
    score_report,
    best_threshold,
    class_ratio,
    confusion,
    pr_curve,
    rank_auc,
    roc_auc,
    temporal_split,
    threshold_sweep,
    time_folds,
)
from emberscope.operators.modeling import feature_importance, filled, fit_boosted, fit_forest, fit_margin, fold_sweep, score, weight_sweep
from emberscope.operators.spine import complete, hourly_spine, time_axis
from emberscope.plans.losses import Losses

SCHEMA = "grid_id string, fecha_join date, latitude double, longitude double, x double, y double"


def table(spark, cells=2, days=2, hours=24, skip=(), null_every=0):
    rows, i = [], 0
    for c in range(cells):
        for d in range(days):
            for h in range(hours):
                i += 1
                if (c, d, h) in skip:
                    continue
                rows.append((f"c{c}", dt.date(2020, 1, 1 + d), -31.0, float(c), None if null_every and i % null_every == 0 else 1.0, 2.0))
    return spark.createDataFrame(rows, SCHEMA)


def audit(df, cells=2, days=2):
    return [tuple(r) for r in Q.audit(df, "grid_id", "fecha_join", ["x", "y"], cells, days).collect()]


def test_clean_table_passes(spark):
    lines = audit(table(spark))
    assert {r[4] for r in lines} == {"OK", "OPTIMO"} and len(lines) == 5
    assert Q.null_verdict(Q.null_profile(table(spark), ["x", "y"])).first()["status"] == "OK"


def test_broken_table_is_reported(spark):
    df = table(spark, skip={(0, 1, h) for h in range(24)} | {(1, 0, 5)}).unionByName(
        spark.createDataFrame([("c9", dt.date(2020, 1, 1), None, 1.0, None, None)], SCHEMA)
    )
    lines = audit(df)
    assert ("volume", "table", 72, 96, "ALERTA") in lines
    assert ("points", "table", 3, 2, "ALERTA") in lines
    assert ("null_coordinates", "table", 1, 0, "ERROR CRITICO") in lines
    assert ("days_per_cell", "c0", 1, 2, "ALERTA") in lines and ("days_per_cell", "c9", 1, 2, "ALERTA") in lines
    assert ("hours_per_day", "c1 2020-01-01", 23, 24, "ALERTA") in lines
    assert ("nulls", "x", 1, 0, "ATENCION") in lines
    assert Q.volume(df, 2, 2).first()["difference"] == -24


@pytest.mark.parametrize(("every", "status"), [(0, "OPTIMO"), (96, "ATENCION"), (20, "ATENCION"), (16, "CRITICO (>5%)")])
def test_null_limits(spark, every, status):
    (line,) = Q.null_profile(table(spark, null_every=every), ["x"]).collect()
    assert line.status == status and line.null_count == (96 // every if every else 0)


def test_empty_table(spark):
    lines = audit(table(spark, cells=0))
    assert ("volume", "table", 0, 96, "ALERTA") in lines
    assert ("nulls", "x", 0, 0, "OPTIMO") in lines and ("points", "table", 0, 2, "ALERTA") in lines


def test_spine_finds_cells_that_are_wholly_absent(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "k string")
    start, end = F.lit("2020-02-28 22:00:00").cast("timestamp_ntz"), F.lit("2020-03-01 01:00:00").cast("timestamp_ntz")
    spine = hourly_spine(cells, start, end, "ts")
    assert spine.count() == 2 * 27
    seen = spine.filter("k = 'a' AND hour(ts) <> 3")
    missing = Q.missing_hours(seen, spine, ["k", "ts"]).collect()
    assert len([m for m in missing if m.k == "b"]) == 27 and len([m for m in missing if m.k == "a"]) == 1
    filled = complete(seen.withColumn("v", F.lit(1)), spine, ["k", "ts"])
    assert filled.count() == 54 and filled.filter("v IS NULL").count() == 28


def test_time_axis_is_half_open(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    axis = spark.range(1).select(time_axis(at("2020-01-01 00:00:00"), at("2020-01-01 03:00:00")).alias("a")).first()["a"]
    assert [t.hour for t in axis] == [0, 1, 2]


def test_schema_drift(spark):
    have = spark.createDataFrame([], "a int, b struct<x: double, y: string>, d string").schema
    want = spark.createDataFrame([], "a bigint, b struct<x: double, z: string>").schema
    got = {(r.field, r.drift) for r in Q.schema_drift(spark, have, want).collect()}
    assert got == {("a", "type"), ("b.y", "unexpected"), ("b.z", "missing"), ("d", "unexpected")}
    assert Q.schema_drift(spark, have, have).count() == 0


def gold(spark):
    rows = []
    for i in range(60):
        ts = dt.datetime(2020 + (i % 3) * 2, 1 + i % 12, 1, i % 24)
        rows.append((f"c{i % 5}", ts, -31.0, float(i % 5), int(i % 4 == 0), float(i % 7), i % 4, float(i), float(i % 30), float(i % 60)))
    return spark.createDataFrame(
        rows,
        "grid_id string, timestamp_clima timestamp, latitude double, longitude double, target int, fire_intensity double,"
        " fire_confidence int, temperature_2m double, wind_speed_10m double, relative_humidity_2m double",
    )


def test_summary_and_empty_summary(spark):
    r = A.summary(gold(spark)).first()
    assert (r.total_registros_hora_celda, r.total_eventos_incendio, r.total_puntos_monitoreados) == (60, 15, 5)
    assert r.tasa_prevalencia_fuego == 25.0
    empty = A.summary(gold(spark).limit(0)).first()
    assert empty.total_registros_hora_celda == 0 and empty.tasa_prevalencia_fuego is None


def test_strongest_equals_the_global_rank(spark):
    df = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate([5.0, 9.0, 9.0, 7.0, 5.0, None, 1.0, 9.0])], "id string, v double")
    got = [(r.id, r.rank) for r in A.strongest(df, "v", ["id"], 5, "rank").collect()]
    assert got == [("r1", 1), ("r2", 1), ("r7", 1), ("r3", 4), ("r0", 5)]


def test_hotspots_and_years(spark):
    top = A.hotspots(gold(spark), 3).collect()
    assert [r.total_incendios for r in top] == [3, 3, 3] and [r.grid_id for r in top] == ["c0", "c1", "c2"]
    assert {r.porcentaje_del_total_global for r in top} == {20.0}
    years = A.yearly_change(gold(spark)).collect()
    assert [y.anio for y in years] == [2020, 2022, 2024]
    assert years[0].incendios_anio_anterior is None and years[1].incendios_anio_anterior == years[0].incendios_este_anio


def test_segments_first_match_wins(spark):
    df = spark.createDataFrame([(31, 21, 10), (31, 20, 10), (30, 21, 10), (30, 20, 29), (30, 20, 30), (None, 21, 10), (None, None, None)], "t int, w int, h int")
    got = [r[0] for r in df.select(climate_segment(F.col("t"), F.col("w"), F.col("h"))).collect()]
    assert got == ["Extremo (Calor+Viento)", "Ola de Calor", "Viento Fuerte", "Sequía Extrema", "Normal / Otro", "Viento Fuerte", "Normal / Otro"]


def test_blocks_and_deltas(spark):
    rows = [("a", dt.datetime(2020, 1, 1, h), float(h), 350.0 if h % 2 else 10.0, h % 3) for h in range(24) if not 6 <= h < 12]
    df = spark.createDataFrame(rows, "k string, ts timestamp, t double, dir double, code int")
    blocks = roll_up(df, ["k"], "ts", means=["t"], maxima=["code"], directions=["dir"], modes=[])
    got = {r.block_start.hour: r for r in block_deltas(blocks, ["k"], "block_start", {"dt": "t"}).collect()}
    assert sorted(got) == [0, 12, 18] and got[0].t == 2.5
    assert got[12].dt is None and got[18].dt == 6.0
    assert min(got[0].dir, 360 - got[0].dir) == pytest.approx(0.0, abs=1e-9)
    (mode,) = roll_up(df.filter("hour(ts) < 6"), ["k"], "ts", modes=["code"]).collect()
    assert mode.code == 0 and mode.hours_in_block == 6


def test_temporal_split_has_gaps_and_no_overlap(spark):
    hours = spark.range(24 * 12).selectExpr("timestamp'2020-01-01' + make_interval(0,0,0,0,id,0,0) AS ts")
    ranges = [("train", "2020-01-01", "2020-01-09"), ("validation", "2020-01-05", "2020-01-09"), ("test", "2020-01-09", "2020-01-12")]
    rows = temporal_split(hours, "ts", ranges, 12).collect()
    count = {s: len([r for r in rows if r.split == s]) for s in ("train", "validation", "test", None)}
    assert count == {"train": 84, "validation": 84, "test": 60, None: 60}
    last_train = max(r.ts for r in rows if r.split == "train")
    assert last_train == dt.datetime(2020, 1, 4, 11)


def test_sweep_against_brute_force(spark):
    rows = [((i * 37 % 100) / 100, int((i * 37 % 100) > 40 and i % 3 > 0)) for i in range(90)] + [(1.0, 1)]
    df = spark.createDataFrame(rows, "score double, target int")
    sweep = threshold_sweep(df, "score", "target", 10)
    for r in sweep.collect():
        tp = sum(y for s, y in rows if min(int(s * 10), 9) >= round(r.threshold * 10))
        fp = sum(1 - y for s, y in rows if min(int(s * 10), 9) >= round(r.threshold * 10))
        assert (r.tp, r.fp, r.positives) == (tp, fp, sum(y for _, y in rows))
        p, q = tp / (tp + fp), tp / r.positives
        assert r.f2 == pytest.approx(5 * p * q / (4 * p + q) if tp else 0.0)
    best = best_threshold(sweep).first()
    assert best.f2 == max(r.f2 for r in sweep.collect())
    assert [r.tpr for r in pr_curve(sweep).collect()] == sorted(r.tpr for r in pr_curve(sweep).collect())
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert roc_auc(df) == pytest.approx(want)


def test_class_ratio_and_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (0, 0), (1, 0)], "target int, predicted int")
    assert tuple(class_ratio(df).first()) == (3, 2, 1.5)
    assert class_ratio(df.limit(0)).first()["ratio"] is None
    assert tuple(confusion(df, [F.lit("all").alias("g")], "predicted", "target").first()) == ("all", 1, 1, 1, 2, 0.5)


def test_models_are_seeded_and_learn(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 AS double) AS a", "cast(id % 7 AS double) AS b", "cast(id % 20 > 14 AS int) AS target")
    one, two = (fit_forest(df, ["a", "b"], positive_weight=3.0, trees=5, depth=3) for _ in range(2))
    first = {r.id: r.score for r in score(one, df).collect()}
    assert first == {r.id: r.score for r in score(two, df).collect()}
    assert roc_auc(score(one, df)) > 0.95
    assert feature_importance(one, spark).first()["feature"] == "a"
    assert roc_auc(score(fit_margin(df, ["a", "b"]), df)) > 0.95
    assert roc_auc(score(fit_boosted(df, ["a", "b"], rounds=2, depth=2), df)) > 0.95
    sweep = weight_sweep(df.filter("id < 300"), df.filter("id >= 300"), ["a", "b"], "target", [1.0, 5.0], trees=5, depth=3)
    rows = sweep.collect()
    assert len(rows) == 2 and rows[0].f2 >= rows[1].f2


def test_scores_that_are_none(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (None, 1), (float("nan"), 0), (1.5, 1), (-0.1, 0)], "s double, y int")
    top = threshold_sweep(df, "s", "y").orderBy(F.desc("threshold")).first()
    assert (top.threshold, top.tp, top.fp, top.positives, top.negatives) == (0.99, 1, 0, 2, 2)
    r = score_report(df, "s").first()
    assert (r.usable, r.below, r.above, r["nan"], r.missing) == (2, 1, 1, 1, 1)


def test_audit_reads_its_table_once(spark, tmp_path):
    rows = [(f"c{i % 3}", dt.date(2020, 1, 1 + i % 2), 1.0, float(i % 3), None if i == 4 else 1.0) for i in range(12)]
    spark.createDataFrame(rows, "cell string, day date, latitude double, longitude double, x double").write.parquet(f"{tmp_path}/t")
    out = Q.audit(spark.read.parquet(f"{tmp_path}/t"), "cell", "day", ["x"], 3, 2, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/t" not in plan
    got = {(r.check, r.subject): (r.observed, r.expected) for r in out.collect()}
    assert got == {("volume", "table"): (12, 12), ("points", "table"): (3, 3), ("null_coordinates", "table"): (0, 0), ("nulls", "x"): (1, 0)}


def test_rank_auc_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randint(-3, 3) / 4, rng.randint(0, 1)) for _ in range(300)] + [(-0.0, 1), (0.0, 0)]
    df = spark.createDataFrame([*rows, (None, 1), (float("nan"), 0), (0.5, None), (0.5, 7)], "score double, target int")
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = rank_auc(df.repartition(7)).first()
    assert (got.positives, got.negatives) == (len(pos), len(neg)) and got.auc == pytest.approx(want, abs=1e-15)
    assert rank_auc(df.filter("target = 1")).first().auc is None
    empty = rank_auc(df.limit(0)).first()
    assert (empty.positives, empty.negatives, empty.auc) == (0, 0, None)


def test_time_folds_keep_blocks_together(spark):
    hours = spark.range(24 * 20).select((F.lit(dt.datetime(2020, 1, 1)).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    rows = time_folds(hours, "ts", 3, 48, 12).orderBy("ts").collect()
    assert sum(r.fold is None for r in rows) == 12 * 10
    last = {}
    for r in rows:
        if r.fold is not None:
            assert all(r.ts - at >= dt.timedelta(hours=13) for f, at in last.items() if f != r.fold)
            last[r.fold] = r.ts
    assert set(last) == {0, 1, 2}


def test_fold_sweep_learns_on_the_other_folds(spark):
    # the feature tells the label in folds 0 and 1 and its opposite in fold 2
    rows = spark.range(600).selectExpr("id % 3 AS fold", "id % 2 AS y", "cast(if(id % 3 = 2, 1 - id % 2, id % 2) AS double) AS x", "cast(null AS double) AS void")
    rows = rows.unionByName(rows.limit(10).withColumn("fold", F.lit(None).cast("bigint")))
    got = {(r.positive_weight, r.fold): r for r in fold_sweep(filled(rows, ["x", "void"]), ["x", "void"], "y", "fold", [1.0, 5.0], trees=3, depth=2).collect()}
    assert set(got) == {(w, f) for w in (1.0, 5.0) for f in range(3)}
    # learned from folds that say the opposite, fold 2 is best judged by taking nearly everything
    assert got[1.0, 2].precision < 0.6


def test_losses_count_in_the_pass(spark, tmp_path):
    losses = Losses()
    read = losses.watch(spark.range(10).toDF("v"), "silver_fires", read=F.count(F.lit(1)))
    kept = losses.watch(read.filter("v % 3 = 0"), "silver_fires", kept=F.count(F.lit(1)), odd=F.count_if(F.col("v") % 2 == 1))
    kept.write.parquet(f"{tmp_path}/out")
    assert losses.lines() == [("silver_fires", "read", 10), ("silver_fires", "kept", 4), ("silver_fires", "odd", 2), ("silver_fires", "repeated", 6)]


def test_kept_counts_add_up(spark):
    days = [("a", dt.date(2020, 1, d), 1.0, 2.0, None if h else 3.0) for d in (1, 2) for h in range(24)] + [("b", dt.date(2020, 1, 1), None, 2.0, 1.0)]
    df = spark.createDataFrame(days, "c string, d date, latitude double, longitude double, x double")
    whole = sorted(map(str, Q.audit(df, "c", "d", ["x"], 1, 2).collect()))
    halves = [Q.audit_counts(part, ["x"], "c", "d") for part in (df.filter("x IS NULL"), df.filter("x IS NOT NULL"))]
    assert sorted(map(str, Q.audit_of(halves[0].unionByName(halves[1]), ["x"], "c", "d", 1, 2).collect())) == whole
