import math

import pytest
from pyspark.sql import functions as F

from emberscope import vocabulary as V
from emberscope.functions.spatial import grid_key, morton, snap
from emberscope.operators.grid import GridSpec, _candidates, _uncrowded, assign_node, grid_nodes, nearest_nodes, neighbour_mean
from emberscope.plans.gold import gold_full
from emberscope.plans.silver import silver_grid
from emberscope.session import Scratch


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.mark.parametrize(("box", "size"), [(V.BOX_160, 160), (V.BOX_800, 800)])
def test_grid_sizes_and_half_open_edges(spark, box, size):
    spec = GridSpec.of_degrees(box)
    rows = grid_nodes(spark, spec).collect()
    assert spec.size == size == len(rows) == len({r.cell_id for r in rows})
    south, north, west, east = box
    assert min(r.latitude for r in rows) == south and max(r.latitude for r in rows) == round(north - 0.1, 2)
    assert min(r.longitude for r in rows) == west and max(r.longitude for r in rows) == round(east - 0.1, 2)
    assert all(r.cell_id == f"{r.latitude}_{r.longitude}" for r in rows)


def test_empty_grid(spark):
    assert grid_nodes(spark, GridSpec(0, 0, 0, 100, 10)).count() == 0


def test_snap_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(-31.25,), (-31.35,), (0.05,), (None,), (float("nan"),)], "x double")
    got = df.select(snap(F.col("x")).alias("s"), grid_key(F.col("x")).alias("k")).collect()
    assert [r.k for r in got] == [-313, -314, 1, None, None]
    assert [r.s for r in got[:3]] == [-31.3, -31.4, 0.1]


def test_every_grid_line_has_a_key(spark):
    """Cells past 360 degrees, as many users make them, once lost their detections and their node."""
    values = [(377.5,), (-512.3,), (2.0e8,), (3.0e8,), (float("inf"),), (-1.0e300,)]
    df = spark.createDataFrame(values, "x double")
    assert [r.k for r in df.select(grid_key(F.col("x")).alias("k")).collect()] == [3775, -5123, 2_000_000_000, None, None, None]
    grid = silver_grid(spark.createDataFrame([("far", -32.4, 377.5)], "cell_id string, latitude double, longitude double"))
    points = spark.createDataFrame([(-32.4, 377.5)], "latitude double, longitude double")
    assert assign_node(points, grid).first().grid_id == "far"
    hour = "'x' AS grid_id, TIMESTAMP_NTZ'2024-01-08 04:00:00' AS timestamp_clima, DATE'2024-01-08' AS fecha_join, 4 AS hora_join, -32.4D AS latitude, 377.5D AS longitude"
    weather = spark.sql(f"SELECT {hour}, 1.0D AS elevation").withColumns({c: F.lit(1.0) for c in V.CLIMATE_VARIABLES})
    fires = spark.sql(f"SELECT {hour}, 'n' AS confidence, 80.06D AS frp")
    got = gold_full(weather, fires).first()
    assert (got.target, got.fire_intensity, got.fire_confidence) == (1, 80.06, 2)


def test_assignment_keeps_points_outside(spark):
    grid = silver_grid(grid_nodes(spark, GridSpec.of_degrees(V.BOX_160)))
    points = spark.createDataFrame([(1, -31.24, -64.41), (2, 0.0, 0.0), (3, None, -64.4)], "id int, latitude double, longitude double")
    for rows in (160, None, 10**9):
        got = {r.id: r.grid_id for r in assign_node(points, grid, grid_rows=rows).collect()}
        assert got == {1: "-31.2_-64.4", 2: None, 3: None}


def test_silver_grid_drops_null_coordinates(spark):
    landing = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "cell_id string, latitude double, longitude double")
    rows = silver_grid(landing).collect()
    assert [r.grid_id for r in rows] == ["a"] and rows[0].fecha_procesamiento is not None


GRIDS = {
    "box": [(r / 10 - 32, c / 10 - 65) for r in range(6) for c in range(5)],
    "line": [(-31.0, c / 10) for c in range(30)],
    "sparse": [(-30.0, 0.0), (-30.0, 0.1), (-27.0, 2.0), (-30.5, 7.0), (-31.0, 0.3), (-29.1, 0.0), (-35.0, 1.0), (-30.0, 3.0), (-33.0, 3.0), (-30.2, 0.0), (-28.0, 5.0)],
    "few": [(-30.0, 0.0), (-30.0, 0.1), (-30.1, 0.0)],
    "north": [(70 + r / 10, c / 10) for r in range(5) for c in range(12)],
}


@pytest.mark.parametrize("name", GRIDS)
def test_nearest_nodes_against_brute_force(spark, name):
    nodes = [(f"n{i:03d}", *p) for i, p in enumerate(GRIDS[name])]
    df = spark.createDataFrame(nodes, "cell_id string, latitude double, longitude double")
    got = {}
    for r in nearest_nodes(df).collect():
        got.setdefault(r.cell_id, []).append((r.position, r.neighbour))
    for node, *at in nodes:
        want = sorted((round(km(at, p), 6), other) for other, *p in nodes if other != node)[:8]
        assert [n for _, n in sorted(got[node])] == [n for _, n in want]


def test_a_crowd_starts_with_narrower_cubes(spark):
    """Many nodes in one cube once all became candidates of each other."""
    crowd = [(f"c{i}", (i % 20) / 1000, (i // 20) / 1000) for i in range(400)] + [("far", 5.0, 5.0)]
    points = spark.createDataFrame(crowd, "cell_id string, latitude double, longitude double")
    a, o = F.radians("latitude"), F.radians("longitude")
    on_sphere = points.select("cell_id", (F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"), F.lit(0).alias("level"))
    levels = {r.cell_id: r.level for r in _uncrowded(on_sphere, 2 * math.sin(math.radians(0.3) / 2), Scratch(spark)).collect()}
    assert len(levels) == 401 and levels["far"] == 0 and max(levels[f"c{i}"] for i in range(400)) < -1
    place = {n: (la, lo) for n, la, lo in crowd}
    got = {}
    for r in nearest_nodes(points).collect():
        got.setdefault(r.cell_id, []).append((r.position, r.neighbour))
    for node in ("c0", "c210", "c399", "far"):
        want = sorted((round(km(place[node], place[n]), 6), n) for n in place if n != node)[:8]
        assert [n for _, n in sorted(got[node])] == [n for _, n in want]


def test_candidates_meet_by_cube_and_not_through_the_driver(spark):
    """A node's 27 probes count as one for the planner, so those of a large grid were broadcast."""
    nodes = spark.range(300).selectExpr("concat('n', id) AS node", "0.0D AS lat", "id / 10D AS lon", "id / 1000D AS x", "0.0D AS y", "0.0D AS z")
    got = _candidates(nodes, nodes, 0.01, 8, 4)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 300 * 8


def test_neighbour_mean_same_by_broadcast_and_by_shuffle(spark):
    nodes = spark.createDataFrame([(f"n{i}", *p) for i, p in enumerate(GRIDS["few"])], "cell_id string, latitude double, longitude double")
    links = nearest_nodes(nodes)
    hourly = spark.createDataFrame(
        [("n0", 1, 10.0, 1, 350.0), ("n1", 1, 20.0, 0, 10.0), ("n2", 1, None, 1, 10.0), ("n0", 2, 5.0, 0, 90.0)],
        "cell_id string, t int, x double, fire int, dir double",
    )
    args = ("cell_id", "t", {"x": "x"}, {"fires": "fire"}, {"dir": "dir"})
    small = {(r.cell_id, r.t): r for r in neighbour_mean(hourly, links, *args, neighbour_rows=6).collect()}
    large = {(r.cell_id, r.t): r for r in neighbour_mean(hourly, links, *args).collect()}
    assert small == large
    assert small["n0", 1].x == 20.0 and small["n0", 1].fires == 1
    assert small["n1", 1].x == 10.0 and small["n1", 1].dir == pytest.approx(0.0, abs=1e-9)
    assert ("n0", 2) not in small and small["n2", 2].x == 5.0


def test_neighbour_mean_of_many_links_shuffles_no_match(spark):
    """Beyond the broadcast, the eightfold matches once went through the shuffle."""
    hourly = spark.range(400).selectExpr("cast(id % 20 as string) AS cell_id", "id div 20 AS t", "cast(id AS double) AS x")
    links = spark.range(160).selectExpr("cast(id % 20 as string) AS cell_id", "cast((id % 20 + id div 20 + 1) % 20 as string) AS neighbour")
    got = neighbour_mean(hourly, links, "cell_id", "t", {"m": "x"}, keep_empty=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the lists, the hours by node with their lists, the hours by time; the aggregates behind stand on the last
    behind = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "Generate inline" in behind and behind.count("HashAggregate") == 2 and behind.count("Exchange") == 1
    wide = {(r.cell_id, r.t): r.m for r in got.collect()}
    assert wide == {(str(c), t): sum(20 * t + (c + k) % 20 for k in range(1, 9)) / 8 for c in range(20) for t in range(20)}


def test_neighbour_mean_shuffles_the_hours_once(spark):
    hourly = spark.range(10).selectExpr("cast(id as string) AS cell_id", "id % 3 AS t", "1.0 AS x")
    links = spark.range(10).selectExpr("cast(id as string) AS cell_id", "cast(id + 1 as string) AS neighbour")
    plan = neighbour_mean(hourly, links, "cell_id", "t", {"x": "x"}, neighbour_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_morton_is_injective_and_local(spark):
    cells = spark.range(800).selectExpr("id div 20 AS r", "id % 20 AS c").select("r", "c", morton(F.col("r"), F.col("c")).alias("z"))
    rows = cells.collect()
    assert len({r.z for r in rows}) == 800
    want = lambda r, c: sum(((r >> i & 1) << 2 * i) | ((c >> i & 1) << 2 * i + 1) for i in range(16))
    assert all(r.z == want(r.r, r.c) for r in rows)


def test_nearest_nodes_over_wide_gaps(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.1, 0.1), ("c", 80.0, 170.0), ("d", -80.0, -179.9)], "cell_id string, latitude double, longitude double")
    got = nearest_nodes(nodes, count=2).collect()
    assert sorted((r.cell_id, r.position) for r in got) == [(n, p) for n in "abcd" for p in (1, 2)]
    assert {r.neighbour for r in got if r.cell_id == "a" and r.position == 1} == {"b"}


def test_a_time_without_neighbours_has_nulls(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "n string, neighbour string")
    hours = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("b", 1, 7.0)], "n string, t int, x double")
    got = {(r.n, r.t): r.m for r in neighbour_mean(hours, links, "n", "t", means={"m": "x"}, keep_empty=True).collect()}
    assert got == {("a", 1): 7.0, ("b", 1): 5.0, ("a", 2): None, ("b", 2): 6.0}


def _round_the_pole(south, north, step):
    return [(round(a / 10, 1), round(o / 10, 1)) for a in range(round(south * 10), round(north * 10), round(step * 10)) for o in range(-1800, 1800, 600 if a < 890 else 150)]


SPHERE = {
    "meridian": [(round(a / 10, 1), round(o / 10, 1)) for a in range(-3, 3) for o in [*range(-1800, -1795), *range(1796, 1800)]],
    "dense pole": [(round(89 + a / 10, 1), round(o / 10, 1)) for a in range(0, 10, 3) for o in range(-1800, 1800, 60)],
    "both poles": [*_round_the_pole(88.0, 90.0, 0.5), *[(-a, o) for a, o in _round_the_pole(88.0, 90.0, 0.5)]],
    "globe": [(float(a), float(o)) for a in range(-80, 90, 20) for o in range(-180, 180, 30)],
}


@pytest.mark.parametrize("name", SPHERE)
def test_nearest_nodes_on_the_sphere(spark, name):
    nodes = [(f"n{i:04d}", *p) for i, p in enumerate(SPHERE[name])]
    df = spark.createDataFrame(nodes, "cell_id string, latitude double, longitude double")
    got = {}
    for r in nearest_nodes(df).collect():
        got.setdefault(r.cell_id, []).append((r.position, r.distance_km))
    for node, *at in nodes:
        want = sorted(km(at, p) for other, *p in nodes if other != node)[:8]
        assert [d for _, d in sorted(got[node])] == pytest.approx(want, abs=2e-6)
