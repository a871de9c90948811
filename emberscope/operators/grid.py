"""Regular point grids, assignment of points to nodes, and nearest-node means."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.indices import direction_of
from ..functions.spatial import EARTH_RADIUS_KM, great_circle_km, grid_key
from ..session import Scratch

# A broadcast side may hold at most this many rows of a few dozen bytes.
BROADCAST_ROWS = 1_000_000
# Links gathered in lists take some twenty bytes each.
BROADCAST_LINKS = 4_000_000


@dataclass(frozen=True)
class GridSpec:
    """A half-open box in hundredths of a degree, so that nodes never drift by float addition."""

    south: int
    north: int
    west: int
    east: int
    step: int

    @classmethod
    def of_degrees(cls, box: tuple[float, float, float, float], step: float = 0.1) -> GridSpec:
        return cls(*[round(100 * edge) for edge in box], round(100 * step))

    @property
    def rows(self) -> int:
        return max(0, -((self.south - self.north) // self.step))

    @property
    def columns(self) -> int:
        return max(0, -((self.west - self.east) // self.step))

    @property
    def size(self) -> int:
        return self.rows * self.columns


def grid_nodes(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All nodes as (cell_id, latitude, longitude); each row follows from its number, no product is formed."""
    n = spark.range(spec.size)
    row = F.floor(F.col("id") / F.lit(spec.columns or 1))
    lat = F.lit(spec.south) + row * F.lit(spec.step)
    lon = F.lit(spec.west) + (F.col("id") - row * F.lit(spec.columns)) * F.lit(spec.step)
    nodes = n.select((lat / F.lit(100.0)).alias("latitude"), (lon / F.lit(100.0)).alias("longitude"))
    return nodes.select(cell_id(F.col("latitude"), F.col("longitude")).alias("cell_id"), "latitude", "longitude")


def cell_id(lat: Column, lon: Column) -> Column:
    """Text identity of a node."""
    return F.concat_ws("_", lat.cast("string"), lon.cast("string"))


def assign_node(
    points: DataFrame,
    grid: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    node: str = "grid_id",
    grid_lat: str = "latitude_centroid",
    grid_lon: str = "longitude_centroid",
    grid_rows: int | None = None,
    per_degree: int = 10,
) -> DataFrame:
    """Left join of points with the grid node they snap to; null outside the grid.

    ``grid_rows`` is the known size of the grid (``GridSpec.size``). Only a grid
    known to be small is broadcast; otherwise the planner decides from its own
    statistics and a hot node is split by the adaptive skew join.
    """
    keyed = grid.select(
        grid_key(F.col(grid_lat), per_degree).alias("__row"),
        grid_key(F.col(grid_lon), per_degree).alias("__col"),
        F.col(node),
    )
    if grid_rows is not None and grid_rows <= BROADCAST_ROWS:
        keyed = F.broadcast(keyed)
    located = points.withColumns({"__row": grid_key(F.col(lat), per_degree), "__col": grid_key(F.col(lon), per_degree)})
    return located.join(keyed, ["__row", "__col"], "left").drop("__row", "__col")


def nearest_nodes(
    grid: DataFrame,
    count: int = 8,
    node: str = "cell_id",
    lat: str = "latitude",
    lon: str = "longitude",
    step: float = 0.1,
    reach: int = 3,
) -> DataFrame:
    """The ``count`` nearest other nodes of every node on the sphere: (node, neighbour, distance_km, position).

    Nodes are points of the unit sphere, sorted into cubes of some width, so the 180th meridian and the poles are places like any other.
    A node's candidates are the nodes of its own and the 26 cubes around, which hold all within one width. A node is
    settled once its ``count``-th candidate is nearer than that; the others go round again with twice the width, so sparse or narrow
    grids are exact too. The first width is ``reach`` steps, less where the meridians draw together and where over ``CROWD`` nodes
    share a cube: nodes near a pole or in a crowd start with narrower cubes and are settled before the others begin, so a node's
    candidates do not grow with the number of nodes in one place. Only nodes that exist become candidates, however wide the gaps.
    """
    scratch = Scratch(grid.sparkSession)
    a, o = F.radians(F.col(lat).cast("double")), F.radians(F.col(lon).cast("double"))
    # 0 for half of the globe, then one less each time the meridians draw together by half
    level = F.greatest(F.least(F.floor(F.log2(F.greatest(F.cos(a), F.lit(2.0**NARROWEST)))) + 1, F.lit(0)), F.lit(NARROWEST))
    base = scratch.put(
        grid.select(
            F.col(node).alias("node"),
            F.col(lat).cast("double").alias("lat"),
            F.col(lon).cast("double").alias("lon"),
            (F.cos(a) * F.cos(o)).alias("x"),
            (F.cos(a) * F.sin(o)).alias("y"),
            F.sin(a).alias("z"),
            level.cast("int").alias("level"),
        ),
        "grid",
    )
    full = 2 * math.sin(math.radians(step * reach) / 2)
    base = _uncrowded(base, full, scratch)
    shape = base.agg(*[(F.max(c) - F.min(c)).alias(c) for c in _SPACE], F.min("level").alias("first"), F.count(F.lit(1)).alias("nodes")).first()
    extent, now = max(shape[c] or 0.0 for c in _SPACE), shape["first"] or 0
    tasks = max(8, -(-shape["nodes"] // NODES_PER_TASK))
    open_nodes, parts = base, []
    while True:
        width = full * 2.0**now
        last = width >= extent
        # in the last round all nodes meet all, which are few or far apart
        ranked = scratch.put(_candidates(open_nodes.filter((F.col("level") <= now) | F.lit(last)), base, width, count, tasks), "nearest")
        if last:
            parts.append(ranked)
            break
        # the shortest way over the sphere to a point one width away; distances are rounded to a millimetre
        safe = 2 * EARTH_RADIUS_KM * math.asin(min(1.0, width / 2)) - 1e-5
        settled = (
            ranked.groupBy("node")
            .agg(F.count(F.lit(1)).alias("found"), F.max("distance_km").alias("far"))
            .filter((F.col("found") >= count) & (F.col("far") < safe))
            .select("node")
            .hint("shuffle_hash")
        )
        parts.append(ranked.join(settled, "node", "left_semi"))
        open_nodes = scratch.put(open_nodes.join(settled, "node", "left_anti"), "open")
        if open_nodes.isEmpty():
            break
        now += 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    links = scratch.put(result.select(F.col("node").alias(node), "neighbour", "distance_km", "position"), "links")
    scratch.clear(links)
    return links


_SPACE = ("x", "y", "z")
#: Cubes are at most so many powers of two narrower than at the equator.
NARROWEST = -10
#: Nodes that may share a cube of the first width.
CROWD = 16
#: Nodes whose candidates are sorted in one task, on average.
NODES_PER_TASK = 1_000


def _cube(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(width))


def _uncrowded(base: DataFrame, full: float, scratch: Scratch) -> DataFrame:
    """``base`` with levels lowered, one at a time, where over ``CROWD`` nodes share a cube of that level."""
    lowest = base.agg(F.min("level")).first()[0] or 0
    for level in range(0, NARROWEST, -1):
        cubes = [_cube(c, full * 2.0**level).alias(f"c{c}") for c in _SPACE]
        crowded = base.groupBy(*cubes).agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("top")).filter((F.col("n") > CROWD) & (F.col("top") == level))
        crowded = scratch.put(crowded.select(*[f"c{c}" for c in _SPACE], F.lit(True).alias("crowded")), "crowded")
        if crowded.isEmpty():
            if level <= lowest:
                break
            continue
        marked = base.select("*", *cubes).join(crowded, [f"c{c}" for c in _SPACE], "left")
        lower = F.when(F.col("crowded"), F.least("level", F.lit(level - 1))).otherwise(F.col("level"))
        base = scratch.put(marked.select(*[c for c in base.columns if c != "level"], lower.alias("level")), "grid")
    return base


def _candidates(nodes: DataFrame, base: DataFrame, width: float, count: int, tasks: int) -> DataFrame:
    """Ranked candidates from the cubes around each node. The probes are few beside the pairs they make, so the number of tasks is stated.

    So is the join: the planner takes the 27 probes of a node for one, and once sent all of them through the driver to every executor.
    """
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    probes = nodes.select("node", "lat", "lon", *[_cube(c, width).alias(f"c{c}") for c in _SPACE])
    for c in _SPACE:
        probes = probes.withColumn("d", F.explode(around)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d")).drop("d")
    probes = probes.repartition(tasks, *[f"c{c}" for c in _SPACE])
    others = base.select(F.col("node").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *[_cube(c, width).alias(f"c{c}") for c in _SPACE])
    pairs = probes.join(others.hint("merge"), [f"c{c}" for c in _SPACE]).filter("node <> neighbour").withColumn(
        "distance_km", F.round(great_circle_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6)
    )
    nearest = Window.partitionBy("node").orderBy("distance_km", "neighbour")
    return (
        pairs.withColumn("position", F.row_number().over(nearest))
        .filter(F.col("position") <= count)
        .select("node", "neighbour", "distance_km", "position")
    )


def neighbour_mean(
    hourly: DataFrame,
    neighbours: DataFrame,
    node: str,
    ts: str,
    means: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    directions: Mapping[str, str] | None = None,
    neighbour_rows: int | None = None,
    exact_means: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Means, sums and circular means over the neighbours at the same time: (node, ts, outputs) for each time of a node that has neighbours.

    A node's time at which no neighbour was observed has no row, or with ``keep_empty`` a row of nulls: its own row
    then stands beside its neighbours' without counting.

    The mappings go from output name to input column. The links are gathered to one row for each neighbour, with the list of
    the nodes it stands beside. The hourly rows are shuffled once by time and only then multiplied and aggregated in place, so the
    eightfold rows never cross the network. ``neighbour_rows`` is the known number of links: up to ``BROADCAST_LINKS`` the lists are
    broadcast, beyond it an hourly row meets its list in a join before and takes it along. A null is no node.
    """
    means, sums, directions = dict(means or {}), dict(sums or {}), dict(directions or {})
    used = sorted({*means.values(), *sums.values()})
    # Sine and cosine are taken once per row, before the rows multiply.
    vectors = {}
    for name, column in directions.items():
        angle = F.radians(F.col(column))
        vectors[f"__sin_{name}"], vectors[f"__cos_{name}"] = F.sin(angle), F.cos(angle)
    values = hourly.select(F.col(node).alias("neighbour"), ts, *used, *[v.alias(n) for n, v in vectors.items()])
    links = neighbours.select("neighbour", F.col(node).alias("__node"))
    if keep_empty:
        links = links.unionByName(neighbours.select(F.col(node).alias("neighbour")), allowMissingColumns=True)
    small = neighbour_rows is not None and neighbour_rows <= BROADCAST_LINKS
    # a stated number of parts stays: merged by their size before they multiply, they would be too large behind
    parts = int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the lists leave out nulls, which stand for the node's own row here
    own = F.lit(keep_empty) & F.bool_or(F.col("__node").isNull())
    # lists to be broadcast are gathered by ranges, so that the only hash shuffle of that plan is the one of the hours
    lists = (links.repartitionByRange(parts, "neighbour") if small else links).groupBy("neighbour")
    lists = lists.agg(F.collect_list("__node").alias("__beside"), own.alias("__own"))
    if small:
        listed = values.repartition(parts, ts).join(F.broadcast(lists), "neighbour")
    else:
        listed = values.join(lists.hint("shuffle_hash"), "neighbour").repartition(parts, ts)
    beside = F.transform("__beside", lambda n: F.struct(n.alias(node), F.lit(True).alias("__near")))
    itself = F.array(F.struct(F.col("neighbour").alias(node), F.lit(False).alias("__near")))
    targets = F.when(F.col("__own"), F.concat(beside, itself)).otherwise(beside)
    carried = [ts, *used, *vectors]
    matched = listed.select(*carried, F.inline(targets))
    near = lambda column: F.when(F.col("__near"), F.col(column))
    return matched.groupBy(node, ts).agg(
        *[_mean(near(column), column in exact_means).alias(name) for name, column in means.items()],
        *[F.sum(near(column)).alias(name) for name, column in sums.items()],
        *[direction_of(F.avg(near(f"__sin_{name}")), F.avg(near(f"__cos_{name}"))).alias(name) for name in directions],
    )


def _mean(column: Column, exact: bool) -> Column:
    if not exact:
        return F.avg(column)
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))
