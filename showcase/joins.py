"""Pre-aggregation, label join, orphans, grid assignment and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope import vocabulary as V
from emberscope.functions.spatial import grid_key
from emberscope.operators.grid import GridSpec, assign_node, grid_nodes, nearest_nodes, neighbour_mean
from emberscope.operators.spine import complete
from emberscope.plans.gold import fires_without_weather, gold_full, store_keyed
from emberscope.plans.silver import silver_grid

from .base import (
    GOLD_COLUMNS,
    VARIABLES,
    complete_gold,
    detections,
    doubles,
    gold,
    gold_sql,
    located_events,
    mean_direction_sql,
    plain,
    query,
    spine,
    users,
    weather,
    latitude,
    longitude,
    with_sql,
)
from .tables import new_schema

GOLD_SELECT = (
    f"grid_id, timestamp_clima, latitude, longitude, elevation, {doubles(*VARIABLES)}, target, "
    f"{doubles('fire_intensity')}, fire_confidence"
)


@query(with_sql("gold", f"SELECT {GOLD_SELECT} FROM gold"))
def label_join(spark, sf_dir):
    return plain(gold(spark, sf_dir))


@query(with_sql("gold", f"SELECT {GOLD_SELECT} FROM gold"))
def label_join_bucketed(spark, sf_dir):
    """The same from hourly rows that are stored by their join keys, so that only detections are shuffled."""
    name = f"{new_schema(spark, 'bucketed')}.weather"
    store_keyed(weather(spark, sf_dir), name, 8)
    return plain(gold_full(spark.read.table(name), detections(spark, sf_dir)))


_CONFIDENCE = {
    "lexical": ("CASE max(confidence) WHEN 'l' THEN 1 WHEN 'n' THEN 2 WHEN 'h' THEN 3 ELSE 0 END", "true"),
    "ordinal": ("max(CASE confidence WHEN 'l' THEN 1 WHEN 'n' THEN 2 WHEN 'h' THEN 3 ELSE 0 END)", "true"),
    "nominal_high": ("max(CASE confidence WHEN 'l' THEN 1 WHEN 'n' THEN 2 WHEN 'h' THEN 3 ELSE 0 END)", "confidence IN ('n', 'h')"),
}
_MODES_SQL = "\nUNION ALL\n".join(
    f"SELECT '{mode}' AS mode, grid_id, timestamp_clima, target, {doubles('fire_intensity')}, fire_confidence FROM ("
    + gold_sql("weather", code, where)
    + ") AS g"
    for mode, (code, where) in _CONFIDENCE.items()
)


@query(with_sql("fires weather", _MODES_SQL))
def label_join_confidence(spark, sf_dir):
    w, d = weather(spark, sf_dir), detections(spark, sf_dir)
    variants = {
        "lexical": gold_full(w, d),
        "ordinal": gold_full(w, d, "ordinal"),
        "nominal_high": gold_full(w, d, "ordinal", ("n", "h")),
    }
    columns = ["grid_id", "timestamp_clima", "target", "fire_intensity", "fire_confidence"]
    parts = [df.select(F.lit(mode).alias("mode"), *columns) for mode, df in variants.items()]
    return plain(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    with_sql(
        "fires weather",
        f"""
SELECT f.fecha_join, f.hora_join, f.latitude, f.longitude, {doubles('fire_intensity', prefix='f.')}, f.fire_confidence
FROM (SELECT fecha_join, hora_join, latitude, longitude, max(frp) AS fire_intensity,
             CASE max(confidence) WHEN 'l' THEN 1 WHEN 'n' THEN 2 WHEN 'h' THEN 3 ELSE 0 END AS fire_confidence
      FROM fires GROUP BY fecha_join, hora_join, latitude, longitude) AS f
ANTI JOIN weather AS w ON w.fecha_join = f.fecha_join AND w.hora_join = f.hora_join
  AND w.latitude = f.latitude AND w.longitude = f.longitude""",
    )
)
def orphan_fires(spark, sf_dir):
    return plain(fires_without_weather(weather(spark, sf_dir), detections(spark, sf_dir)))


def _nodes_sql(spec: GridSpec) -> str:
    return f"""
  SELECT r, c, CAST(CAST({spec.south} + {spec.step} * r AS DOUBLE) / 100 AS VARCHAR) || '_' ||
         CAST(CAST({spec.west} + {spec.step} * c AS DOUBLE) / 100 AS VARCHAR) AS cell_id,
         CAST({spec.south} + {spec.step} * r AS DOUBLE) / 100 AS latitude,
         CAST({spec.west} + {spec.step} * c AS DOUBLE) / 100 AS longitude
  FROM range({spec.rows}) AS a(r), range({spec.columns}) AS b(c)"""


def _coverage(spark, sf_dir, spec):
    """Every node of the grid with the events that fall on it."""
    keys = lambda lat, lon: {"row": grid_key(F.col(lat)), "col": grid_key(F.col(lon))}
    events = located_events(spark, sf_dir).withColumns(keys("latitude", "longitude"))
    counted = events.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    nodes = grid_nodes(spark, spec).withColumns(keys("latitude", "longitude"))
    covered = nodes.join(counted, ["row", "col"], "left")
    return plain(
        covered.select("cell_id", "latitude", "longitude", F.coalesce("n", F.lit(0)).alias("n_events"), "total")
    )


def _coverage_sql(spec: GridSpec) -> str:
    return with_sql(
        "ev",
        f"""
SELECT n.cell_id, n.latitude, n.longitude, count(e.event_id) AS n_events, CAST(sum(e.v) AS DOUBLE) AS total
FROM nodes AS n LEFT JOIN ev AS e ON round(e.latitude * 10) = round(n.latitude * 10) AND round(e.longitude * 10) = round(n.longitude * 10)
GROUP BY n.cell_id, n.latitude, n.longitude""",
        nodes=_nodes_sql(spec),
    )


SPEC_160, SPEC_800 = GridSpec.of_degrees(V.BOX_160, V.STEP_DEGREES), GridSpec.of_degrees(V.BOX_800, V.STEP_DEGREES)


@query(_coverage_sql(SPEC_160))
def grid_coverage_160(spark, sf_dir):
    return _coverage(spark, sf_dir, SPEC_160)


@query(_coverage_sql(SPEC_800))
def grid_coverage_800(spark, sf_dir):
    return _coverage(spark, sf_dir, SPEC_800)


@query(
    with_sql(
        "ev",
        f"""
SELECT e.event_id, e.latitude, e.longitude, {doubles('v', prefix='e.')}, n.cell_id AS grid_id
FROM ev AS e LEFT JOIN nodes AS n ON n.latitude = e.latitude AND n.longitude = e.longitude""",
        nodes=_nodes_sql(SPEC_160),
    )
)
def grid_snap_join(spark, sf_dir):
    grid = silver_grid(grid_nodes(spark, SPEC_160)).drop("fecha_procesamiento")
    points = located_events(spark, sf_dir).select("event_id", "latitude", "longitude", "v")
    return plain(assign_node(points, grid, grid_rows=SPEC_160.size))


def _cells(spark, sf_dir):
    user = F.col("user_id")
    return users(spark, sf_dir).select(user.cast("string").alias("cell_id"), latitude(user).alias("latitude"), longitude(user).alias("longitude"))


def neighbour_links(spark, sf_dir):
    return nearest_nodes(_cells(spark, sf_dir)).withColumnRenamed("cell_id", "grid_id")


_NEAREST = """
  SELECT cell_id, neighbour, distance_km, position FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance_km, neighbour) AS position FROM (
      SELECT a.cell_id, b.cell_id AS neighbour,
             round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2)
               + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2)))), 6) AS distance_km
      FROM cells AS a, cells AS b WHERE a.cell_id <> b.cell_id) AS d) AS r
  WHERE position <= 8"""
_CELLS = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS cell_id, latitude, longitude FROM ev"


@query(
    with_sql(
        "ev",
        "SELECT cell_id, neighbour, round(distance_km, 4) AS distance_km, CAST(position AS INTEGER) AS position FROM nearest",
        cells=_CELLS,
        nearest=_NEAREST,
    )
)
def nearest_cells(spark, sf_dir):
    return nearest_nodes(_cells(spark, sf_dir)).withColumn("distance_km", F.round("distance_km", 4))


@query(
    with_sql(
        "complete_gold",
        f"""
SELECT n.cell_id AS grid_id, own.timestamp_clima,
       CAST(sum(g.temperature_2m) AS DOUBLE) / CAST(nullif(count(g.temperature_2m), 0) AS DOUBLE) AS temperature_near,
       CAST(sum(g.precipitation) AS DOUBLE) / CAST(nullif(count(g.precipitation), 0) AS DOUBLE) AS precipitation_near,
       CAST(sum(g.target) AS BIGINT) AS fires_near,
       {mean_direction_sql('g.wind_direction_10m')} AS wind_direction_near
FROM (SELECT DISTINCT grid_id, timestamp_clima FROM complete_gold) AS own
JOIN nearest AS n ON n.cell_id = own.grid_id
LEFT JOIN complete_gold AS g ON g.grid_id = n.neighbour AND g.timestamp_clima = own.timestamp_clima
GROUP BY n.cell_id, own.timestamp_clima""",
        cells=_CELLS,
        nearest=_NEAREST,
    ),
    name="neighbour_mean",
)
def neighbour_means(spark, sf_dir):
    """Mean climate and number of fires of the eight nearest cells at the same hour."""
    links = neighbour_links(spark, sf_dir)
    near = neighbour_mean(
        complete_gold(spark, sf_dir),
        links,
        "grid_id",
        "timestamp_clima",
        means={"temperature_near": "temperature_2m", "precipitation_near": "precipitation"},
        sums={"fires_near": "target"},
        directions={"wind_direction_near": "wind_direction_10m"},
        exact_means=["temperature_2m", "precipitation"],
        neighbour_rows=2 * links.count(),
        keep_empty=True,
    )
    return near.withColumn("wind_direction_near", F.col("wind_direction_near").cast("decimal(20,3)").cast("double"))
