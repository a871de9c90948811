"""How the domain roles map onto the test tables, in Spark and in SQL.

Cell = user; weather = the user's non-error events of one hour; detections =
error events. Measurements stay DECIMAL until the last projection, so that both
engines add exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope import vocabulary as V
from emberscope.functions.timekeys import hour_floor
from emberscope.operators.spine import complete, hourly_spine
from emberscope.plans.gold import JOIN_KEYS, gold_full, keyed_by_place
from emberscope.session import pin_utc

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its own or the given name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin_utc(spark), sf_dir)

        REGISTRY[name or fn.__name__] = (run, sql)
        return fn

    return register


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE and timestamps without zone, the types the SQL side returns."""
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            casts[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            casts[f.name] = F.col(f.name).cast("timestamp_ntz")
    return df.withColumns(casts) if casts else df


# --- Spark side -------------------------------------------------------------


def latitude(user: Column) -> Column:
    return (F.lit(-325) + user % F.lit(20)).cast("double") / F.lit(10.0)


def longitude(user: Column) -> Column:
    return (F.lit(-650) + F.floor(user / F.lit(20))).cast("double") / F.lit(10.0)


def located_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.col("value").cast("decimal(8,2)").alias("v"),
        latitude(F.col("user_id")).alias("latitude"),
        longitude(F.col("user_id")).alias("longitude"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(F.lit("l"), F.lit("n"), F.lit("h"))
    return located_events(spark, sf_dir).filter(F.col("event_type") == "error").select(
        "event_id",
        "latitude",
        "longitude",
        F.to_date("ts").alias("fecha_join"),
        F.hour("ts").alias("hora_join"),
        F.get(letters, (F.col("event_id") % 3).cast("int")).alias("confidence"),
        F.col("v").alias("frp"),
    )


def cell_columns() -> list[Column]:
    user = F.col("user_id")
    return [
        user.cast("string").alias("grid_id"),
        latitude(user).alias("latitude"),
        longitude(user).alias("longitude"),
        (user.cast("double") * F.lit(1.5)).alias("elevation"),
    ]


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed hours only: (user_id, hour, 12 variables)."""
    events = located_events(spark, sf_dir).filter(F.col("event_type") != "error")

    def beside(n: int) -> Column:
        """The reading, missing for every n-th event, so that some hours lack it."""
        return F.when(F.col("event_id") % n != 0, F.col("v"))

    bought = F.when(F.col("event_type") == "purchase", F.col("v"))
    n = F.count(F.lit(1))
    return events.groupBy("user_id", hour_floor(F.col("ts")).alias("timestamp_clima")).agg(
        F.max("v").alias("temperature_2m"),
        F.max(beside(4)).alias("relative_humidity_2m"),
        F.min(beside(7)).alias("vapour_pressure_deficit"),
        F.coalesce(F.sum(bought), F.lit(0)).cast("decimal(8,2)").alias("precipitation"),
        F.max(beside(5)).alias("wind_speed_10m"),
        (F.sum("event_id") % 360).cast("double").alias("wind_direction_10m"),
        F.max("v").alias("wind_gusts_10m"),
        F.min("v").alias("et0_fao_evapotranspiration"),
        (n.cast("double") / F.lit(10.0)).alias("soil_moisture_0_to_7cm"),
        ((F.min("event_id") % 100).cast("double") / F.lit(100.0)).alias("soil_moisture_28_to_100cm"),
        (n % 4).cast("double").alias("weather_code"),
        F.lit(0.0).alias("snow_depth"),
    )


def _as_weather(hours: DataFrame) -> DataFrame:
    keyed = hours.withColumns({"fecha_join": F.to_date("timestamp_clima"), "hora_join": F.hour("timestamp_clima")})
    return keyed.select("*", *cell_columns(), F.lit("events").alias("source_filename")).drop("user_id")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed hours in the shape of the typed weather table."""
    return _as_weather(measurements(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, timestamp_clima) for every user and every hour of the period."""
    ts = table(spark, sf_dir, "events").select(hour_floor(F.col("ts")).alias("h"))
    start = ts.agg(F.min("h")).scalar()
    end = ts.agg(F.max("h") + F.expr("interval 1 hour")).scalar()
    return hourly_spine(users(spark, sf_dir), start, end, "timestamp_clima")


def complete_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather rows for every user and hour, null where nothing was measured.

    Hours and measurements meet by the keys of the label join (a user has a place of their own), so the completed hours, which are
    many and mostly empty, are not shuffled once more for the detections.
    """
    measured = keyed_by_place(weather(spark, sf_dir)).select(*JOIN_KEYS, *V.CLIMATE_VARIABLES)
    return complete(measured.hint("shuffle_hash"), keyed_by_place(_as_weather(spine(spark, sf_dir))), JOIN_KEYS)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_full(weather(spark, sf_dir), detections(spark, sf_dir))


def complete_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_full(complete_weather(spark, sf_dir), detections(spark, sf_dir), hashed=True)


def orders_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of the labelled table: several years and all months."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("grid_id"),
        F.col("o_orderdate").alias("timestamp_clima"),
        latitude(F.col("o_custkey")).alias("latitude"),
        longitude(F.col("o_custkey")).alias("longitude"),
        (key % 45).cast("decimal(8,2)").alias("temperature_2m"),
        (key % 37).cast("decimal(8,2)").alias("wind_speed_10m"),
        (key % 100).cast("decimal(8,2)").alias("relative_humidity_2m"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("target"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("fire_intensity"),
        (key % 4).cast("int").alias("fire_confidence"),
        key.alias("o_orderkey"),
    )


# --- SQL side ---------------------------------------------------------------

VARIABLES = [
    "temperature_2m",
    "relative_humidity_2m",
    "vapour_pressure_deficit",
    "precipitation",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "et0_fao_evapotranspiration",
    "soil_moisture_0_to_7cm",
    "soil_moisture_28_to_100cm",
    "weather_code",
]
GOLD_COLUMNS = ["grid_id", "timestamp_clima", "latitude", "longitude", "elevation", *VARIABLES]


def doubles(*names: str, prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{n} AS DOUBLE) AS {n}" for n in names)


def mean_direction_sql(column: str) -> str:
    """Circular mean to three digits; null where the directions cancel out."""
    sin, cos = f"avg(sin(radians({column})))", f"avg(cos(radians({column})))"
    mean = f"CAST(CAST((degrees(atan2({sin}, {cos})) + 360) % 360 AS DECIMAL(20,3)) AS DOUBLE)"
    return f"CASE WHEN sqrt(pow({sin}, 2) + pow({cos}, 2)) > 1e-9 THEN {mean} END"


PARTS = {
    "ev": """
  SELECT event_id, user_id, event_type, ts, CAST(value AS DECIMAL(8,2)) AS v, date_trunc('hour', ts) AS h,
         CAST(-325 + user_id % 20 AS DOUBLE) / 10 AS latitude, CAST(-650 + user_id // 20 AS DOUBLE) / 10 AS longitude
  FROM events""",
    "fires": """
  SELECT CAST(ts AS DATE) AS fecha_join, CAST(hour(ts) AS INTEGER) AS hora_join, latitude, longitude,
         (['l', 'n', 'h'])[event_id % 3 + 1] AS confidence, v AS frp
  FROM ev WHERE event_type = 'error'""",
    "measured": """
  SELECT user_id, h AS timestamp_clima,
         max(v) AS temperature_2m,
         max(v) FILTER (WHERE event_id % 4 <> 0) AS relative_humidity_2m,
         min(v) FILTER (WHERE event_id % 7 <> 0) AS vapour_pressure_deficit,
         CAST(coalesce(sum(v) FILTER (WHERE event_type = 'purchase'), 0) AS DECIMAL(8,2)) AS precipitation,
         max(v) FILTER (WHERE event_id % 5 <> 0) AS wind_speed_10m,
         CAST(sum(event_id) % 360 AS DOUBLE) AS wind_direction_10m,
         max(v) AS wind_gusts_10m,
         min(v) AS et0_fao_evapotranspiration,
         CAST(count(*) AS DOUBLE) / 10 AS soil_moisture_0_to_7cm,
         CAST(min(event_id) % 100 AS DOUBLE) / 100 AS soil_moisture_28_to_100cm,
         CAST(count(*) % 4 AS DOUBLE) AS weather_code,
         CAST(0 AS DOUBLE) AS snow_depth
  FROM ev WHERE event_type <> 'error' GROUP BY user_id, h""",
    "spine": """
  SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp_clima
  FROM (SELECT DISTINCT user_id FROM events) AS u, (SELECT min(h) AS lo, max(h) AS hi FROM ev) AS b""",
    "complete": """
  SELECT s.user_id, s.timestamp_clima, m.* EXCLUDE (user_id, timestamp_clima)
  FROM spine AS s LEFT JOIN measured AS m ON m.user_id = s.user_id AND m.timestamp_clima = s.timestamp_clima""",
}


def _weather_sql(source: str) -> str:
    return f"""
  SELECT CAST(user_id AS VARCHAR) AS grid_id, CAST(timestamp_clima AS DATE) AS fecha_join,
         CAST(hour(timestamp_clima) AS INTEGER) AS hora_join,
         CAST(-325 + user_id % 20 AS DOUBLE) / 10 AS latitude, CAST(-650 + user_id // 20 AS DOUBLE) / 10 AS longitude,
         CAST(user_id AS DOUBLE) * 1.5 AS elevation, {source}.*
  FROM {source}"""


def _gold_sql(weather_part: str, confidence: str = "CASE max(confidence) WHEN 'l' THEN 1 WHEN 'n' THEN 2 WHEN 'h' THEN 3 ELSE 0 END",
              where: str = "true") -> str:
    columns = ", ".join(f"w.{c}" for c in GOLD_COLUMNS)
    return f"""
  SELECT {columns}, CASE WHEN f.frp IS NULL THEN 0 ELSE 1 END AS target,
         coalesce(f.frp, 0) AS fire_intensity, coalesce(f.code, 0) AS fire_confidence
  FROM {weather_part} AS w LEFT JOIN (
    SELECT fecha_join, hora_join, latitude, longitude, {confidence} AS code, max(frp) AS frp
    FROM fires WHERE {where} GROUP BY fecha_join, hora_join, latitude, longitude) AS f
  ON f.fecha_join = w.fecha_join AND f.hora_join = w.hora_join AND f.latitude = w.latitude AND f.longitude = w.longitude"""


gold_sql = _gold_sql
PARTS["weather"] = _weather_sql("measured")
PARTS["complete_weather"] = _weather_sql("complete")
PARTS["gold"] = _gold_sql("weather")
PARTS["complete_gold"] = _gold_sql("complete_weather")
PARTS["orders_gold"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS grid_id, o_orderdate AS timestamp_clima,
         CAST(-325 + o_custkey % 20 AS DOUBLE) / 10 AS latitude, CAST(-650 + o_custkey // 20 AS DOUBLE) / 10 AS longitude,
         CAST(o_orderkey % 45 AS DECIMAL(8,2)) AS temperature_2m, CAST(o_orderkey % 37 AS DECIMAL(8,2)) AS wind_speed_10m,
         CAST(o_orderkey % 100 AS DECIMAL(8,2)) AS relative_humidity_2m,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
         CAST(o_totalprice AS DECIMAL(12,2)) AS fire_intensity, CAST(o_orderkey % 4 AS INTEGER) AS fire_confidence, o_orderkey
  FROM orders"""

CHAIN = {
    "ev": ["ev"],
    "fires": ["ev", "fires"],
    "weather": ["ev", "measured", "weather"],
    "spine": ["ev", "spine"],
    "complete_weather": ["ev", "measured", "spine", "complete", "complete_weather"],
    "gold": ["ev", "fires", "measured", "weather", "gold"],
    "complete_gold": ["ev", "fires", "measured", "spine", "complete", "complete_weather", "complete_gold"],
    "orders_gold": ["orders_gold"],
}


def with_sql(needed: str, select: str, **extra: str) -> str:
    """``select`` behind the common table expressions that ``needed`` (space-separated) stands on."""
    names: list[str] = []
    for n in needed.split():
        names += [p for p in CHAIN[n] if p not in names]
    parts = [f"{n} AS ({PARTS[n]})" for n in names] + [f"{n} AS ({body})" for n, body in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select
