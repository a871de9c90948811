"""Windows over time: rolling, lags, labels, blocks, dry runs and as-of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.functions.timekeys import HOUR
from emberscope.operators import frames as R
from emberscope.plans.features import ROLLING, block_features, gold_features, memory_features, training_table

from .joins import _CELLS, _NEAREST, neighbour_links
from .base import GOLD_COLUMNS, VARIABLES, complete_gold, doubles, gold, mean_direction_sql, plain, query, table, weather, with_sql

KEYS, TS = ["grid_id"], "timestamp_clima"
_ROLL = """
  SELECT *, sum(precipitation) OVER (w ROWS 168 PRECEDING) AS precip_acum_7d, sum(precipitation) OVER (w ROWS 72 PRECEDING) AS precip_acum_3d,
         max(temperature_2m) OVER (w ROWS 72 PRECEDING) AS temp_max_3d
  FROM {source} WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)"""
_ROLL_NAMES = ["precip_acum_7d", "precip_acum_3d", "temp_max_3d"]


@query(with_sql("weather", f"SELECT grid_id, timestamp_clima, {doubles(*_ROLL_NAMES)} FROM rolled", rolled=_ROLL.format(source="weather")))
def rolling_rows(spark, sf_dir):
    """169- and 73-row frames over the observed hours, gaps included."""
    return plain(R.over_rows(weather(spark, sf_dir), KEYS, TS, ROLLING).select(*KEYS, TS, *_ROLL_NAMES))


def _range(fn: str, column: str, hours: int) -> str:
    return f"{fn}({column}) OVER (w RANGE BETWEEN INTERVAL {hours * HOUR - 1} SECOND PRECEDING AND CURRENT ROW)"


def six(expr: str, name: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(28,6)) AS DOUBLE) AS {name}"


_TIME_COLUMNS = ",\n".join(
    f"CAST({_range('sum', 'precipitation', h)} AS DOUBLE) AS precipitation_sum_{h}h, "
    f"CAST({_range('sum', 'temperature_2m', h)} AS DOUBLE) / CAST(nullif({_range('count', 'temperature_2m', h)}, 0) AS DOUBLE) AS temperature_2m_mean_{h}h"
    for h in (24, 48, 96)
)


@query(
    with_sql(
        "weather",
        f"SELECT grid_id, timestamp_clima, {_TIME_COLUMNS} FROM weather WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)",
    )
)
def rolling_time(spark, sf_dir):
    frames = []
    for h in (24, 48, 96):
        frames.append(R.trailing(f"precipitation_sum_{h}h", "precipitation", "sum", h * HOUR))
        frames.append(R.trailing(f"temperature_2m_mean_{h}h", "temperature_2m", "mean", h * HOUR))
    framed = R.over_time(weather(spark, sf_dir), KEYS, TS, frames)
    return plain(framed.select(*KEYS, TS, *[f.name for f in frames]))


@query(
    with_sql(
        "weather",
        "SELECT grid_id, timestamp_clima, "
        + ", ".join(six(_range("sum", c, h), f"{c}_sum_{h}h") for c in ("precipitation", "temperature_2m") for h in (24, 96))
        + " FROM weather WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)",
    )
)
def rolling_time_double(spark, sf_dir):
    """The same frames over DOUBLE columns, whose sums are added up frame by frame."""
    names = ("precipitation", "temperature_2m")
    w = weather(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in names})
    frames = [R.trailing(f"{c}_sum_{h}h", c, "sum", h * HOUR) for c in names for h in (24, 96)]
    framed = R.over_time(w, KEYS, TS, frames)
    return plain(framed.select(*KEYS, TS, *[F.col(f.name).cast("decimal(28,6)").alias(f.name) for f in frames]))


_LAGS = [(c, h) for c in ("temperature_2m", "wind_speed_10m") for h in (6, 12, 24, 48)]


@query(
    with_sql(
        "weather",
        "SELECT grid_id, timestamp_clima, "
        + ", ".join(
            f"CAST(max({c}) OVER (PARTITION BY grid_id ORDER BY timestamp_clima RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL {h} HOUR PRECEDING) AS DOUBLE) AS {c}_lag_{h}h"
            for c, h in _LAGS
        )
        + " FROM weather",
    )
)
def lag_exact(spark, sf_dir):
    frames = [R.lagged(f"{c}_lag_{h}h", c, h * HOUR) for c, h in _LAGS]
    return plain(R.over_time(weather(spark, sf_dir), KEYS, TS, frames).select(*KEYS, TS, *[f.name for f in frames]))


_HORIZON = """CASE WHEN timestamp_clima + INTERVAL 12 HOUR <= max(timestamp_clima) OVER (PARTITION BY grid_id) THEN
  max(target) OVER (PARTITION BY grid_id ORDER BY timestamp_clima RANGE BETWEEN INTERVAL 1 SECOND FOLLOWING AND INTERVAL 12 HOUR FOLLOWING) END"""


@query(with_sql("complete_gold", f"SELECT grid_id, timestamp_clima, target, {_HORIZON} AS target_ahead FROM complete_gold"))
def horizon_label(spark, sf_dir):
    labelled = R.horizon_label(complete_gold(spark, sf_dir), KEYS, TS, "target")
    return plain(labelled.select(*KEYS, TS, "target", "target_ahead"))


_DRY = """
  SELECT *, CASE WHEN precipitation = 0 THEN sum(CASE WHEN precipitation = 0 THEN 1 ELSE 0 END)
            OVER (PARTITION BY grid_id, island ORDER BY timestamp_clima) ELSE 0 END AS dry
  FROM (SELECT *, sum(CASE WHEN precipitation = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY grid_id ORDER BY timestamp_clima) AS island
        FROM {source}) AS i"""


@query(
    with_sql(
        "complete_gold",
        "SELECT grid_id, timestamp_clima, CAST(dry AS BIGINT) AS dry_hours FROM dried",
        filled="SELECT grid_id, timestamp_clima, coalesce(precipitation, CASE WHEN hour(timestamp_clima) = 13 THEN NULL ELSE 0 END) AS precipitation FROM complete_gold",
        dried=_DRY.format(source="filled"),
    )
)
def dry_run(spark, sf_dir):
    """Hours without a measurement count as dry here, except at 13 h, where they stay unknown."""
    assumed = F.when(F.hour(TS) != 13, F.lit(0).cast("decimal(8,2)"))
    hourly = complete_gold(spark, sf_dir).select(*KEYS, TS, F.coalesce("precipitation", assumed).alias("precipitation"))
    return plain(R.dry_run(hourly, KEYS, TS, "precipitation").select(*KEYS, TS, "dry_hours"))


_BLOCK = f"""
  SELECT grid_id, time_bucket(INTERVAL 6 HOUR, timestamp_clima, TIMESTAMP '2000-01-01') AS block_start, count(*) AS hours_in_block,
         CAST(sum(temperature_2m) AS DOUBLE) / CAST(nullif(count(temperature_2m), 0) AS DOUBLE) AS temperature_2m,
         CAST(sum(relative_humidity_2m) AS DOUBLE) / CAST(nullif(count(relative_humidity_2m), 0) AS DOUBLE) AS relative_humidity_2m,
         CAST(sum(vapour_pressure_deficit) AS DOUBLE) / CAST(nullif(count(vapour_pressure_deficit), 0) AS DOUBLE) AS vapour_pressure_deficit,
         CAST(sum(wind_speed_10m) AS DOUBLE) / CAST(nullif(count(wind_speed_10m), 0) AS DOUBLE) AS wind_speed_10m,
         CAST(sum(precipitation) AS DOUBLE) AS precipitation, CAST(sum(et0_fao_evapotranspiration) AS DOUBLE) AS et0_fao_evapotranspiration,
         CAST(max(wind_gusts_10m) AS DOUBLE) AS wind_gusts_10m, max(target) AS target,
         {mean_direction_sql('wind_direction_10m')} AS wind_direction_10m
  FROM gold GROUP BY 1, 2"""
_MODE = """
  SELECT grid_id, block_start, weather_code FROM (
    SELECT *, row_number() OVER (PARTITION BY grid_id, block_start ORDER BY n DESC, weather_code) AS r FROM (
      SELECT grid_id, time_bucket(INTERVAL 6 HOUR, timestamp_clima, TIMESTAMP '2000-01-01') AS block_start, weather_code, count(*) AS n
      FROM gold GROUP BY 1, 2, 3) AS c) AS d WHERE r = 1"""


def _delta(column: str) -> str:
    before = f"max({column}) OVER (PARTITION BY grid_id ORDER BY block_start RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR PRECEDING)"
    return f"{column} - {before} AS {column}_delta"


@query(
    with_sql(
        "gold",
        f"""SELECT b.*, m.weather_code, {_delta('temperature_2m')}, {_delta('vapour_pressure_deficit')}, {_delta('wind_speed_10m')}
FROM block AS b JOIN (SELECT grid_id AS g, block_start AS s, weather_code FROM modes) AS m ON m.g = b.grid_id AND m.s = b.block_start""",
        block=_BLOCK,
        modes=_MODE,
    )
)
def block_6h(spark, sf_dir):
    """Six-hour blocks and their change against the block before."""
    blocks = block_features(gold(spark, sf_dir))
    return plain(blocks.withColumn("wind_direction_10m", F.col("wind_direction_10m").cast("decimal(20,3)")))


@query(
    with_sql(
        "complete_gold",
        "SELECT grid_id, timestamp_clima, target, "
        + ", ".join(
            f"CAST(max({c}) OVER (w RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL {h} HOUR PRECEDING) AS DOUBLE) AS {c}_lag_{h}h"
            for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m")
            for h in (6, 12, 24, 48)
        )
        + f", {_TIME_COLUMNS}, CAST(dry AS BIGINT) AS dry_hours, {_HORIZON} AS target_ahead "
        + "FROM dried WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)",
        dried=_DRY.format(source="complete_gold"),
    )
)
def memory_feature_table(spark, sf_dir):
    """Lags, rolling values, dry hours and the look-ahead label on the complete hourly series."""
    source = complete_gold(spark, sf_dir)
    built = memory_features(source)
    made = [c for c in built.columns if c not in source.columns]
    return plain(built.select("grid_id", TS, "target", *made))


INDEX = "CAST(wind_speed_10m AS DOUBLE) * CAST(temperature_2m AS DOUBLE) / (CAST(relative_humidity_2m AS DOUBLE) + 1) AS fire_spread_index"
CYCLES = ", ".join(
    [
        six("sin(2 * pi() * hour(timestamp_clima) / 24)", "hour_sin"),
        six("cos(2 * pi() * hour(timestamp_clima) / 24)", "hour_cos"),
        six("sin(2 * pi() * month(timestamp_clima) / 12)", "month_sin"),
        six("cos(2 * pi() * month(timestamp_clima) / 12)", "month_cos"),
    ]
)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in GOLD_COLUMNS)
_REST = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in VARIABLES)


@query(
    with_sql(
        "gold",
        f"""SELECT grid_id, timestamp_clima, latitude, longitude, elevation, {_REST}, target, {doubles('fire_intensity')}, fire_confidence,
{doubles(*_ROLL_NAMES)}, {INDEX}, {CYCLES}
FROM rolled WHERE {_COMPLETE}""",
        rolled=_ROLL.format(source="gold"),
    )
)
def feature_table(spark, sf_dir):
    """The labelled table with all coded features, without rows that lack a value."""
    built = gold_features(gold(spark, sf_dir))
    rounded = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
    return plain(built.withColumns({c: F.col(c).cast("decimal(28,6)") for c in rounded}))


@query(
    """
WITH monthly AS (
  SELECT o_custkey, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS since, CAST(max(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS monthly_value
  FROM orders GROUP BY 1, 2)
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, m.monthly_value
FROM orders AS o ASOF LEFT JOIN monthly AS m ON m.o_custkey = o.o_custkey AND m.since <= o.o_orderdate"""
)
def asof_monthly(spark, sf_dir):
    """Each order with the greatest price its customer paid in the latest earlier month that has one."""
    o = table(spark, sf_dir, "orders")
    since = F.add_months(F.trunc("o_orderdate", "month"), 1).cast("timestamp_ntz")
    monthly = o.groupBy("o_custkey", since.alias("since")).agg(F.max("o_totalprice").alias("monthly_value"))
    left = o.select("o_orderkey", "o_custkey", "o_orderdate")
    return R.as_of_join(left, monthly, ["o_custkey"], "o_orderdate", "since", "monthly_value", 90 * 24 * HOUR)


_SEASON = ", ".join(
    six(f"{fn}(2 * pi() * {part}(b.block_start) / {n})", f"{part}_{fn}") for part, n in (("hour", 24), ("month", 12)) for fn in ("sin", "cos")
)
_LAG_COLUMNS = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m")


TRAINING_SQL = with_sql(
        "complete_gold",
        f"""SELECT b.*, w.weather_code, {_delta('temperature_2m')}, {_delta('vapour_pressure_deficit')}, {_delta('wind_speed_10m')},
       m.* EXCLUDE (grid_id, block_start), {six('n.temperature_near', 'temperature_near')}, {six('n.humidity_near', 'humidity_near')}, n.fires_near, {_SEASON}
FROM block AS b LEFT JOIN modes AS w ON w.grid_id = b.grid_id AND w.block_start = b.block_start
LEFT JOIN memory AS m ON m.grid_id = b.grid_id AND m.block_start = b.block_start
LEFT JOIN near AS n ON n.grid_id = b.grid_id AND n.block_start = b.block_start
QUALIFY m.grid_id IS NOT NULL""".replace("b.*,", "b.*, ").replace("OVER (PARTITION BY grid_id ORDER BY block_start", "OVER (PARTITION BY b.grid_id ORDER BY b.block_start"),
        block=_BLOCK.replace("FROM gold", "FROM complete_gold"),
        modes=_MODE.replace("FROM gold", "FROM complete_gold WHERE weather_code IS NOT NULL"),
        dried=_DRY.format(source="complete_gold"),
        hours="SELECT grid_id, timestamp_clima, time_bucket(INTERVAL 6 HOUR, timestamp_clima, TIMESTAMP '2000-01-01') AS block_start, "
        + ", ".join(
            f"CAST(max({c}) OVER (w RANGE BETWEEN INTERVAL {h} HOUR PRECEDING AND INTERVAL {h} HOUR PRECEDING) AS DOUBLE) AS {c}_lag_{h}h"
            for c in _LAG_COLUMNS
            for h in (6, 12, 24, 48)
        )
        + f", {_TIME_COLUMNS}, CAST(dry AS BIGINT) AS dry_hours, {_HORIZON} AS target_ahead "
        + "FROM dried WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp_clima)",
        memory="SELECT * EXCLUDE (timestamp_clima) FROM hours WHERE hour(timestamp_clima) % 6 = 5",
        cells=_CELLS,
        nearest=_NEAREST,
        near="""SELECT own.grid_id, own.block_start, avg(o.temperature_2m) AS temperature_near, avg(o.relative_humidity_2m) AS humidity_near,
         CAST(sum(o.target) AS BIGINT) AS fires_near
  FROM block AS own JOIN nearest AS n ON n.cell_id = own.grid_id
  LEFT JOIN block AS o ON o.grid_id = n.neighbour AND o.block_start = own.block_start GROUP BY 1, 2""",
    )


@query(TRAINING_SQL, name="training_table")
def training(spark, sf_dir):
    """Six-hour blocks of every cell with base values, changes, memory, neighbours, season and the 12 h label."""
    links = neighbour_links(spark, sf_dir)
    out = training_table(complete_gold(spark, sf_dir), links, link_rows=2 * links.count())
    digits = ["temperature_near", "humidity_near", "hour_sin", "hour_cos", "month_sin", "month_cos"]
    rounded = {c: F.col(c).cast("decimal(28,6)") for c in digits} | {"wind_direction_10m": F.col("wind_direction_10m").cast("decimal(20,3)")}
    return plain(out.withColumns(rounded))
