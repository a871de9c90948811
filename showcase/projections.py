"""Projections, filters, nested data, casts, time parsing and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.functions.indices import spread_index
from emberscope.functions.timekeys import acquisition_time, cyclic, iso_time, pad_time
from emberscope.operators.analysis import preview
from emberscope.operators.dedup import keep_first
from emberscope.operators.nested import build_documents, to_json_text, zip_explode
from emberscope.operators.quality import rows_with_null
from emberscope.plans.silver import silver_fires, silver_weather
from emberscope.sources.files import parse_json
from emberscope.vocabulary import CLIMATE_VARIABLES, WEATHER_SCHEMA

from .base import GOLD_COLUMNS, VARIABLES, doubles, gold, plain, query, table, weather, with_sql
from .joins import GOLD_SELECT


@query(
    """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_totalprice AS DOUBLE) / 100 AS price_hundreds,
       year(o_orderdate)::INTEGER AS order_year, 'orders' AS dataset
FROM orders"""
)
def projection_basic(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (
        o.withColumnRenamed("o_orderkey", "order_id")
        .withColumn("price_hundreds", F.col("o_totalprice") / 100)
        .withColumn("order_year", F.year("o_orderdate"))
        .withColumn("dataset", F.lit("orders"))
        .drop("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
        .select("order_id", F.col("o_custkey").alias("customer_id"), "price_hundreds", "order_year", "dataset")
    )


@query(
    with_sql(
        "gold",
        f"""SELECT {GOLD_SELECT} FROM gold
WHERE (relative_humidity_2m IS NULL OR wind_speed_10m IS NULL) AND target = 1""",
    )
)
def filters_nulls(spark, sf_dir):
    return plain(rows_with_null(gold(spark, sf_dir), ["relative_humidity_2m", "wind_speed_10m"]).filter("target = 1"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def preview_ordered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return preview(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 50)


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(amount, 1) AS DOUBLE) AS r1,
       CAST(round(amount, 2) AS DOUBLE) AS r2, CAST(amount AS DOUBLE) AS r4
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS amount FROM lineitem) AS l"""
)
def round_digits(spark, sf_dir):
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    rounded = [F.round(amount, d).cast("double").alias(f"r{d}") for d in (1, 2, 4)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *rounded)


@query(
    """
SELECT vec_id, label, i - 1 AS position, CAST(embedding[i] AS DOUBLE) AS long_series,
       CASE WHEN i <= 10 + label THEN CAST(embedding[i] AS DOUBLE) END AS short_series,
       CASE WHEN label <> 0 THEN CAST(embedding[i] AS DOUBLE) END AS optional_series
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) AS e"""
)
def explode_parallel_arrays(spark, sf_dir):
    """Series of unequal length, one of them absent in some rows, zipped by position."""
    e = F.col("embedding").cast("array<double>")
    arrays = {
        "position": F.sequence(F.lit(0).cast("long"), F.size("embedding").cast("long") - 1),
        "long_series": e,
        "short_series": F.slice(e, F.lit(1), F.lit(10) + F.col("label")),
        "optional_series": F.when(F.col("label") != 0, e),
    }
    return zip_explode(table(spark, sf_dir, "embeddings"), ["vec_id", "label"], arrays)


@query(
    with_sql(
        "weather",
        f"""
SELECT grid_id, timestamp_clima, fecha_join, hora_join, {doubles(*VARIABLES, 'snow_depth')}, elevation, latitude, longitude
FROM weather""",
    )
)
def landing_document_roundtrip(spark, sf_dir):
    """Hourly rows to nested JSON documents and back through the weather plan."""
    w = weather(spark, sf_dir)
    docs = build_documents(
        w.withColumnRenamed("grid_id", "cell_id"), "cell_id", "timestamp_clima", CLIMATE_VARIABLES, ["latitude", "longitude", "elevation"]
    )
    named = docs.select(
        "cell_id",
        F.col("latitude").alias("request_latitude"),
        F.col("longitude").alias("request_longitude"),
        F.col("elevation").alias("elevation_val"),
        "hourly",
    )
    bronze = to_json_text(named).select(*parse_json(F.col("value"), WEATHER_SCHEMA), F.lit("memory").alias("source_filename"))
    grid = w.select("grid_id", F.col("latitude").alias("latitude_centroid"), F.col("longitude").alias("longitude_centroid")).distinct()
    return plain(silver_weather(bronze, grid).drop("source_filename"))


@query(
    """
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n
  FROM lineitem) AS l WHERE n = 1"""
)
def dedup_first(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """
SELECT event_id, clock, try_strptime(strftime(ts, '%Y-%m-%d') || ' ' || substr(clock, 1, 2) || ':' || substr(clock, 3, 2) || ':00',
       '%Y-%m-%d %H:%M:%S') AS acquired,
       CAST(date_trunc('second', ts) AS TIMESTAMP) AS iso
FROM (SELECT event_id, ts, substr(lpad(CAST(hhmm AS VARCHAR), greatest(4, length(CAST(hhmm AS VARCHAR)))::INTEGER, '0'), 1, 4) AS clock
      FROM (SELECT event_id, ts, hour(ts) * 100 + minute(ts) + CASE WHEN event_id % 10 = 0 THEN 60 ELSE 0 END AS hhmm
            FROM events) AS a) AS b"""
)
def time_parse(spark, sf_dir):
    """Clock numbers without padding, some with minutes past 59, and ISO text with a T."""
    e = table(spark, sf_dir, "events")
    hhmm = F.hour("ts") * 100 + F.minute("ts") + F.when(F.col("event_id") % 10 == 0, 60).otherwise(0)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    padded = e.select("event_id", "ts", pad_time(hhmm).alias("clock"), iso.alias("text"))
    return plain(
        padded.select(
            "event_id",
            "clock",
            acquisition_time(F.to_date("ts"), F.col("clock")).alias("acquired"),
            iso_time(F.col("text")).alias("iso"),
        )
    )


@query(
    """
SELECT 'events' AS source, event_id AS id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS number,
       try_cast(event_type AS DOUBLE) AS not_a_number FROM events
UNION ALL
SELECT 'documents', doc_id, try_cast(trim(CAST(n_chars AS VARCHAR)) AS DOUBLE), try_cast(text AS DOUBLE) FROM documents"""
)
def safe_cast(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.lit("events").alias("source"),
        F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").try_cast("double").alias("number"),
        F.col("event_type").try_cast("double").alias("not_a_number"),
    )
    d = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"),
        F.col("doc_id").alias("id"),
        F.col("n_chars").cast("string").try_cast("double").alias("number"),
        F.col("text").try_cast("double").alias("not_a_number"),
    )
    return e.unionByName(d)


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * l_extendedprice / (l_discount + 1) AS fire_spread_index FROM lineitem""",
    name="spread_index",
)
def spread_index_lines(spark, sf_dir):
    index = spread_index(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", index.alias("fire_spread_index")
    )


def _six(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(12,6)) AS DOUBLE)"


@query(
    f"""
SELECT event_id, {_six('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {_six('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos,
       {_six('sin(2 * pi() * month(ts) / 12)')} AS month_sin, {_six('cos(2 * pi() * month(ts) / 12)')} AS month_cos
FROM events"""
)
def cyclic_time(spark, sf_dir):
    hour, month = cyclic(F.hour("ts"), 24), cyclic(F.month("ts"), 12)
    names = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
    six = [c.cast("decimal(12,6)").cast("double").alias(n) for c, n in zip([*hour, *month], names)]
    return table(spark, sf_dir, "events").select("event_id", *six)


_FULL = " AND ".join(f"{c} IS NOT NULL" for c in GOLD_COLUMNS)


@query(with_sql("complete_gold", f"SELECT {GOLD_SELECT} FROM complete_gold WHERE {_FULL}"))
def drop_any_null(spark, sf_dir):
    from .base import complete_gold

    return plain(complete_gold(spark, sf_dir).na.drop())


@query(
    """
SELECT latitude, longitude, acq_date, acq_time, confidence, frp, time_str, timestamp_incendio, acq_date AS fecha_join,
       CAST(hour(timestamp_incendio) AS INTEGER) AS hora_join FROM (
  SELECT *, acq_date + INTERVAL (acq_time // 100) HOUR + INTERVAL (acq_time % 100) MINUTE AS timestamp_incendio FROM (
    SELECT latitude, longitude, acq_date, acq_time, min(confidence) AS confidence, arg_min(frp, (confidence, frp)) AS frp,
           lpad(CAST(acq_time AS VARCHAR), 4, '0') AS time_str
    FROM (SELECT CAST(-325 + user_id % 20 AS DOUBLE) / 10 AS latitude, CAST(-650 + user_id // 20 AS DOUBLE) / 10 AS longitude,
                 CAST(ts AS DATE) AS acq_date, CAST(hour(ts) * 100 AS INTEGER) AS acq_time,
                 (['l', 'n', 'h'])[event_id % 3 + 1] AS confidence, value AS frp
          FROM events WHERE event_type = 'error') AS e
    GROUP BY latitude, longitude, acq_date, acq_time) AS d) AS t"""
)
def silver_detections(spark, sf_dir):
    """Detections as text coordinates and clock numbers, typed and reduced to one per hour and place."""
    from .base import latitude, longitude

    user = F.col("user_id")
    letters = F.array(F.lit("l"), F.lit("n"), F.lit("h"))
    bronze = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        latitude(user).cast("string").alias("latitude"),
        longitude(user).cast("string").alias("longitude"),
        F.to_date("ts").alias("acq_date"),
        (F.hour("ts") * 100).alias("acq_time"),
        F.get(letters, (F.col("event_id") % 3).cast("int")).alias("confidence"),
        F.col("value").alias("frp"),
    )
    return plain(silver_fires(bronze))
