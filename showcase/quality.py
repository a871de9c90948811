"""Audits of volume, coverage, continuity and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope import vocabulary as V
from emberscope.operators import quality as Q
from emberscope.sources.landing import cell_batches, date_chunks, pending, split_payloads, weather_file_name

from .base import VARIABLES, complete_weather, plain, query, spine, table, users, weather, with_sql

FEATURES = [*VARIABLES, "snow_depth", "elevation", "latitude", "longitude"]
CELLS, DAYS = 160, 30


def _status(observed: str, expected: str, failed: str = "ALERTA") -> str:
    return f"CASE WHEN {observed} IS NOT DISTINCT FROM {expected} THEN 'OK' ELSE '{failed}' END AS status"


@query(
    with_sql(
        "complete_weather",
        f"""
SELECT 'volume' AS "check", 'table' AS subject, n AS observed, CAST(115200 AS BIGINT) AS expected, {_status('n', '115200')},
       n - 115200 AS difference FROM (SELECT count(*) AS n FROM complete_weather) AS c""",
    )
)
def completeness_volume(spark, sf_dir):
    return Q.volume(complete_weather(spark, sf_dir), CELLS, DAYS)


_GEO = f"""
SELECT 'points' AS "check", 'table' AS subject, n AS observed, CAST(160 AS BIGINT) AS expected, {_status('n', '160')}
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT latitude, longitude FROM weather) AS p) AS c
UNION ALL
SELECT 'null_coordinates', 'table', n, CAST(0 AS BIGINT), {_status('n', '0', 'ERROR CRITICO')}
FROM (SELECT count(*) AS n FROM weather WHERE latitude IS NULL OR longitude IS NULL) AS c"""


@query(with_sql("weather", _GEO))
def completeness_geo(spark, sf_dir):
    return Q.geography(weather(spark, sf_dir), CELLS)


_DAYS_SQL = """
SELECT 'days_per_cell' AS "check", grid_id AS subject, days AS observed, CAST(30 AS BIGINT) AS expected, 'ALERTA' AS status
FROM (SELECT grid_id, count(DISTINCT fecha_join) AS days FROM weather GROUP BY grid_id) AS d WHERE days <> 30"""


@query(with_sql("weather", _DAYS_SQL))
def completeness_days(spark, sf_dir):
    return Q.incomplete_days(weather(spark, sf_dir), "grid_id", "fecha_join", DAYS)


_HOURS_SQL = """
SELECT 'hours_per_day' AS "check", grid_id || ' ' || CAST(fecha_join AS VARCHAR) AS subject, hours AS observed,
       CAST(24 AS BIGINT) AS expected, 'ALERTA' AS status
FROM (SELECT grid_id, fecha_join, count(*) AS hours FROM weather GROUP BY grid_id, fecha_join) AS h WHERE hours <> 24"""


@query(with_sql("weather", _HOURS_SQL), name="completeness_hours")
def hours_per_day(spark, sf_dir):
    return Q.incomplete_hours(weather(spark, sf_dir), "grid_id", "fecha_join")


@query(
    with_sql(
        "spine weather",
        """SELECT s.user_id, s.timestamp_clima FROM spine AS s
ANTI JOIN measured AS m ON m.user_id = s.user_id AND m.timestamp_clima = s.timestamp_clima""",
    )
)
def missing_hours(spark, sf_dir):
    from .base import measurements

    return Q.missing_hours(measurements(spark, sf_dir), spine(spark, sf_dir), ["user_id", "timestamp_clima"])


def _profile_sql(source: str) -> str:
    lines = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS n FROM {source}" for c in FEATURES
    )
    return f"""
  SELECT variable, null_count, CAST(round(CAST(pct AS DECIMAL(20,10)), 4) AS DOUBLE) AS null_pct,
         CASE WHEN pct > 5 THEN 'CRITICO (>5%)' WHEN pct > 0 THEN 'ATENCION' ELSE 'OPTIMO' END AS status
  FROM (SELECT *, CAST(null_count AS DOUBLE) * 100.0 / CAST(n AS DOUBLE) AS pct FROM ({lines}) AS l) AS p"""


@query(with_sql("weather", "SELECT * FROM profile ORDER BY null_count DESC, variable", profile=_profile_sql("weather")))
def null_profile(spark, sf_dir):
    return Q.null_profile(weather(spark, sf_dir), FEATURES).orderBy(F.desc("null_count"), "variable")


@query(
    with_sql(
        "weather",
        f"""SELECT 'nulls' AS "check", 'table' AS subject, n AS observed, CAST(0 AS BIGINT) AS expected, {_status('n', '0')}
FROM (SELECT CAST(sum(null_count) AS BIGINT) AS n FROM profile) AS p""",
        profile=_profile_sql("weather"),
    )
)
def null_verdict(spark, sf_dir):
    return Q.null_verdict(Q.null_profile(weather(spark, sf_dir), FEATURES))


@query(
    with_sql(
        "weather",
        f"""
SELECT 'volume' AS "check", 'table' AS subject, n AS observed, CAST(115200 AS BIGINT) AS expected, {_status('n', '115200')}
FROM (SELECT count(*) AS n FROM weather) AS c
UNION ALL {_GEO}
UNION ALL {_DAYS_SQL}
UNION ALL {_HOURS_SQL}
UNION ALL SELECT 'nulls', variable, null_count, CAST(0 AS BIGINT), status FROM profile""",
        profile=_profile_sql("weather"),
    )
)
def audit_all(spark, sf_dir):
    return Q.audit(weather(spark, sf_dir), "grid_id", "fecha_join", FEATURES, CELLS, DAYS)


_LOCATED = "SELECT * REPLACE (CAST(latitude AS VARCHAR) || '_' || CAST(longitude AS VARCHAR) AS grid_id) FROM weather"


def _from_located(sql: str) -> str:
    return sql.replace("FROM weather", "FROM located")


@query(
    with_sql(
        "weather",
        f"""
SELECT 'volume' AS "check", 'table' AS subject, n AS observed, CAST(115200 AS BIGINT) AS expected, {_status('n', '115200')}
FROM (SELECT count(*) AS n FROM located) AS c
UNION ALL {_from_located(_GEO)}
UNION ALL {_from_located(_DAYS_SQL)}
UNION ALL {_from_located(_HOURS_SQL)}
UNION ALL SELECT 'nulls', variable, null_count, CAST(0 AS BIGINT), status FROM profile""",
        located=_LOCATED,
        profile=_profile_sql("located"),
    )
)
def incremental_audit(spark, sf_dir):
    """All checks from counts that are kept up with the stored hours over two drops of files, one of them with hours that come again."""
    from emberscope.plans.refresh import refresh, weather_audit
    from emberscope.session import fresh_dir

    from .ingestion import _checked, _layers, _write_detections, _write_documents

    fires_path, state, landed = fresh_dir(spark, "fires"), fresh_dir(spark, "state"), fresh_dir(spark, "documents")
    tables, grid = _layers(spark, sf_dir)
    counts = f"{tables.gold_full}_audit"
    _write_detections(spark, table(spark, sf_dir, "events").filter("event_type = 'error'").limit(0), fires_path)
    documents = spark.read.schema(V.WEATHER_SCHEMA).json(_write_documents(spark, sf_dir, 500))
    early = F.pmod(F.xxhash64("cell_id"), F.lit(3)) > 0
    again = F.pmod(F.xxhash64("cell_id"), F.lit(3)) < 2
    for lot in (early, again):
        documents.filter(lot).write.mode("append").json(landed)
        _checked(refresh(spark, fires_path, landed, state, grid, tables, layers=(), weather_multi_line=False, audit=counts))
    return weather_audit(spark.read.table(counts), CELLS, DAYS)


@query(with_sql("weather", _HOURS_SQL.replace("hours <> 24", "hours <> 1").replace("24 AS", "1 AS")))
def having_not_equal(spark, sf_dir):
    return Q.incomplete_hours(weather(spark, sf_dir), "grid_id", "fecha_join", 1)


@query(
    """
SELECT CAST(c.chunk_start AS DATE) AS chunk_start, 'nasa_' || strftime(c.chunk_start, '%Y%m%d') || '.csv' AS name
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 5 DAY)) AS chunk_start FROM orders) AS c
ANTI JOIN (SELECT DISTINCT o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT') AS l ON l.o_orderdate = c.chunk_start"""
)
def worklist_dates(spark, sf_dir):
    """Five-day chunks over the order period that have no urgent order on their first day."""
    o = table(spark, sf_dir, "orders")
    bounds = o.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    landed = o.filter("o_orderpriority = '1-URGENT'").select(F.date_format("o_orderdate", "'nasa_'yyyyMMdd'.csv'").alias("name"))
    return pending(date_chunks(bounds, "first", "last"), landed.distinct())


@query(
    """
SELECT CAST((n - 1) // 5 AS BIGINT) AS batch, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY n) AS cells
FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS n FROM (
        SELECT DISTINCT user_id FROM events EXCEPT
        SELECT user_id FROM events WHERE event_type = 'signup' AND hour(ts) = 3) AS p) AS r
GROUP BY 1"""
)
def worklist_cells(spark, sf_dir):
    """Cells without a landed file, in batches of five; a signup at three counts as landed."""
    e = table(spark, sf_dir, "events")
    landed = e.filter((F.col("event_type") == "signup") & (F.hour("ts") == 3)).select(weather_file_name(F.col("user_id")).alias("name"))
    work = users(spark, sf_dir).withColumn("name", weather_file_name(F.col("user_id")))
    todo = pending(work, landed.distinct())
    batches = cell_batches(todo, "user_id", F.floor(F.col("user_id") / F.lit(64)), ["user_id"])
    return batches.select("batch", F.array_join(F.col("cells").cast("array<string>"), ",").alias("cells"))


@query("SELECT page_id, NOT contains(html, '<table') AS accepted, length(html) AS n_chars FROM pages")
def payload_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    accepted, rejected = split_payloads(pages, "html", "<table")
    both = accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.select("page_id", "accepted", F.length("html").cast("long").alias("n_chars"))
