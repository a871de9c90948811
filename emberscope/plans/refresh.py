"""The build in increments: only the partitions that new files touch are written again.

Silver and gold tables are partitioned by year and by a part of the cells. New files are merged into the stored silver rows of the
partitions they touch; the labels of these partitions are joined again; and the rolling features of a partition are taken again where
their frames can see a changed row, which is counted, not assumed. The result equals the full build, whatever the order of delivery.

A run that is cut short is repeated by the next one: what has been merged already merges to the same rows. Without a readable note of the
last run, or with other settings than then, every table is built in full.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from ..functions.spatial import grid_key
from ..operators.grid import GridSpec, grid_nodes
from ..operators.labels import LEXICAL
from ..operators.quality import audit_counts, audit_of
from ..sources.tables import adopt, create_layers, read_table, replace_table
from ..streaming.ingest import FileSource, batch_number, ingest_all
from .features import gold_features
from .gold import gold_full
from .medallion import Tables, file_sources
from .silver import located_hours, newest_hours, silver_grid, typed_fires, unique_fires, weather_rows

YEAR, PART = "year", "part"
PARTS = 16
#: Rows that a rolling feature sees before its own.
FRAME_ROWS = max(V.ROWS_7_DAYS, V.ROWS_3_DAYS)

#: Columns of the weather whose nulls are counted.
AUDITED = [*V.CLIMATE_VARIABLES, "elevation", "latitude", "longitude"]

Partition = tuple[int | None, int]


def cell_part(latitude: Column, longitude: Column, parts: int) -> Column:
    """The part of the cells that a place belongs to; places that snap to one node share it."""
    return F.pmod(F.xxhash64(grid_key(latitude), grid_key(longitude)), F.lit(parts)).cast("int")


def _placed(df: DataFrame, date: str, parts: int) -> DataFrame:
    return df.withColumns({YEAR: F.year(date), PART: cell_part(F.col("latitude"), F.col("longitude"), parts)})


def within(touched: Sequence[Partition]) -> Column:
    """Rows of these partitions, as a condition on the partition columns alone, so that no other file is read."""
    by_year: dict[int | None, list[int]] = {}
    for year, part in touched:
        by_year.setdefault(year, []).append(part)
    found = F.lit(False)
    for year, own in sorted(by_year.items(), key=lambda x: (x[0] is not None, x[0])):
        found = found | ((F.col(YEAR).isNull() if year is None else F.col(YEAR) == year) & F.col(PART).isin(*sorted(own)))
    return found


def partitions(df: DataFrame) -> list[Partition]:
    """The partitions that rows belong to: as many as years times parts."""
    return sorted(((r[0], r[1]) for r in df.select(YEAR, PART).distinct().collect()), key=lambda p: (p[0] is not None, p))


def overwrite(df: DataFrame, table: str, touched: Sequence[Partition]) -> None:
    """Put rows in the place of whole partitions; the query may read the table. Touched partitions that get no row are emptied."""
    if not touched:
        return
    spark = df.sparkSession
    got = Observation()
    told = df.select(*spark.read.table(table).columns).hint("rebalance", YEAR, PART)
    told = told.observe(got, F.collect_set(F.struct(F.coalesce(YEAR, F.lit(-1)).alias(YEAR), F.col(PART).alias(PART))).alias("written"))
    # a setting of the session: writing into a table by name takes no options
    setting, mode = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    try:
        spark.conf.set(setting, "dynamic")
        told.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, mode)
    written = {(None if w[YEAR] == -1 else w[YEAR], w[PART]) for w in got.get["written"]}
    for year, part in touched:
        if (year, part) not in written:
            # the null year is a partition under a name of its own, which rows only ever join
            if year is not None:
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({YEAR} = {year}, {PART} = {part})")
    spark.catalog.refreshTable(table)


def _noted(spark: SparkSession, path: str) -> dict:
    try:
        row = spark.read.text(path).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return json.loads(row.value) if row else {}


def _note(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def new_rows(spark: SparkSession, table: str, source: FileSource, last: int) -> tuple[DataFrame, int]:
    """Bronze rows of batches behind the last one seen, and the newest batch; other files are not read."""
    number = batch_number(F.col("_metadata.file_name"), source.checkpoint)
    rows = spark.read.table(table)
    newest = rows.select(F.max(number).alias("n")).first().n
    return rows.filter(number > last), last if newest is None else max(newest, last)


def reached(gold: DataFrame, touched: Sequence[Partition], rows: int = FRAME_ROWS, back: bool = False) -> list[Partition]:
    """Partitions whose frames of so many preceding rows can see a row of the touched ones; with ``back`` those that theirs can see.

    Counted by cell: a later year is out of reach when every cell has that many rows in the years between.
    """
    dated = [(y, p) for y, p in touched if y is not None]
    if not dated:
        return []
    spark = gold.sparkSession
    counts = gold.filter(F.col(PART).isin(*sorted({p for _, p in dated})) & F.col(YEAR).isNotNull() & F.col("grid_id").isNotNull())
    counts = counts.groupBy(PART, "grid_id", YEAR).agg(F.count(F.lit(1)).alias("n"))
    origin = spark.createDataFrame(dated, f"origin int, {PART} int")
    onward = F.col(YEAR) < F.col("origin") if back else F.col(YEAR) > F.col("origin")
    order = F.desc(YEAR) if back else F.asc(YEAR)
    before = Window.partitionBy(PART, "origin", "grid_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each cell and year, for each touched year of its part
    seen = counts.join(F.broadcast(origin), PART).filter(onward).withColumn("between", F.coalesce(F.sum("n").over(before), F.lit(0)))
    more = partitions(seen.filter(F.col("between") < rows))
    return sorted({*dated, *more})


def _empty(spark: SparkSession, like: DataFrame, table: str) -> None:
    if not spark.catalog.tableExists(table) and not adopt(spark, table):
        spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in like.schema])).write.format("parquet").partitionBy(YEAR, PART).saveAsTable(table)


def refresh(
    spark: SparkSession,
    fires_path: str,
    weather_path: str,
    state_path: str,
    grid: GridSpec,
    tables: Tables = Tables(),
    location: str | None = None,
    layers: Sequence[str] = tuple(V.LAYERS),
    parts: int = PARTS,
    weather_multi_line: bool | None = None,
    confidence_mode: str = LEXICAL,
    accepted: tuple[str, ...] | None = None,
    audit: str | None = None,
) -> DataFrame:
    """Ingest what is new and bring every table up to date; returns the status of the ingestion.

    Takes what ``build`` takes; the tables carry the columns year and part behind theirs. If a source fails, nothing behind it changes.
    ``audit`` names a table of counts of the weather rows that is kept up with them, for ``weather_audit``.
    """
    create_layers(spark, location, layers)
    sources = file_sources(fires_path, weather_path, state_path, tables, weather_multi_line)
    status = ingest_all(spark, sources)
    if not status.filter("NOT ok").isEmpty():
        return status
    noted, place = _noted(spark, f"{state_path}/refreshed"), f"{state_path}/refreshed"
    settings = {"grid": [grid.south, grid.north, grid.west, grid.east, grid.step], "parts": parts, "confidence": confidence_mode, "accepted": list(accepted or ())}
    kept = [*tables.derived(), *([audit] if audit else [])]
    known = noted.get("settings") == settings and all(spark.catalog.tableExists(t) or adopt(spark, t) for t in kept)
    if not known:
        noted = {}
        replace_table(grid_nodes(spark, grid), tables.landing_grid)
        replace_table(silver_grid(read_table(spark, tables.landing_grid)), tables.silver_grid)
        for t in kept:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    fires, last_fires = new_rows(spark, tables.bronze_fires, sources[0], noted.get("fires", -1))
    weather, last_weather = new_rows(spark, tables.bronze_weather, sources[1], noted.get("weather", -1))
    nodes = read_table(spark, tables.silver_grid)

    # silver: what is stored in the touched partitions and what is new, made unique together
    fresh = located_hours(newest_hours(weather_rows(weather)), nodes, grid.size)
    fresh = _placed(fresh, "fecha_join", parts)
    _empty(spark, fresh, tables.silver_weather)
    touched_weather = partitions(fresh)
    held = spark.read.table(tables.silver_weather).filter(within(touched_weather))
    held = held.join(weather.select("source_filename").distinct(), "source_filename", "left_anti").select(*fresh.columns)
    overwrite(newest_hours(held.unionByName(fresh)), tables.silver_weather, touched_weather)

    if audit:
        stored = spark.read.table(tables.silver_weather)
        counts = audit_counts(stored.filter(within(touched_weather)), AUDITED, "grid_id", "fecha_join")
        counts = _placed(counts, "fecha_join", parts)
        _empty(spark, counts, audit)
        overwrite(counts, audit, touched_weather)

    typed = typed_fires(fires)
    _empty(spark, _placed(unique_fires(typed), "fecha_join", parts), tables.silver_fires)
    touched_fires = partitions(_placed(typed.withColumn("fecha_join", F.col("acq_date").try_cast("date")), "fecha_join", parts))
    held = spark.read.table(tables.silver_fires).filter(within(touched_fires)).select(*typed.columns)
    overwrite(_placed(unique_fires(held.unionByName(typed)), "fecha_join", parts), tables.silver_fires, touched_fires)

    # gold: labels of the touched partitions
    touched = sorted({*touched_weather, *touched_fires}, key=lambda p: (p[0] is not None, p))
    label = gold_full(
        spark.read.table(tables.silver_weather).filter(within(touched)),
        spark.read.table(tables.silver_fires).filter(within(touched)),
        confidence_mode,
        accepted,
    )
    label = _placed(label, "timestamp_clima", parts)
    _empty(spark, label, tables.gold_full)
    overwrite(label, tables.gold_full, touched)

    gold = spark.read.table(tables.gold_full)
    stale = reached(gold, touched)
    seen = reached(gold, stale, back=True)
    features = gold_features(gold.filter(within(seen)).drop(YEAR, PART))
    features = _placed(features, "timestamp_clima", parts)
    _empty(spark, features, tables.gold_features)
    overwrite(features.filter(within(stale)), tables.gold_features, stale)
    _note(spark, place, {"settings": settings, "fires": last_fires, "weather": last_weather})
    return status


def weather_audit(counts: DataFrame, cells: int, days: int, hours: int = 24) -> DataFrame:
    """All checks of the weather rows from the table of counts that ``refresh`` keeps."""
    return audit_of(counts, AUDITED, "grid_id", "fecha_join", cells, days, hours)
