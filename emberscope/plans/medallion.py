"""The whole build, from landing files to the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..operators.grid import GridSpec, grid_nodes, nearest_nodes
from ..operators.labels import LEXICAL
from ..operators.quality import audit_counts, audit_of
from ..sources.tables import create_layers, layout_sorted, read_table, replace_table
from ..streaming.ingest import FileSource, ingest_all
from .features import gold_features, training_table
from .gold import complete_weather, gold_full
from .losses import Losses
from .silver import readable, silver_fires, silver_grid, silver_weather


@dataclass(frozen=True)
class Tables:
    """Names of the tables in their layers."""

    landing_grid: str = V.TABLE_NAMES["landing_grid"]
    bronze_fires: str = V.TABLE_NAMES["bronze_fires"]
    bronze_weather: str = V.TABLE_NAMES["bronze_weather"]
    silver_grid: str = V.TABLE_NAMES["silver_grid"]
    silver_fires: str = V.TABLE_NAMES["silver_fires"]
    silver_weather: str = V.TABLE_NAMES["silver_weather"]
    gold_full: str = V.TABLE_NAMES["gold_full"]
    gold_features: str = V.TABLE_NAMES["gold_features"]

    def derived(self) -> list[str]:
        """The tables made from bronze and the grid, in order."""
        return [self.silver_fires, self.silver_weather, self.gold_full, self.gold_features]


def file_sources(fires_path: str, weather_path: str, state_path: str, tables: Tables, weather_multi_line: bool | None = None) -> list[FileSource]:
    """Where detections and weather documents land, and the bronze tables they feed."""
    fires = f"{state_path}/fires/checkpoint", f"{state_path}/fires/schema"
    weather = f"{state_path}/weather/checkpoint", f"{state_path}/weather/schema"
    return [
        FileSource(fires_path, tables.bronze_fires, *fires, "csv", V.FIRE_SCHEMA_FULL),
        FileSource(weather_path, tables.bronze_weather, *weather, "json", V.WEATHER_SCHEMA, multi_line=weather_multi_line),
    ]


def build(
    spark: SparkSession,
    fires_path: str,
    weather_path: str,
    state_path: str,
    grid: GridSpec,
    tables: Tables = Tables(),
    location: str | None = None,
    layers: Sequence[str] = tuple(V.LAYERS),
    layout_partitions: int | None = None,
    weather_multi_line: bool | None = None,
    confidence_mode: str = LEXICAL,
    accepted: tuple[str, ...] | None = None,
    losses: Losses | None = None,
    training: str | None = None,
    audit: str | None = None,
) -> DataFrame:
    """Run every step and return the status of the ingestion.

    If a source fails, nothing behind it is rebuilt and the status says so. ``weather_multi_line`` is false for
    files of one document per line. ``accepted`` keeps detections of these confidence codes only. ``losses`` receives what every
    step leaves behind: unreadable documents, hours outside the grid or without a time, repeated and orphaned detections, and
    rows that lack a value. ``training`` names a table of six-hour blocks with everything a model is trained on, made from the hours
    completed to gap-free series and the nearest nodes of the grid; ``audit`` one of all checks of the weather rows against the grid and its days.

    Safe to run again: files already ingested are skipped and every later table
    is replaced as a whole.
    """
    create_layers(spark, location, layers)
    replace_table(grid_nodes(spark, grid), tables.landing_grid)
    status = ingest_all(spark, file_sources(fires_path, weather_path, state_path, tables, weather_multi_line))
    if not status.filter("NOT ok").isEmpty():
        return status
    read = lambda name: read_table(spark, name)
    replace_table(silver_grid(read(tables.landing_grid)), tables.silver_grid)
    n, watch = F.count(F.lit(1)), losses.watch if losses else lambda df, *_, **__: df
    fires = watch(read(tables.bronze_fires), "silver_fires", read=n)
    fires = watch(silver_fires(fires), "silver_fires", kept=n, without_time=F.count_if(F.col("timestamp_incendio").isNull()))
    replace_table(fires, tables.silver_fires)
    documents = read(tables.bronze_weather)
    documents = watch(documents, "silver_weather", documents=n, unreadable=F.count_if(~readable(documents)))
    weather = silver_weather(documents, read(tables.silver_grid), grid.size)
    outside, timeless = F.count_if(F.col("grid_id").isNull()), F.count_if(F.col("timestamp_clima").isNull())
    weather = watch(weather, "silver_weather", hours=n, outside_grid=outside, without_time=timeless)
    if layout_partitions:
        weather = layout_sorted(weather, ["grid_id", "timestamp_clima"], layout_partitions)
    replace_table(weather, tables.silver_weather)
    replace_table(gold_full(read(tables.silver_weather), read(tables.silver_fires), confidence_mode, accepted, losses, hashed=True), tables.gold_full)
    gold = watch(read(tables.gold_full), "gold_features", read=n)
    replace_table(watch(gold_features(gold), "gold_features", kept=n), tables.gold_features)
    if training:
        links = nearest_nodes(read(tables.landing_grid)).withColumnRenamed("cell_id", "grid_id")
        hourly = gold_full(complete_weather(read(tables.silver_weather)), read(tables.silver_fires), confidence_mode, accepted, hashed=True)
        # eight links and the node itself
        replace_table(training_table(hourly, links, link_rows=9 * grid.size), training)
    if audit:
        hours = read(tables.silver_weather)
        days = hours.agg(F.datediff(F.max("fecha_join"), F.min("fecha_join")) + 1).first()[0] or 0
        replace_table(audit_of(audit_counts(hours, V.CLIMATE_VARIABLES, "grid_id", "fecha_join"), V.CLIMATE_VARIABLES, "grid_id", "fecha_join", grid.size, days), audit)
    return status
