"""Cleaning and typing: detections, weather series and the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.spatial import snap
from ..functions.timekeys import acquisition_time, iso_time, pad_time
from ..operators.dedup import keep_first
from ..operators.grid import assign_node
from ..operators.nested import has_rows, zip_explode


def silver_grid(landing: DataFrame) -> DataFrame:
    """Typed grid nodes with coordinates."""
    return landing.dropna(subset=["latitude", "longitude"]).select(
        F.col("cell_id").cast("string").alias("grid_id"),
        F.col("latitude").cast("double").alias("latitude_centroid"),
        F.col("longitude").cast("double").alias("longitude_centroid"),
        F.current_timestamp().alias("fecha_procesamiento"),
    )


def typed_fires(bronze: DataFrame) -> DataFrame:
    """Detections with numeric coordinates."""
    return bronze.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})


def unique_fires(typed: DataFrame) -> DataFrame:
    """One detection per date, time and place, with time keys. Of several sets made unique together the same ones remain."""
    unique = keep_first(typed, V.FIRE_KEY)
    timed = unique.withColumn("time_str", pad_time(F.col("acq_time"))).withColumn(
        "timestamp_incendio", acquisition_time(F.col("acq_date"), F.col("time_str"))
    )
    return timed.withColumns(
        {"fecha_join": F.col("acq_date").try_cast("date"), "hora_join": F.hour("timestamp_incendio")}
    )


def silver_fires(bronze: DataFrame) -> DataFrame:
    """Typed detections with time keys, one per date, time and place."""
    return unique_fires(typed_fires(bronze))


def hourly_arrays(bronze: DataFrame) -> dict[str, Column]:
    """The time axis under either of its names, and the value series."""
    present = set(bronze.schema["hourly"].dataType.fieldNames())
    axes = [F.col(f"hourly.{name}") for name in ("time", "date") if name in present]
    if not axes:
        raise ValueError("documents carry no time axis")
    arrays = {"timestamp_clima_str": F.coalesce(*axes) if len(axes) > 1 else axes[0]}
    for name in V.CLIMATE_VARIABLES:
        arrays[name] = F.col(f"hourly.{name}") if name in present else F.lit(None).cast("array<double>")
    return arrays


def readable(bronze: DataFrame) -> Column:
    """Whether a document yields any row."""
    return has_rows(hourly_arrays(bronze))


def weather_rows(bronze: DataFrame, strict: bool = False) -> DataFrame:
    """One typed row per document and hour."""
    header = [
        F.col("source_filename"),
        snap(F.col("request_latitude"), 1).alias("latitude"),
        snap(F.col("request_longitude"), 1).alias("longitude"),
        F.round(F.col("elevation_val").cast("double"), 2).alias("elevation"),
    ]
    rows = zip_explode(bronze, header, hourly_arrays(bronze), strict)
    timed = rows.withColumn("timestamp_clima", iso_time(F.col("timestamp_clima_str")))
    return timed.withColumns(
        {"fecha_join": F.col("timestamp_clima").cast("date"), "hora_join": F.hour("timestamp_clima")}
    ).drop("timestamp_clima_str")


def newest_hours(rows: DataFrame) -> DataFrame:
    """One row per place and hour: as in the file whose name sorts last, and of that file's rows the greatest.

    Rows without a readable time are not hours and all stay: each has a number of its own in the key.
    """
    key = ["latitude", "longitude", "timestamp_clima"]
    others = [F.col(c) for c in rows.columns if c not in key]
    alone = F.when(F.col("timestamp_clima").isNull(), F.monotonically_increasing_id())
    newest = rows.groupBy(*key, alone.alias("__alone")).agg(F.max(F.struct(F.col("source_filename").alias("__file"), F.struct(*others).alias("__row"))).alias("__last"))
    return newest.select(*[F.col(c) if c in key else F.col(f"__last.__row.{c}").alias(c) for c in rows.columns])


def located_hours(rows: DataFrame, grid: DataFrame, grid_rows: int | None = None) -> DataFrame:
    """Hourly rows with their grid node in the final column order."""
    located = assign_node(rows, grid.select("grid_id", "latitude_centroid", "longitude_centroid"), grid_rows=grid_rows)
    return located.select(*V.SILVER_WEATHER_KEYS, *V.CLIMATE_VARIABLES, *V.SILVER_WEATHER_TAIL)


def silver_weather(bronze: DataFrame, grid: DataFrame, grid_rows: int | None = None, strict: bool = False) -> DataFrame:
    """Hourly rows with their grid node: one plan, one read of the documents, one write.

    An hour of a place that was delivered again counts once, as in the file whose name sorts last.
    """
    return located_hours(newest_hours(weather_rows(bronze, strict)), grid, grid_rows)
