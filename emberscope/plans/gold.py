"""The labelled table: every cell and hour, with the fire seen there and then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.spatial import grid_key, snap
from ..operators.labels import LEXICAL, keep_confidence, label_join, orphans, snap_detections
from ..operators.spine import complete, hourly_spine
from .losses import Losses

JOIN_KEYS = ["fecha_join", "hora_join", "__row", "__col"]
GOLD_CLIMATE = [v for v in V.CLIMATE_VARIABLES if v != "snow_depth"]


def keyed_by_place(df: DataFrame) -> DataFrame:
    """Rows with the grid lines that the label join compares."""
    return df.withColumns({"__row": grid_key(F.col("latitude")), "__col": grid_key(F.col("longitude"))})


def snapped_fires(fires: DataFrame, confidence_mode: str = LEXICAL, accepted: tuple[str, ...] | None = None) -> DataFrame:
    kept = keep_confidence(fires, accepted) if accepted else fires
    return snap_detections(keyed_by_place(kept), JOIN_KEYS, confidence_mode=confidence_mode)


def gold_full(
    weather: DataFrame,
    fires: DataFrame,
    confidence_mode: str = LEXICAL,
    accepted: tuple[str, ...] | None = None,
    losses: Losses | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Weather rows with target, intensity and confidence; as many rows as ``weather``.

    ``hashed`` keeps a task's detections in a hash table, so that the hours are not sorted: for hours that are many beside the detections.
    Nor do the detections then go through the driver, as they do where the planner, by the size of their compressed files, takes them for few.

    ``losses`` counts the snapped detections and the rows they label; on hourly rows the difference are the orphans.
    """
    snapped = snapped_fires(fires, confidence_mode, accepted)
    if losses:
        snapped = losses.watch(snapped, "gold_full", detections=F.count(F.lit(1)))
    if hashed:
        snapped = snapped.hint("shuffle_hash")
    keyed = weather if {"__row", "__col"} <= set(weather.columns) else keyed_by_place(weather)
    labelled = label_join(keyed, snapped, JOIN_KEYS)
    if losses:
        labelled = losses.watch(labelled, "gold_full", rows=F.count(F.lit(1)), labelled=F.count_if(F.col("target") == 1))
    return labelled.select(
        "grid_id",
        "timestamp_clima",
        snap(F.col("latitude")).alias("latitude"),
        snap(F.col("longitude")).alias("longitude"),
        "elevation",
        *GOLD_CLIMATE,
        "target",
        "fire_intensity",
        "fire_confidence",
    )


def complete_weather(weather: DataFrame, ts: str = "timestamp_clima") -> DataFrame:
    """Every hour between the first and the last one for every cell that has any, with nulls where nothing was measured.

    Hours outside the grid or without a time have no place in a series and are left out.
    """
    located = weather.filter(F.col("grid_id").isNotNull() & F.col(ts).isNotNull())
    cells = located.groupBy("grid_id").agg(*[F.min(c).alias(c) for c in ("latitude", "longitude", "elevation")])
    start, end = located.agg(F.min(ts)).scalar(), located.agg(F.max(ts) + F.expr("INTERVAL 1 HOUR")).scalar()
    kind = weather.schema[ts].dataType
    spine = hourly_spine(cells, start, end, ts).withColumn(ts, F.col(ts).cast(kind))
    # stated, as the planner goes by the size of compressed files, a part of what a broadcast takes of the driver
    hours = complete(located.select("grid_id", ts, *V.CLIMATE_VARIABLES).hint("merge"), spine, ["grid_id", ts])
    return hours.withColumns({"fecha_join": F.col(ts).cast("date"), "hora_join": F.hour(ts)})


def store_keyed(weather: DataFrame, name: str, buckets: int) -> None:
    """Store hourly rows with their join keys, hashed into buckets and sorted by them, one file for each bucket.

    ``gold_full`` then joins the stored table as it lies: the hours, by far the larger side, are neither shuffled nor sorted
    again, however often detections are corrected. ``buckets`` fixes how many tasks join; take a multiple of the cores and about 200 MB each.
    """
    keyed = keyed_by_place(weather).repartition(buckets, *JOIN_KEYS)
    keyed.write.format("parquet").mode("overwrite").bucketBy(buckets, *JOIN_KEYS).sortBy(*JOIN_KEYS).saveAsTable(name)


def fires_without_weather(weather: DataFrame, fires: DataFrame) -> DataFrame:
    """Snapped detections outside the grid or the period, which the label join cannot show."""
    lost = orphans(snapped_fires(fires), keyed_by_place(weather), JOIN_KEYS)
    return lost.select(
        "fecha_join",
        "hora_join",
        (F.col("__row") / F.lit(10.0)).alias("latitude"),
        (F.col("__col") / F.lit(10.0)).alias("longitude"),
        "fire_intensity",
        "fire_confidence",
    )
