"""Exploratory reports over the labelled table.

Windows without a partition run over aggregated rows whose number is fixed by
the report (levels, months, years). Where the groups are cells, whose number
grows, the total comes from a scalar subquery instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import climate_segment, confidence_label, percent
from .blocks import exact_mean


def rounded(value: Column, digits: int) -> Column:
    """Round through DECIMAL, half away from zero, back to DOUBLE."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def summary(gold: DataFrame, ts: str = "timestamp_clima", cell: str = "grid_id") -> DataFrame:
    """Rows, events, cells, first and last time, and prevalence in percent."""
    return gold.agg(
        F.count(F.lit(1)).alias("total_registros_hora_celda"),
        F.sum("target").alias("total_eventos_incendio"),
        F.countDistinct(cell).alias("total_puntos_monitoreados"),
        F.min(ts).alias("fecha_inicio"),
        F.max(ts).alias("fecha_fin"),
        rounded(percent(F.sum("target"), F.count(F.lit(1))), 4).alias("tasa_prevalencia_fuego"),
    )


def confidence_share(gold: DataFrame) -> DataFrame:
    """Events per confidence level, mean intensity and share of all events."""
    grouped = gold.filter(F.col("target") == 1).groupBy("fire_confidence").agg(
        F.count(F.lit(1)).alias("cantidad_incendios"), rounded(exact_mean("fire_intensity"), 2).alias("intensidad_promedio_frp")
    )
    share = rounded(percent(F.col("cantidad_incendios"), F.sum("cantidad_incendios").over(Window.partitionBy())), 2)
    return grouped.select(
        confidence_label(F.col("fire_confidence")).alias("nivel_confianza"),
        "cantidad_incendios",
        "intensidad_promedio_frp",
        share.alias("porcentaje_del_total"),
    ).orderBy(F.desc("cantidad_incendios"), "nivel_confianza")


def month_ranking(gold: DataFrame, ts: str = "timestamp_clima") -> DataFrame:
    """Events and mean temperature per calendar month, ranked by events."""
    months = gold.groupBy(F.month(ts).alias("mes")).agg(
        F.sum("target").alias("total_incendios"), rounded(exact_mean("temperature_2m"), 1).alias("temp_promedio_mes")
    )
    rank = F.rank().over(Window.orderBy(F.desc("total_incendios")))
    return months.withColumn("ranking_peligrosidad", rank).orderBy("mes")


def segment_share(gold: DataFrame) -> DataFrame:
    """Events per climate condition and their share of all events."""
    events = gold.filter(F.col("target") == 1)
    segment = climate_segment(F.col("temperature_2m"), F.col("wind_speed_10m"), F.col("relative_humidity_2m"))
    total = events.agg(F.count(F.lit(1))).scalar()
    return (
        events.groupBy(segment.alias("segmento_climatico"))
        .agg(F.count(F.lit(1)).alias("cantidad_incendios"))
        .withColumn("porcentaje_incendios", rounded(percent(F.col("cantidad_incendios"), total), 2))
        .orderBy(F.desc("cantidad_incendios"), "segmento_climatico")
    )


def strongest(df: DataFrame, value: str, tie_break: Sequence[str], k: int = 10, rank: str = "ranking_intensidad") -> DataFrame:
    """The ``k`` rows with the greatest value and their rank among all rows.

    The rank of a row counts the rows above it, all of which are in the top as
    well, so ranking the k kept rows equals ranking the whole table.
    """
    top = df.orderBy(F.desc_nulls_last(value), *tie_break).limit(k)
    return top.withColumn(rank, F.rank().over(Window.orderBy(F.desc_nulls_last(value))))


def hotspots(gold: DataFrame, k: int = 15, cell: str = "grid_id") -> DataFrame:
    """Cells with the most events: strongest event, mean temperature, share of all events."""
    total = gold.agg(F.sum("target")).scalar()
    cells = gold.groupBy(cell, "latitude", "longitude").agg(
        F.sum("target").alias("total_incendios"),
        F.max("fire_intensity").alias("intensidad_maxima_registrada"),
        rounded(exact_mean("temperature_2m"), 1).alias("temp_promedio_zona"),
    )
    top = cells.orderBy(F.desc("total_incendios"), cell, "latitude", "longitude").limit(k)
    return top.withColumn("porcentaje_del_total_global", rounded(percent(F.col("total_incendios"), total), 2))


def yearly_change(gold: DataFrame, ts: str = "timestamp_clima") -> DataFrame:
    """Events per year against the year before, and mean intensity."""
    years = gold.groupBy(F.year(ts).alias("anio")).agg(
        F.sum("target").alias("incendios_este_anio"), rounded(exact_mean("fire_intensity"), 2).alias("intensidad_avg")
    )
    before = F.lag("incendios_este_anio").over(Window.orderBy("anio"))
    return (
        years.withColumn("incendios_anio_anterior", before)
        .withColumn("diferencia_neta", F.col("incendios_este_anio") - F.col("incendios_anio_anterior"))
        .orderBy("anio")
    )


def lookup(df: DataFrame, ts: str, when: str, lat: str, at_lat: float, lon: str, at_lon: float) -> DataFrame:
    """Rows of one time and place."""
    return df.filter(
        (F.col(ts) == F.lit(when).cast(df.schema[ts].dataType)) & (F.col(lat) == F.lit(at_lat)) & (F.col(lon) == F.lit(at_lon))
    )


def preview(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
