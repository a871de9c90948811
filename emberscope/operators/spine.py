"""Complete time axes and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_axis(start: Column, end: Column, step: str = "1 hour") -> Column:
    """Array of times from ``start`` up to but not including ``end``."""
    interval = F.expr(f"interval {step}")
    return F.sequence(start, end - interval, interval)


def hourly_spine(cells: DataFrame, start: Column, end: Column, ts: str, partitions: int | None = None) -> DataFrame:
    """One row per cell and hour in [start, end).

    Cells are few rows that become very many. They are expanded to days, spread
    over ``partitions`` tasks (the shuffle partitions of the session by
    default) and only then expanded to hours, so that neither one row nor one
    task produces the whole period. ``start`` and ``end`` may be scalar
    subqueries.
    """
    n = partitions or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = F.explode(F.sequence(F.to_date(start), F.to_date(end - F.expr("interval 1 second")), F.expr("interval 1 day")))
    days = cells.withColumn("__day", day).repartition(n, *cells.columns, "__day")
    hour = F.col("__day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("__hour"))
    return (
        days.withColumn("__hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .withColumn(ts, hour)
        .filter((F.col(ts) >= start.cast("timestamp_ntz")) & (F.col(ts) < end.cast("timestamp_ntz")))
        .drop("__day", "__hour")
    )


def complete(observed: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All spine rows, with nulls where nothing was observed."""
    return spine.join(observed, list(keys), "left")
