"""Roll-up of hourly rows into fixed blocks of the day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.indices import direction_of, mean_direction
from ..functions.timekeys import HOUR, epoch_seconds
from .frames import lagged, over_time


def block_start(ts: Column, hours: int = 6) -> Column:
    """Start of the block of ``hours`` hours a time falls in, as TIMESTAMP_NTZ."""
    width = F.lit(hours * HOUR)
    return F.timestamp_seconds(F.floor(epoch_seconds(ts) / width) * width).cast("timestamp_ntz")


def exact_mean(column: str) -> Column:
    """Aggregate: mean as DOUBLE of a sum taken in the column's own type."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def roll_up(
    hourly: DataFrame,
    keys: Sequence[str],
    ts: str,
    means: Sequence[str] = (),
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    directions: Sequence[str] = (),
    modes: Sequence[str] = (),
    hours: int = 6,
    block: str = "block_start",
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per key and block; ties of the most frequent value go to the smallest.

    A single mode is counted value by value first, so that everything stays a hash aggregation of plain numbers, and
    the hours are shuffled once, by key and block: hours of one block seldom lie in one task, where they could combine before.
    ``derived`` are columns made of an hour's others behind that shuffle.
    """
    by = [*keys, block]
    started = hourly.withColumn(block, block_start(F.col(ts), hours))
    if len(modes) == 1:
        started = started.repartition(*by)
    started = started.withColumns(dict(derived or {}))
    if len(modes) != 1:
        return started.groupBy(*by).agg(
            F.count(F.lit(1)).alias("hours_in_block"),
            *[exact_mean(c).alias(c) for c in means],
            *[F.sum(c).alias(c) for c in sums],
            *[F.max(c).alias(c) for c in maxima],
            *[mean_direction(F.col(c)).alias(c) for c in directions],
            *[F.mode(c, True).alias(c) for c in modes],
        )
    (mode,) = modes
    angle = {c: F.radians(F.col(c)) for c in directions}
    counted = started.groupBy(*by, F.col(mode).alias("__value")).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(c).alias(f"__sum_{c}") for c in dict.fromkeys([*means, *sums])],
        *[F.max(c).alias(f"__max_{c}") for c in maxima],
        *[F.count(c).alias(f"__n_{c}") for c in dict.fromkeys([*means, *directions])],
        *[F.sum(F.sin(a)).alias(f"__sin_{c}") for c, a in angle.items()],
        *[F.sum(F.cos(a)).alias(f"__cos_{c}") for c, a in angle.items()],
    )
    part = lambda fn, c: F.try_divide(F.sum(f"__{fn}_{c}").cast("double"), F.sum(f"__n_{c}").cast("double"))
    kept = lambda c: F.sum(f"__sum_{c}").cast(_sum_type(started, c))
    often = F.when(F.col("__value").isNotNull(), F.struct((-F.col("__rows")).alias("n"), F.col("__value").alias("v")))
    return counted.groupBy(*by).agg(
        F.sum("__rows").alias("hours_in_block"),
        *[part("sum", c).alias(c) for c in means],
        *[kept(c).alias(c) for c in sums],
        *[F.max(f"__max_{c}").alias(c) for c in maxima],
        *[direction_of(part("sin", c), part("cos", c)).alias(c) for c in directions],
        F.min(often).getField("v").alias(mode),
    )


def _sum_type(df: DataFrame, column: str) -> T.DataType:
    """The type that ``sum`` gives; a sum of sums of decimals would have ten digits more."""
    return df.select(F.sum(column)).schema[0].dataType


def block_deltas(
    blocks: DataFrame, keys: Sequence[str], block: str, columns: Mapping[str, str], hours: int = 6
) -> DataFrame:
    """Change against the block just before; null where that block is missing."""
    frames = [lagged(f"__was_{name}", column, hours * HOUR) for name, column in columns.items()]
    framed = over_time(blocks, keys, block, frames)
    changes = {name: F.col(column) - F.col(f"__was_{name}") for name, column in columns.items()}
    return framed.withColumns(changes).drop(*[f.name for f in frames])
