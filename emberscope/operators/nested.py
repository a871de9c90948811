"""Parallel arrays to rows and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timekeys import DAY, epoch_seconds


def zip_explode(df: DataFrame, keep: Sequence[Column | str], arrays: Mapping[str, Column], strict: bool = False) -> DataFrame:
    """One row per position of parallel arrays, shorter ones padded with null.

    A null array empties the whole zip and so drops its row. With ``strict``
    that is kept; otherwise a null array counts as absent values, and only a
    row whose arrays are all null or empty yields nothing (see ``unreadable``).
    """
    inputs = [array if strict else F.coalesce(array, F.array()) for array in arrays.values()]
    named = [array.alias(name) for array, name in zip(inputs, arrays)]
    return df.select(*keep, F.inline(F.arrays_zip(*named)))


def has_rows(arrays: Mapping[str, Column], strict: bool = False) -> Column:
    """Whether ``zip_explode`` makes any row of these arrays."""
    total, any_null = F.lit(0), F.lit(False)
    for array in arrays.values():
        total = total + F.coalesce(F.array_size(array), F.lit(0))
        any_null = any_null | array.isNull()
    return (total > 0) & ~any_null if strict else total > 0


def unreadable(df: DataFrame, arrays: Mapping[str, Column], strict: bool = False) -> DataFrame:
    """Rows that ``zip_explode`` turns into nothing."""
    return df.filter(~has_rows(arrays, strict))


def build_documents(
    hourly: DataFrame,
    cell: str,
    ts: str,
    variables: Sequence[str],
    header: Sequence[str] = (),
    period_days: int = 366,
) -> DataFrame:
    """Nested documents of parallel arrays, one per cell and period, ordered by time.

    The period bounds the length of every array, hence the size of one group.
    ``header`` columns are constant per cell. NaN becomes null.
    """
    period = F.floor(epoch_seconds(F.col(ts)) / F.lit(period_days * DAY))
    stamp = F.concat(F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    values = [_nan_to_null(hourly, name) for name in variables]
    entry = F.struct(stamp.alias("date"), *values)
    grouped = (
        hourly.withColumn("__period", period)
        .groupBy(cell, "__period")
        .agg(*[F.min(h).alias(h) for h in header], F.sort_array(F.collect_list(entry)).alias("__rows"))
    )
    series = F.struct(*[F.col(f"__rows.`{name}`").alias(name) for name in ["date", *variables]])
    return grouped.select(cell, *header, series.alias("hourly"))


def _nan_to_null(df: DataFrame, name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value).alias(name)


def to_json_text(documents: DataFrame) -> DataFrame:
    """One JSON text per document; columns that are absent or null are left out."""
    return documents.select(F.to_json(F.struct(*documents.columns)).alias("value"))
