"""Data-quality checks as tables of (check, subject, observed, expected, status)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V
from ..functions.indices import percent
from ..session import materialize

OK, ALERT, CRITICAL = "OK", "ALERTA", "ERROR CRITICO"


def _line(check: str, subject: Column, observed: Column, expected: Column, failed: str = ALERT) -> list[Column]:
    status = F.when(observed.eqNullSafe(expected), F.lit(OK)).otherwise(F.lit(failed))
    return [
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        observed.cast("long").alias("observed"),
        expected.cast("long").alias("expected"),
        status.alias("status"),
    ]


def volume(df: DataFrame, cells: int, days: int, hours: int = 24) -> DataFrame:
    """Row count against cells x days x hours, with the difference."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    expected = F.lit(cells * days * hours).cast("long")
    return counted.select(
        *_line("volume", F.lit("table"), F.col("n"), expected), (F.col("n") - expected).alias("difference")
    )


def geography(df: DataFrame, expected_points: int, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Distinct coordinate pairs and rows without coordinates, in one pass over (lat, lon) groups."""
    points = df.groupBy(lat, lon).agg(F.count(F.lit(1)).alias("n"))
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    totals = points.agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("no_coords")
    )
    return _places(totals, expected_points)


def _places(totals: DataFrame, expected_points: int) -> DataFrame:
    both = F.explode(
        F.array(
            F.struct(*_line("points", F.lit("table"), F.col("points"), F.lit(expected_points))),
            F.struct(*_line("null_coordinates", F.lit("table"), F.col("no_coords"), F.lit(0), CRITICAL)),
        )
    ).alias("line")
    return totals.select(both).select("line.*")


def incomplete_days(df: DataFrame, cell: str, day: str, expected_days: int) -> DataFrame:
    """Cells whose number of distinct days differs from the expected one."""
    counted = df.groupBy(cell).agg(F.countDistinct(day).alias("days"))
    bad = counted.filter(F.col("days") != expected_days)
    return bad.select(*_line("days_per_cell", F.col(cell), F.col("days"), F.lit(expected_days)))


def incomplete_hours(df: DataFrame, cell: str, day: str, expected_hours: int = 24) -> DataFrame:
    """Cell-days whose number of rows differs from the expected one."""
    counted = df.groupBy(cell, day).agg(F.count(F.lit(1)).alias("hours"))
    bad = counted.filter(F.col("hours") != expected_hours)
    subject = F.concat_ws(" ", F.col(cell).cast("string"), F.col(day).cast("string"))
    return bad.select(*_line("hours_per_day", subject, F.col("hours"), F.lit(expected_hours)))


def missing_hours(df: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected cell-hours with no row, including cells that are wholly absent."""
    return spine.join(df.select(*keys), list(keys), "left_anti")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count, percentage and status per column; one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return _profile(counts, columns)


def _profile(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    long = counts.unpivot(["__rows"], list(columns), "variable", "null_count")
    pct = F.coalesce(percent(F.col("null_count"), F.col("__rows")), F.lit(0.0))
    status = (
        F.when(pct > V.NULLS_MANY_ABOVE_PCT, V.NULLS_MANY).when(pct > 0, V.NULLS_SOME).otherwise(V.NULLS_NONE)
    )
    return long.select(
        "variable", "null_count", F.round(pct.cast("decimal(20,10)"), 4).cast("double").alias("null_pct"), status.alias("status")
    )


def null_verdict(profile: DataFrame) -> DataFrame:
    """One line for the whole table: total nulls and whether it is complete."""
    total = profile.agg(F.coalesce(F.sum("null_count"), F.lit(0)).alias("n"))
    return total.select(*_line("nulls", F.lit("table"), F.col("n"), F.lit(0)))


def rows_with_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns is null."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def audit_counts(df: DataFrame, features: Sequence[str], cell: str, day: str, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows and nulls for each cell, day and place: (cell, day, lat, lon, __n, __null_0, ...), from which ``audit_of`` takes every check.

    Counts of disjoint sets of rows add up, so they can be kept, and only those of changed rows taken again.
    """
    nulls = [F.count_if(F.col(c).isNull()).alias(f"__null_{i}") for i, c in enumerate(features)]
    keys = list(dict.fromkeys([cell, day, lat, lon]))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *nulls)


def audit_of(
    counts: DataFrame,
    features: Sequence[str],
    cell: str,
    day: str,
    cells: int,
    days: int,
    hours: int = 24,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """All checks as one table, from the counts of ``audit_counts`` with the same features in the same order."""
    n = F.coalesce(F.sum("__n"), F.lit(0))
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    places = counts.groupBy(lat, lon).agg(F.sum("__n").alias("__n"))
    totals = places.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(F.when(missing, F.col("__n"))), F.lit(0)).alias("no_coords"))
    cell_days = counts.groupBy(cell, day).agg(F.sum("__n").alias("hours"))
    day_counts = cell_days.groupBy(cell).agg(F.count(day).alias("days"))
    subject = F.concat_ws(" ", F.col(cell).cast("string"), F.col(day).cast("string"))
    sums = counts.agg(n.alias("__rows"), *[F.coalesce(F.sum(f"__null_{i}"), F.lit(0)).alias(c) for i, c in enumerate(features)])
    parts = [
        counts.agg(n.alias("n")).select(*_line("volume", F.lit("table"), F.col("n"), F.lit(cells * days * hours))),
        _places(totals, cells),
        day_counts.filter(F.col("days") != days).select(*_line("days_per_cell", F.col(cell), F.col("days"), F.lit(days))),
        cell_days.filter(F.col("hours") != hours).select(*_line("hours_per_day", subject, F.col("hours"), F.lit(hours))),
        _profile(sums, features).select(
            F.lit("nulls").alias("check"),
            F.col("variable").alias("subject"),
            F.col("null_count").alias("observed"),
            F.lit(0).cast("long").alias("expected"),
            F.col("status"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit(
    df: DataFrame,
    cell: str,
    day: str,
    features: Sequence[str],
    cells: int,
    days: int,
    hours: int = 24,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """All checks as one table. Works on an empty table as well.

    The table is read once: its rows and nulls are counted for each cell, day and place, and every check
    is taken from these counts.
    """
    counts = materialize(audit_counts(df, features, cell, day, lat, lon), "audit")
    return audit_of(counts, features, cell, day, cells, days, hours, lat, lon)


def schema_drift(spark, actual: T.StructType, declared: T.StructType) -> DataFrame:
    """Differences between two schemas, nested fields included: (field, actual, declared, drift)."""
    have, want = dict(_flatten(actual)), dict(_flatten(declared))
    lines = []
    for field in sorted(have.keys() | want.keys()):
        if field not in have:
            lines.append((field, None, want[field], "missing"))
        elif field not in want:
            lines.append((field, have[field], None, "unexpected"))
        elif have[field] != want[field]:
            lines.append((field, have[field], want[field], "type"))
    return spark.createDataFrame(lines, "field string, actual string, declared string, drift string")


def _flatten(schema: T.StructType, prefix: str = ""):
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            yield from _flatten(field.dataType, f"{prefix}{field.name}.")
        else:
            yield prefix + field.name, field.dataType.simpleString()
