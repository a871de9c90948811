"""Column expressions on dates and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def hour_floor(ts: Column) -> Column:
    """Start of the hour, as TIMESTAMP_NTZ."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def pad_time(hhmm: Column) -> Column:
    """Four-digit clock text: 5 becomes 0005; longer input is cut to four characters."""
    return F.lpad(hhmm.cast("string"), 4, "0")


def acquisition_time(day: Column, clock: Column) -> Column:
    """Timestamp of a date and a four-digit clock text; null when either is invalid."""
    text = F.concat(
        day.cast("string"), F.lit(" "), F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2), F.lit(":00")
    )
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def iso_time(text: Column) -> Column:
    """Timestamp of ISO text with a blank or ``T`` separator and an optional offset."""
    return F.try_to_timestamp(F.regexp_replace(text, "T", " "))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value on a cycle of the given length."""
    angle = value * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)
