"""Domain indices, codes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def spread_index(wind: Column, temperature: Column, humidity: Column) -> Column:
    """Wind times temperature, damped by humidity, as DOUBLE."""
    w, t, h = (c.cast("double") for c in (wind, temperature, humidity))
    return F.try_divide(w * t, h + F.lit(1))


def confidence_code(confidence: Column) -> Column:
    """Letter code to 1..3, anything else (null too) to 0."""
    code = F.lit(0)
    for letter, number in V.CONFIDENCE_CODES.items():
        code = F.when(confidence == letter, F.lit(number)).otherwise(code)
    return code


def confidence_label(code: Column) -> Column:
    label = F.lit(V.CONFIDENCE_OTHER)
    for number, text in V.CONFIDENCE_LABELS.items():
        label = F.when(code == number, F.lit(text)).otherwise(label)
    return label


def climate_segment(temperature: Column, wind: Column, humidity: Column) -> Column:
    """First matching climate condition; a null measurement matches none."""
    hot = temperature > V.HOT_ABOVE
    windy = wind > V.WINDY_ABOVE
    return (
        F.when(hot & windy, F.lit(V.SEGMENT_HOT_WINDY))
        .when(hot, F.lit(V.SEGMENT_HOT))
        .when(windy, F.lit(V.SEGMENT_WINDY))
        .when(humidity < V.DRY_BELOW, F.lit(V.SEGMENT_DRY))
        .otherwise(F.lit(V.SEGMENT_OTHER))
    )


def direction_of(mean_sin: Column, mean_cos: Column) -> Column:
    """Direction in degrees, in [0, 360), of a mean unit vector.

    Null where the directions cancel out and any answer would be rounding noise.
    """
    direction = F.pmod(F.degrees(F.atan2(mean_sin, mean_cos)) + F.lit(360.0), F.lit(360.0))
    return F.when(F.hypot(mean_sin, mean_cos) > F.lit(1e-9), direction)


def mean_direction(degrees: Column) -> Column:
    """Aggregate: circular mean of directions in degrees, in [0, 360)."""
    angle = F.radians(degrees)
    return direction_of(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent as DOUBLE; null for an empty whole."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
