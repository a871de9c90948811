"""Snapping detections to cells and hours, and labelling measurements with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.indices import confidence_code

ORDINAL, LEXICAL = "ordinal", "lexical"


def keep_confidence(detections: DataFrame, accepted: Sequence[str] = ("n", "h"), column: str = "confidence") -> DataFrame:
    """Only detections with an accepted confidence letter."""
    return detections.filter(F.col(column).isin(*accepted))


def snap_detections(
    detections: DataFrame,
    keys: Sequence[str],
    confidence: str = "confidence",
    intensity: str = "frp",
    confidence_mode: str = LEXICAL,
) -> DataFrame:
    """One row per cell and hour: strongest confidence and intensity, target 1.

    ``lexical`` takes the alphabetical maximum of the letters (n before l before
    h), ``ordinal`` the highest level. Aggregates combine before the shuffle, so
    a cell and hour with very many detections is no hot spot.
    """
    if confidence_mode == LEXICAL:
        code = _code_of_slot(F.max(_slot(F.col(confidence))))
    elif confidence_mode == ORDINAL:
        code = F.max(confidence_code(F.col(confidence)))
    else:
        raise ValueError(f"confidence_mode is {LEXICAL!r} or {ORDINAL!r}")
    return detections.groupBy(*keys).agg(
        code.alias("fire_confidence"), F.max(intensity).alias("fire_intensity"), F.lit(1).alias("target")
    )


def _slot(text: Column) -> Column:
    """Place of a text among the code letters in alphabetical order.

    The letters take the odd places, everything between them the even ones, so
    the greatest text has the greatest place, and places, unlike texts, can be
    compared in a hash aggregation.
    """
    slot = F.lit(0)
    for letter in sorted(V.CONFIDENCE_CODES):
        slot = slot + (text >= letter).cast("int") + (text > letter).cast("int")
    return slot


def _code_of_slot(slot: Column) -> Column:
    code = F.lit(0)
    for i, letter in enumerate(sorted(V.CONFIDENCE_CODES)):
        code = F.when(slot == 2 * i + 1, F.lit(V.CONFIDENCE_CODES[letter])).otherwise(code)
    return code


def label_join(measurements: DataFrame, snapped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every measurement row, with the detection of the same key or zeros.

    No broadcast is forced: the detections are aggregated at run time, and
    adaptive execution broadcasts them when they prove small and splits hot
    measurement keys when they do not.
    """
    defaults: Mapping[str, object] = {"target": 0, "fire_intensity": 0, "fire_confidence": 0}
    joined = measurements.join(snapped, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(snapped.schema[c].dataType)) for c, v in defaults.items()})


def orphans(snapped: DataFrame, measurements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections no measurement row will ever pick up."""
    return snapped.join(measurements.select(*keys), list(keys), "left_anti")
