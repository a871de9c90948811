"""Deterministic removal of duplicate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the smallest by all other columns (``order`` first, then column order).

    The minimum of a struct is combined before the shuffle, so a key with very
    many copies leaves each input task as a single row. Nulls sort first, and
    null keys form one group each.
    """
    keys = list(keys)
    lead = [c for c in (order or []) if c not in keys]
    rest = lead + [c for c in df.columns if c not in keys and c not in lead]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__first.`{c}`").alias(c) for c in df.columns])
