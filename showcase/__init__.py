"""Registered queries over the test tables, each with equivalent SQL where SQL can say it."""

from . import analysis, ingestion, joins, models, projections, quality, series, tables  # noqa: F401
from .base import REGISTRY

__all__ = ["REGISTRY"]
