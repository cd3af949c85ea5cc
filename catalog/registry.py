"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.bindings import sql as with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(key: str, query: Query, body: str | None = None, *views: str) -> None:
    if key in QUERIES:
        raise ValueError(f"query {key} registered twice")
    QUERIES[key] = query
    if body is not None:
        ORACLES[key] = with_views(body, *views)


def joined(column: str):
    """Array as text, order kept."""
    return F.coalesce(F.array_join(F.col(column), "|"), F.lit("")).alias(column)
