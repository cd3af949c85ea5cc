"""Queries over the driver tables and their SQL twins."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import scoring_queries, scalar_queries, browse_queries, source_queries  # noqa: F401
from catalog import ingest_queries, layout_queries  # noqa: F401
