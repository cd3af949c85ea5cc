"""Ingest: landed payloads to scored postings merged into the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig
from rolesift.operators.combine import union_sources
from rolesift.operators.tables import SCORE_COLUMNS, carry_verdicts, rescore, upsert_postings
from rolesift.sources.specs import SPECS, normalize_source


def normalize_archive(raw: DataFrame, as_of: Column,
                      sources: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Postings of every JSON source in a raw archive, and the sources that failed.

    A source whose plan cannot be built is reported and the others go on; bad payloads
    inside a source fall out through the required fields.
    """
    parts: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name in sources or [n for n, s in SPECS.items() if s.schema]:
        try:
            parts[name] = normalize_source(raw.where(F.col("source") == name), SPECS[name],
                                           as_of)
        except Exception as exc:
            failed[name] = f"{type(exc).__name__}: {exc}"
    return union_sources(parts), failed


def score_incoming(incoming: DataFrame, existing: DataFrame, verdicts: DataFrame,
                   cfg: ScoringConfig, as_of: Column,
                   companies: DataFrame | None = None) -> DataFrame:
    """Incoming postings with stored verdict fields carried over and scores computed.

    Where a verdict is wanted but missing, the posting is kept unscored and the stored
    score, if any, survives the merge.
    """
    carried = carry_verdicts(incoming.drop("score", "track", "score_posted"), existing)
    scored = rescore(carried, verdicts, cfg, as_of, companies)
    first_time = F.col("outcome") == "api_failed"
    return scored.withColumns({
        "tier": F.when(first_time, F.lit(None).cast("string")).otherwise(F.col("tier")),
    }).drop("outcome", "verdict_state")


def ingest(existing: DataFrame, incoming: DataFrame, verdicts: DataFrame, cfg: ScoringConfig,
           as_of: Column, companies: DataFrame | None = None) -> DataFrame:
    """New table state: one merge on job_id after scoring the incoming side."""
    scored = score_incoming(incoming, existing, verdicts, cfg, as_of, companies)
    merged = upsert_postings(existing, scored)
    defaults = {"score": F.coalesce("score", F.lit(0)),
                "track": F.coalesce("track", F.lit("unscored")),
                "tier": F.coalesce("tier", F.lit("needs_review"))}
    return merged.withColumns({k: v for k, v in defaults.items() if k in SCORE_COLUMNS})
