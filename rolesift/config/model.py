"""Typed configuration passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rolesift.config import vocabulary as V


def function_titles(crafts=None, roles=None, phrases=None) -> list[str]:
    """Craft x role titles plus whole phrases, in a stable order without repeats."""
    crafts = V.FUNCTION_CRAFTS if crafts is None else crafts
    roles = V.FUNCTION_ROLES if roles is None else roles
    phrases = V.FUNCTION_PHRASES if phrases is None else phrases
    return list(dict.fromkeys([f"{c} {r}" for c in crafts for r in roles] + list(phrases)))


def _keywords() -> dict[str, list[str]]:
    s = V.POSITIVE_SIGNALS
    return {
        "strategy": s["strategy"],
        "program_architecture": s["architecture"],
        "ma_integration": s["ma_pmi"],
        "senior_titles": s["senior_titles"],
        "d2c_payments": V.D2C_PAYMENTS,
        "hands_on_coding": V.WARN_HANDS_ON,
        "seniority_disqualifiers": V.SENIORITY_TITLES,
        "helping_people": s["mission"],
        "gaming_culture": s["gaming"],
        "music_connection": s["music"],
        "immersive_experiential": s["immersive"],
        "ccg_boardgame": s["tcg_boardgame"],
        "family_friendly": s["family_friendly"],
        "crunch_pace": V.WARN_CRUNCH,
        "culture_red_flags": V.WARN_CULTURE,
        "lgbtq_signals": s["lgbtq"],
        "interim_fractional": s["interim"],
        "engagement_disqualifiers": V.UNPAID_PHRASES,
        "nj_office": s["nj_office"],
    }


@dataclass(frozen=True)
class ScoringConfig:
    """All dictionaries and thresholds; every field can be replaced."""

    function_titles: list[str] = field(default_factory=function_titles)
    #: Characters of a description in a scorer request; None sends the whole text.
    description_limit: int | None = None
    seniority_titles: list[str] = field(default_factory=lambda: V.SENIORITY_TITLES)
    unpaid_phrases: list[str] = field(default_factory=lambda: V.UNPAID_PHRASES)
    leadership_exceptions: list[str] = field(default_factory=lambda: V.LEADERSHIP_EXCEPTIONS)
    leadership_acronyms: list[str] = field(default_factory=lambda: V.LEADERSHIP_ACRONYMS)
    leadership_patterns: list[str] = field(default_factory=lambda: V.LEADERSHIP_PATTERNS)
    priority_titles: list[str] = field(default_factory=lambda: V.PRIORITY_TITLES)
    diluting_prefixes: list[str] = field(default_factory=lambda: V.DILUTING_PREFIXES)
    positive_signals: dict[str, list[str]] = field(default_factory=lambda: V.POSITIVE_SIGNALS)
    industry_scores: dict[str, int] = field(default_factory=lambda: V.INDUSTRY_SCORES)
    industry_keywords: dict[str, list[str]] = field(default_factory=lambda: V.INDUSTRY_KEYWORDS)
    pivot_industries: list[str] = field(default_factory=lambda: V.PIVOT_INDUSTRIES)
    location_patterns: dict[str, list[str]] = field(default_factory=lambda: V.LOCATION_PATTERNS)
    relocation_patterns: list[str] = field(default_factory=lambda: V.RELOCATION_PATTERNS)
    tiers: dict[str, int] = field(default_factory=lambda: V.TIERS)
    keywords: dict[str, list[str]] = field(default_factory=_keywords)
    weights: dict[str, float] = field(default_factory=lambda: V.CATEGORY_WEIGHTS)
    location_scores: dict[str, int] = field(default_factory=lambda: V.LOCATION_SCORES)
    modifier_deltas: dict[str, int] = field(default_factory=lambda: V.MODIFIER_DELTAS)
    salary_floor: int = V.SALARY_FLOOR
    compensation: dict[str, float] = field(default_factory=lambda: V.COMPENSATION)
    default_industry: str = "general_enterprise_tech"
    default_industry_score: int = 3
    qol_weights: dict[str, int] = field(default_factory=lambda: V.QOL_WEIGHTS)
    qol_keywords: dict[str, list[str]] = field(default_factory=lambda: {
        "equity_keywords": V.QOL_EQUITY,
        "benefits_keywords": V.QOL_BENEFITS,
        "flexibility_keywords": V.QOL_FLEXIBILITY,
    })
    qol_salary_floor: int = V.QOL_SALARY_FLOOR
    qol_recent_days: int = V.QOL_RECENT_DAYS
    industries: dict[str, dict] = field(default_factory=lambda: V.TAXONOMY_INDUSTRIES)
    role_types: dict[str, dict] = field(default_factory=lambda: V.TAXONOMY_ROLE_TYPES)
    company_groups: dict[str, list[str]] = field(default_factory=lambda: V.TAXONOMY_GROUPS)
    company_industries: dict[str, str] = field(default_factory=lambda: V.COMPANY_INDUSTRIES)
    equality_companies: list[str] = field(default_factory=lambda: V.EQUALITY_COMPANIES)
    crunch_companies: list[str] = field(default_factory=lambda: V.CRUNCH_COMPANIES)
    crunch_reduced: list[str] = field(default_factory=lambda: V.CRUNCH_REDUCED_COMPANIES)
    cache_days: int = 7
    verdicts_enabled: bool = True
    word_boundary_seniority: bool = False

    def with_(self, **changes: Any) -> "ScoringConfig":
        return replace(self, **changes)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Dictionaries as rows (kind, bucket, ord, phrase); bounded by the config itself."""
        rows: list[tuple[str, str, int, str]] = []
        for kind in ("positive_signals", "industry_keywords", "keywords", "qol_keywords",
                     "company_groups"):
            for bucket, phrases in getattr(self, kind).items():
                rows += [(kind, bucket, i, p) for i, p in enumerate(phrases)]
        for kind in ("function_titles", "seniority_titles", "unpaid_phrases",
                     "priority_titles", "leadership_exceptions"):
            rows += [(kind, kind, i, p) for i, p in enumerate(getattr(self, kind))]
        return spark.createDataFrame(rows, "kind string, bucket string, ord int, phrase string")


def _lower_all(value: Any) -> Any:
    if isinstance(value, list):
        return [v.lower() if isinstance(v, str) else v for v in value]
    if isinstance(value, dict):
        return {k: _lower_all(v) for k, v in value.items()}
    return value


_CASED = {"location_patterns", "relocation_patterns", "leadership_patterns"}


def config_from_dict(raw: dict[str, Any]) -> ScoringConfig:
    """Build a config from parsed YAML.

    Tier thresholds and modifier deltas are accepted both flat (``T1: 78``) and nested
    (``T1: {min_score: 78}`` / ``{delta: 10}``); phrases are lower-cased; unknown keys
    are ignored so a richer file still loads.
    """
    base = ScoringConfig()
    known = {f.name for f in fields(ScoringConfig)}
    changes: dict[str, Any] = {}
    for key, value in (raw or {}).items():
        if key not in known or value is None:
            continue
        changes[key] = value if key in _CASED else _lower_all(value)
    if "tiers" in changes:
        flat = {k: (v.get("min_score") if isinstance(v, dict) else v)
                for k, v in raw["tiers"].items()}
        changes["tiers"] = {k: int(flat.get(k) if flat.get(k) is not None else d)
                            for k, d in base.tiers.items()}
    if "modifier_deltas" in changes:
        flat = {k: (v.get("delta", 0) if isinstance(v, dict) else v)
                for k, v in raw["modifier_deltas"].items()}
        changes["modifier_deltas"] = {k: int(flat.get(k, 0)) for k in base.modifier_deltas}
    for name in ("keywords", "weights", "location_scores", "qol_weights", "qol_keywords",
                 "compensation"):
        if name in changes:
            changes[name] = {**getattr(base, name), **changes[name]}
    return replace(base, **changes)


def load_config(path: str) -> ScoringConfig:
    """Read a YAML (or JSON) file from the driver's file system."""
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    try:
        import yaml
        raw = yaml.safe_load(text)
    except ImportError:  # JSON is a subset of YAML
        import json
        raw = json.loads(text)
    return config_from_dict(raw or {})
