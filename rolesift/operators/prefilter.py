"""Binary prefilter: hard disqualifiers, soft warnings and context flags of a posting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.config import vocabulary as V
from rolesift.config.model import ScoringConfig
from rolesift.functions.text import (Found, any_of, any_pattern, build_text, find_phrases,
                                     first_of, first_pattern, first_phrase, is_diluted,
                                     literals, longest_phrase, percent_after, present,
                                     text_or_empty, which_of)
from rolesift.operators.companies import with_company_facts

TEXTS = ("title_lo", "text_lo", "place_text", "function_hit", "text_found", "title_found")


def text_phrases(cfg: ScoringConfig) -> list[str]:
    """Everything the prefilter looks for in the full text."""
    lists = [cfg.unpaid_phrases, V.WARN_CRUNCH, V.WARN_CULTURE, V.WARN_RTO, V.WARN_HANDS_ON,
             *cfg.positive_signals.values(), *cfg.industry_keywords.values()]
    return [p for phrases in lists for p in phrases]


def title_phrases(cfg: ScoringConfig) -> list[str]:
    """Phrases of many-listed title rules."""
    return [*cfg.leadership_exceptions, *V.WARN_TEMP_CONTRACT, *V.WARN_D2C_TITLE, *V.WARN_TPM,
            *V.WARN_BELOW_VP, *cfg.positive_signals["senior_titles"]]


def with_texts(df: DataFrame, cfg: ScoringConfig, also: Sequence[str] = ()) -> DataFrame:
    """Lower-cased title, full text and place text, built once and read by every rule.

    ``also``: phrases of other rules over the full text, looked for in the same pass.

    They sit in their own projection: the optimizer keeps a projection whose expensive
    columns are read more than once, so the concatenation is not repeated per phrase.
    """
    title, company, desc = F.col("title"), F.col("company"), F.col("description")
    out = df.withColumns({
        "title_lo": F.lower(text_or_empty(title)),
        "text_lo": build_text(title, company, desc, keep_empty=True),
        "place_text": F.concat_ws(" ", text_or_empty(F.col("location")),
                                  text_or_empty(title), text_or_empty(desc)),
    })
    return out.withColumns({
        "function_hit": longest_phrase(F.col("title_lo"), cfg.function_titles),
        "text_found": find_phrases(F.col("text_lo"), [*text_phrases(cfg), *also]),
        "title_found": find_phrases(F.col("title_lo"), title_phrases(cfg)),
    })


def is_leadership_title(title_lo: Column, cfg: ScoringConfig) -> Column:
    return any_pattern(title_lo, cfg.leadership_patterns)


def wrong_function(title_lo: Column, function_hit: Column, title_found: Column,
                   cfg: ScoringConfig) -> Column:
    """Disqualifier text, NULL when the title's function is acceptable.

    Priority phrases always disqualify. Otherwise a function phrase must be present, and a
    leadership pattern, an undiluted leadership phrase or an executive acronym saves it.
    """
    exceptions = literals(cfg.leadership_exceptions)
    priority = first_phrase(title_lo, cfg.priority_titles)
    saved = F.exists(title_found, lambda e: e.isin(cfg.leadership_exceptions)
                     & ~is_diluted(title_lo, e, cfg.diluting_prefixes))
    diluted = F.get(F.filter(exceptions, lambda e: F.array_contains(title_found, e)
                             & is_diluted(title_lo, e, cfg.diluting_prefixes)), 0)
    acronym = any_pattern(title_lo, [rf"\b(?:{'|'.join(cfg.leadership_acronyms)})\b"])
    return (F.when(priority.isNotNull(), F.concat(F.lit("priority_disqualifier:"), priority))
            .when(function_hit == "", F.lit(None).cast("string"))
            .when(is_leadership_title(title_lo, cfg) | saved | acronym,
                  F.lit(None).cast("string"))
            .when(diluted.isNotNull(), F.concat(F.lit("diluted_exception:"), diluted))
            .otherwise(F.concat(F.lit("wrong_function:"), function_hit)))


def seniority(title_lo: Column, cfg: ScoringConfig) -> Column:
    """First junior phrase in the title. Plain substrings, so 'intern' also hits
    'international'; ``word_boundary_seniority`` asks for whole words instead."""
    if cfg.word_boundary_seniority:
        hit = longest_phrase(title_lo, cfg.seniority_titles)
        hit = F.nullif(hit, F.lit(""))
    else:
        hit = F.trim(first_phrase(title_lo, cfg.seniority_titles))
    return F.concat(F.lit("sub_vp_seniority:"), hit)


def unpaid(text_lo: Column | Found, cfg: ScoringConfig) -> Column:
    return F.concat(F.lit("unpaid_engagement:"), first_phrase(text_lo, cfg.unpaid_phrases))


def industry(map_industry: Column, text_lo: Column | Found, cfg: ScoringConfig,
             default: str = "unknown") -> Column:
    """Bucket of the company when mapped, else first keyword bucket, else ``default``."""
    return F.coalesce(map_industry, first_of(text_lo, cfg.industry_keywords), F.lit(default))


def industry_score(bucket: Column, cfg: ScoringConfig, default: int = 0) -> Column:
    by_score: dict[int, list[str]] = {}
    for name, score in cfg.industry_scores.items():
        by_score.setdefault(int(score), []).append(name)
    return F.coalesce(*[F.when(bucket.isin(names), F.lit(s)) for s, names in by_score.items()],
                      F.lit(int(default)))


def location_flag(place_text: Column, cfg: ScoringConfig) -> Column:
    return first_pattern(place_text, cfg.location_patterns, "unknown")


def positive_signals(text_lo: Column | Found, cfg: ScoringConfig) -> Column:
    return which_of(text_lo, cfg.positive_signals)


def soft_warnings(title: Column | Found, text_lo: Column, flag: Column, cfg: ScoringConfig,
                  found: Found | None = None) -> Column:
    text = found or text_lo
    strong = [p for p in cfg.positive_signals["senior_titles"]
              if p not in V.WEAK_SENIOR_TITLES]
    return present({
        "temp_contract": any_of(title, V.WARN_TEMP_CONTRACT),
        "d2c_in_title": any_of(title, V.WARN_D2C_TITLE),
        "tpm_title": any_of(title, V.WARN_TPM),
        "below_vp": any_of(title, V.WARN_BELOW_VP) & ~any_of(title, strong),
        "crunch_language": any_of(text, V.WARN_CRUNCH),
        "culture_red_flags": any_of(text, V.WARN_CULTURE),
        "high_travel": percent_after(text_lo, V.TRAVEL_PATTERN, 2) >= 50,
        "rto_mandate": (flag == "heavy_office") | any_of(text, V.WARN_RTO),
        "hands_on_coding": any_of(text, V.WARN_HANDS_ON),
    })


def track(signals: Column, bucket: Column, cfg: ScoringConfig) -> Column:
    return (F.when(F.array_contains(signals, "interim"), "TRACK_2_INTERIM")
            .when(bucket.isin(cfg.pivot_industries), "TRACK_3_PIVOT")
            .otherwise("TRACK_1_FULLTIME"))


def prefilter(df: DataFrame, cfg: ScoringConfig, companies: DataFrame | None = None,
              also: Sequence[str] = (), found_as: str | None = None) -> DataFrame:
    """Add the verdict columns of the prefilter to every posting.

    With ``found_as`` the phrases in the full text stay in that column, those of ``also`` among
    them, so that other rules need not read the text again.

    Columns added: passed_prefilter, prefilter_reason, hard_disqualifiers, soft_warnings,
    positive_signals, industry, industry_score, track, location_flag, is_dream_company,
    is_hrc100, is_crunch_co, is_leadership_title.
    """
    base = with_texts(with_company_facts(df, cfg, companies), cfg, also)
    t, x, found = F.col("title_lo"), F.col("text_lo"), Found(F.col("text_found"))
    first = base.withColumns({
        "_function": wrong_function(t, F.col("function_hit"), F.col("title_found"), cfg),
        "_seniority": seniority(t, cfg),
        # A short list of its own: who only asks what passed need not search for all phrases.
        "_unpaid": unpaid(x, cfg),
        "industry": industry(F.col("map_industry"), found, cfg),
        "location_flag": location_flag(F.col("place_text"), cfg),
        "positive_signals": positive_signals(found, cfg),
        "is_leadership_title": is_leadership_title(t, cfg),
        "is_hrc100": F.col("is_equality_co"),
        "is_crunch_co": F.col("is_crunch_listed") & ~F.col("is_crunch_reduced"),
    })
    second = first.withColumns({
        "hard_disqualifiers": F.array_compact(F.array("_function", "_seniority", "_unpaid")),
        "prefilter_reason": F.coalesce("_function", "_seniority", "_unpaid",
                                       F.lit("passed")),
        "passed_prefilter": F.coalesce("_function", "_seniority", "_unpaid").isNull(),
        "industry_score": industry_score(F.col("industry"), cfg),
        "soft_warnings": soft_warnings(
            Found(F.col("title_found")), x, F.col("location_flag"), cfg, found),
        "track": track(F.col("positive_signals"), F.col("industry"), cfg),
    })
    third = second.withColumn("is_dream_company", F.col("map_industry").isNotNull()
                              & (F.col("industry_score") >= 9))
    if found_as is not None:
        third = third.withColumn(found_as, F.col("text_found"))
    return third.drop("_function", "_seniority", "_unpaid", *TEXTS, "company_key",
                      "map_industry", "is_equality_co", "is_crunch_listed",
                      "is_crunch_reduced")
