"""Hard gates and the geographic multiplier of the weighted generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.config import vocabulary as V
from rolesift.config.model import ScoringConfig
from rolesift.functions.text import (Found, any_of, any_pattern, find_phrases, is_diluted,
                                     present, strip)


def function_gate(title_lo: Column, cfg: ScoringConfig) -> Column:
    """Unlike the prefilter, leadership phrases are honoured before function phrases are
    looked at, and function phrases match anywhere in the title."""
    exceptions = cfg.leadership_exceptions
    present_ones = find_phrases(title_lo, exceptions)
    saved = F.exists(present_ones, lambda e: ~is_diluted(title_lo, e, cfg.diluting_prefixes))
    diluted = any_of(title_lo, exceptions)  # only reached when none of them is undiluted
    acronym = any_pattern(title_lo, [rf"\b(?:{'|'.join(cfg.leadership_acronyms)})\b"])
    return (F.when(any_of(title_lo, cfg.priority_titles), True)
            .when(saved | acronym, False)
            .otherwise(any_of(title_lo, cfg.function_titles) | diluted))


def seniority_gate(title_lo: Column, cfg: ScoringConfig) -> Column:
    """Junior phrases, and 'Associate …' unless it is an executive grade."""
    t = strip(title_lo)
    associate = F.startswith(t, F.lit("associate ")) | F.startswith(t, F.lit("associate,"))
    after = F.substr(t, F.lit(len("associate ") + 1))
    between = F.substring(after, F.lit(1), F.instr(after, "director") - 1)
    plain_director = F.contains(t, F.lit("associate director")) \
        & (F.instr(after, "director") > 0) & ~any_of(between, V.ASSOCIATE_CRAFT)
    return (F.when(any_of(t, cfg.keywords["seniority_disqualifiers"]), True)
            .when(associate & plain_director, False)
            .otherwise(associate & ~any_of(t, V.ASSOCIATE_PASSTHROUGH)))


def engagement_gate(text_lo: Column | Found, cfg: ScoringConfig) -> Column:
    return any_of(text_lo, cfg.keywords["engagement_disqualifiers"])


def compensation_gate(salary_min: Column, salary_max: Column, cfg: ScoringConfig) -> Column:
    """A stated salary under the floor; an absent one passes."""
    return F.coalesce(F.coalesce(salary_max, salary_min) < cfg.salary_floor, F.lit(False))


def is_remote(remote: Column, place_text: Column, cfg: ScoringConfig) -> Column:
    return F.coalesce(remote, F.lit(False)) \
        | any_pattern(place_text, cfg.location_patterns["remote_us"])


def geographic(title_lo: Column, location: Column, place_text: Column, remote: Column,
               cfg: ScoringConfig) -> Column:
    """struct(mult, score, label); first rule that applies decides."""
    p, s = cfg.location_patterns, cfg.location_scores

    def result(mult: float, score: str, label: str) -> Column:
        return F.struct(F.lit(mult).alias("mult"), F.lit(float(s[score])).alias("score"),
                        F.lit(label).alias("label"))

    nyc = any_pattern(place_text, p["nyc_metro"])
    return (F.when(any_pattern(place_text, cfg.relocation_patterns),
                   result(0.0, "international", "relocation_required"))
            .when(any_of(title_lo, V.INTERNATIONAL_TITLES) & ~remote,
                  result(0.0, "international", "international_title"))
            .when(remote, result(1.0, "remote_us", "remote_us"))
            .when(any_pattern(place_text, p["nj_office"]),
                  result(1.0, "nj_office", "nj_office"))
            .when(nyc & any_pattern(place_text, p["heavy_office"]),
                  result(1.0, "nyc_heavy", "nyc_heavy_office"))
            .when(nyc, result(1.0, "nyc_hybrid_3d", "nyc_hybrid"))
            .when(any_pattern(place_text, p["out_of_area"]),
                  result(0.0, "international", "out_of_area_required"))
            .when(any_of(F.lower(location), V.US_LOCATION_TERMS),
                  result(1.0, "ambiguous", "us_unspecified"))
            .otherwise(result(0.5, "ambiguous", "ambiguous")))


def triggered(seniority: Column, function: Column, compensation: Column, engagement: Column,
              geo_mult: Column) -> Column:
    """Names of the gates that fired, in reporting order."""
    return present({"seniority": seniority, "function": function,
                    "compensation": compensation, "engagement": engagement,
                    "geographic": geo_mult == 0.0})
