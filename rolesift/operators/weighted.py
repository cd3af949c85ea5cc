"""Weighted generation: ten category scores, gates and modifiers to one 0-100 score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.config import vocabulary as V
from rolesift.config.model import ScoringConfig
from rolesift.functions.text import (Found, any_of, build_text, count_of, find_phrases,
                                     first_value, percent_after, text_or_empty)
from rolesift.operators import gates, modifiers, prefilter
from rolesift.operators.companies import with_company_facts


def _mean(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts) / float(len(parts))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), c))


def _capped(hits: Column, step: float) -> Column:
    return F.least(F.lit(10.0), hits * step)


def _avoided(hits: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(10.0) - hits * 3.0)


def leadership_level(title_lo: Column) -> Column:
    """Seniority of a title, 1 to 10; 'principal' before a craft is an individual."""
    return F.when(any_of(title_lo, V.IC_PRINCIPAL), 1.0)\
        .otherwise(first_value(title_lo, V.LEADERSHIP_LEVELS, 1.0))


def role_fit(title_lo: Column, role_text: Column | Found, cfg: ScoringConfig) -> Column:
    kw = cfg.keywords
    return _mean(_capped(count_of(role_text, kw["strategy"]), 2.0),
                 _capped(count_of(role_text, kw["program_architecture"]), 2.0),
                 _capped(count_of(role_text, kw["ma_integration"]), 3.0),
                 leadership_level(title_lo),
                 _avoided(count_of(role_text, kw["d2c_payments"])),
                 _avoided(count_of(role_text, kw["hands_on_coding"])))


def compensation(salary_min: Column, salary_max: Column, desc_lo: Column | Found,
                 cfg: ScoringConfig) -> Column:
    c = cfg.compensation
    ref = F.coalesce(salary_max, salary_min).cast("double")
    span = float(c["mid_upper"] - c["mid_lower"])
    pay = (F.when(ref.isNull(), float(c["neutral"]))
           .when((ref < c["low"]) | (ref < c["mid_lower"]), 2.0)
           .when(ref < c["mid_upper"], (ref - float(c["mid_lower"])) / span * 3.0 + 5.0)
           .when(ref <= c["high_max"], 10.0)
           .when(ref <= c["overpay_max"], 9.0)
           .otherwise(7.0))
    hits = count_of(desc_lo, cfg.keywords["family_friendly"] + V.BENEFIT_TERMS)
    benefits = (F.when(hits >= 4, 10.0).when(hits >= 2, 6.0).when(hits == 1, 3.0)
                .otherwise(float(c["neutral"])))
    equity = first_value(desc_lo, V.EQUITY_STEPS, 0.0)
    return F.least(F.lit(10.0), (pay + benefits) / 2.0 + equity)


def passion(text_lo: Column | Found, industry: Column, cfg: ScoringConfig) -> Column:
    kw = cfg.keywords
    near = industry.isin(V.GAMING_ADJACENT)
    themes = [
        any_of(text_lo, kw["helping_people"]),
        near | any_of(text_lo, kw["gaming_culture"]),
        any_of(text_lo, kw["music_connection"]),
        any_of(text_lo, kw["immersive_experiential"]),
        industry.isin(V.GAMING_ADJACENT + V.STRATEGY_PASSION_EXTRA)
        & any_of(text_lo, kw["strategy"]),
        any_of(text_lo, kw["ccg_boardgame"]),
        near & any_of(text_lo, V.ACCESSIBLE_GAMING),
    ]
    points = [F.when(t, 2.0).otherwise(0.0) for t in themes]
    return F.least(F.lit(10.0), reduce(lambda a, b: a + b, points))


def work_life(text_lo: Column | Found, raw_text: Column, crunch: Column, reduced: Column,
              cfg: ScoringConfig) -> Column:
    kw = cfg.keywords
    travel = percent_after(raw_text, V.TRAVEL_PATTERN, 2)
    score = (F.lit(7.0)
             - F.when(reduced, 1.0).when(crunch, 2.5).otherwise(0.0)
             - count_of(text_lo, kw["crunch_pace"]) * 0.5
             - count_of(text_lo, kw["culture_red_flags"]) * 1.0
             + count_of(text_lo, kw["family_friendly"]) * 0.5
             - F.when(travel >= 50, 2.0).when(travel >= 25, 0.5).otherwise(0.0)
             - F.when(any_of(text_lo, V.ON_CALL), 1.5).otherwise(0.0))
    return _clamp(score)


def company_health(desc_lo: Column | Found) -> Column:
    steps = [F.when(any_of(desc_lo, ps), F.lit(v)).otherwise(0.0) for ps, v in V.HEALTH_STEPS]
    return _clamp(reduce(lambda a, b: a + b, steps, F.lit(7.0)))


def trajectory(title_lo: Column, desc_lo: Column | Found, company_key: Column) -> Column:
    reporting = F.when(any_of(desc_lo, V.REPORTS_TO_C), 10.0)\
        .when(any_of(desc_lo, V.REPORTS_TO_DIRECTOR), 4.0).otherwise(6.0)
    scope = F.when(any_of(desc_lo, V.SCOPE_NARROW), 5.0)\
        .when(any_of(desc_lo, V.SCOPE_WIDE), 8.0).otherwise(6.0)
    brand = F.when(company_key.isin(V.BRAND_COMPANIES), 8.0).otherwise(6.0)
    return _mean(leadership_level(title_lo), reporting, scope, brand)


def culture(text_lo: Column | Found, equality_company: Column, cfg: ScoringConfig) -> Column:
    hits = count_of(text_lo, cfg.keywords["lgbtq_signals"])
    return (F.when(any_of(text_lo, V.CULTURE_ROLLBACK), 0.0).when(equality_company, 10.0)
            .when(hits >= 3, 6.0).when(hits >= 1, 4.0).otherwise(3.0))


def engagement(text_lo: Column | Found) -> Column:
    return first_value(text_lo, V.ENGAGEMENT_STEPS, 9.0)


def tier_from_score(score: Column, cfg: ScoringConfig) -> Column:
    ordered = sorted(cfg.tiers.items(), key=lambda kv: -kv[1])
    return F.coalesce(*[F.when(score >= cut, F.lit(name)) for name, cut in ordered],
                      F.lit("skip"))


def track_of_text(text_lo: Column | Found, industry: Column, cfg: ScoringConfig) -> Column:
    return (F.when(any_of(text_lo, cfg.keywords["interim_fractional"]), "TRACK_2_INTERIM")
            .when(industry.isin(cfg.pivot_industries), "TRACK_3_PIVOT")
            .otherwise("TRACK_1_FULLTIME"))


def text_phrases(cfg: ScoringConfig) -> list[str]:
    """Everything looked for in title, company, description and location together."""
    lists = [*cfg.keywords.values(), *cfg.industry_keywords.values(), V.ACCESSIBLE_GAMING,
             V.ON_CALL, V.CULTURE_ROLLBACK, *[ps for ps, _ in V.ENGAGEMENT_STEPS],
             V.MOD_IMMERSIVE, V.MOD_TCG, V.MOD_MISSION, V.MOD_INCLUSIVE_HEALTH,
             V.POSITIVE_SIGNALS["multiplayer_live_service"]]
    return [p for phrases in lists for p in phrases]


def description_phrases(cfg: ScoringConfig) -> list[str]:
    lists = [cfg.keywords["family_friendly"], V.BENEFIT_TERMS, V.REPORTS_TO_C,
             V.REPORTS_TO_DIRECTOR, V.SCOPE_WIDE, V.SCOPE_NARROW,
             *[ps for ps, _ in V.EQUITY_STEPS], *[ps for ps, _ in V.HEALTH_STEPS]]
    return [p for phrases in lists for p in phrases]


def role_phrases(cfg: ScoringConfig) -> list[str]:
    names = ("strategy", "program_architecture", "ma_integration", "d2c_payments",
             "hands_on_coding")
    return [p for n in names for p in cfg.keywords[n]]


def with_texts(df: DataFrame, cfg: ScoringConfig,
               companies: DataFrame | None = None) -> DataFrame:
    """Texts and facts shared by gates, categories and modifiers."""
    base = with_company_facts(df, cfg, companies)
    title, desc, loc = F.col("title"), F.col("description"), F.col("location")
    texts = base.withColumns({
        "title_lo": F.lower(text_or_empty(title)),
        "desc_lo": F.lower(text_or_empty(desc)),
        "role_text": build_text(title, desc, keep_empty=True),
        "text_lo": build_text(title, F.col("company"), desc, loc),
        "place_text": F.concat_ws(" ", text_or_empty(title), text_or_empty(desc),
                                  F.lower(text_or_empty(loc))),
    })
    found = texts.withColumn("text_found", find_phrases(F.col("text_lo"), text_phrases(cfg)))
    return found.withColumns({
        "industry": prefilter.industry(F.col("map_industry"), Found(F.col("text_found")), cfg,
                                       cfg.default_industry),
        "is_remote": gates.is_remote(F.col("remote"), F.col("place_text"), cfg),
    })


def category_scores(cfg: ScoringConfig) -> dict[str, Column]:
    """Category name to 0-10 score, over the columns of ``with_texts`` and ``geo``."""
    t, x = F.col("title_lo"), Found(F.col("text_found"))
    d, r = Found(F.col("desc_found")), Found(F.col("role_found"))
    return {
        "role_fit": role_fit(t, r, cfg),
        "industry_alignment": prefilter.industry_score(
            F.col("industry"), cfg, cfg.default_industry_score).cast("double"),
        "compensation": compensation(F.col("salary_min"), F.col("salary_max"), d, cfg),
        "geographic": F.col("geo.score"),
        "passion_identity": passion(x, F.col("industry"), cfg),
        "work_life_quality": work_life(x, F.col("text_lo"), F.col("is_crunch_listed"),
                                       F.col("is_crunch_reduced"), cfg),
        "company_health": company_health(d),
        "career_trajectory": trajectory(t, d, F.col("company_key")),
        "cultural_alignment": culture(x, F.col("is_equality_co"), cfg),
        "engagement_type": engagement(x),
    }


def with_gates(df: DataFrame, cfg: ScoringConfig) -> DataFrame:
    t = F.col("title_lo")
    out = df.withColumns({
        "geo": gates.geographic(t, F.col("location"), F.col("place_text"),
                                F.col("is_remote"), cfg),
        "gate_engagement": gates.engagement_gate(Found(F.col("text_found")), cfg),
        "gate_seniority": gates.seniority_gate(t, cfg),
        "gate_function": gates.function_gate(t, cfg),
        "gate_compensation": gates.compensation_gate(F.col("salary_min"),
                                                     F.col("salary_max"), cfg),
    })
    return out.withColumn("gates_triggered", gates.triggered(
        F.col("gate_seniority"), F.col("gate_function"), F.col("gate_compensation"),
        F.col("gate_engagement"), F.col("geo.mult")))


def with_found(df: DataFrame, cfg: ScoringConfig, wanted: Column) -> DataFrame:
    """Phrases of the description and of title plus description, where wanted."""
    return df.withColumns({
        "desc_found": F.when(wanted, find_phrases(F.col("desc_lo"),
                                                  description_phrases(cfg))),
        "role_found": F.when(wanted, find_phrases(F.col("role_text"), role_phrases(cfg))),
    })


SCRATCH = ("text_found", "desc_found", "role_found", "title_lo", "desc_lo", "role_text", "text_lo", "place_text", "is_remote", "geo",
           "gate_engagement", "gate_seniority", "gate_function", "gate_compensation",
           "company_key", "map_industry", "is_equality_co", "is_crunch_listed",
           "is_crunch_reduced")


def weighted_score(df: DataFrame, cfg: ScoringConfig,
                   companies: DataFrame | None = None) -> DataFrame:
    """Add score, tier, track, score_breakdown, gates_triggered and modifiers_applied.

    A gated posting scores 0. Its categories and modifiers are guarded by the gate test,
    so the phrase scans run only for postings that get past the gates.
    """
    open_ = F.size("gates_triggered") == 0
    gated = with_found(with_gates(with_texts(df, cfg, companies), cfg), cfg, open_)
    parts = category_scores(cfg)
    scored = gated.withColumns({
        "_cat": F.when(open_, F.struct(*[c.alias(n) for n, c in parts.items()])),
        "_mods": F.when(open_, modifiers.fired(cfg)),
    })
    weighted = reduce(lambda a, b: a + b,
                      [F.col(f"_cat.{n}") * F.lit(float(cfg.weights.get(n, 0.0)))
                       for n in parts])
    raw = weighted * F.col("geo.mult") * 10.0 + modifiers.total(F.col("_mods"))
    final = F.when(open_, F.greatest(F.lit(0), F.least(F.lit(100),
                                                       F.bround(raw).cast("int")))).otherwise(0)
    breakdown = F.create_map(*[x for n in parts
                               for x in (F.lit(n), F.bround(F.col(f"_cat.{n}"), 2))])
    out = scored.withColumns({
        "score": final,
        "track": track_of_text(Found(F.col("text_found")), F.col("industry"), cfg),
        "score_breakdown": F.when(open_, breakdown).otherwise(
            F.create_map().cast("map<string,double>")),
        "modifiers_applied": F.when(open_, F.transform("_mods", lambda m: m["name"]))
        .otherwise(F.array().cast("array<string>")),
    })
    return out.withColumn("tier", F.when(open_, tier_from_score(F.col("score"), cfg))
                          .otherwise("skip")).drop("_cat", "_mods", *SCRATCH)
