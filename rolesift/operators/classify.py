"""Classifiers that do not depend on the verdict: tags, quality of life, engagement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.config import vocabulary as V
from rolesift.config.model import ScoringConfig
from rolesift.functions.text import (Found, any_of, build_text, find_phrases, first_of, present,
                                     text_or_empty)
from rolesift.operators.companies import company_key


def industries(text_lo: Column | Found, key: Column, cfg: ScoringConfig) -> Column:
    """Every industry whose company list holds the company or whose keywords hit."""
    flags = {}
    for name, rule in cfg.industries.items():
        hit = any_of(text_lo, rule.get("keywords") or [])
        listed = rule.get("companies") or []
        flags[name] = key.isin(listed) | hit if listed else hit
    return present(flags)


def role_types(title_lo: Column, text_lo: Column | Found, cfg: ScoringConfig) -> Column:
    """Role types by title; an excluded title does not fall back to the description."""
    flags = {}
    for name, rule in cfg.role_types.items():
        in_title = any_of(title_lo, rule.get("title_keywords") or [])
        excluded = any_of(title_lo, rule.get("title_excludes") or [])
        in_text = any_of(text_lo, rule.get("description_keywords") or [])
        flags[name] = F.when(in_title, ~excluded).otherwise(in_text)
    return present(flags)


def company_group(key: Column, tier: Column, cfg: ScoringConfig) -> Column:
    """Tier group first, then the first configured group that lists the company."""
    t = F.upper(F.trim(tier))
    groups = [F.when(key.isin(names), F.lit(n)) for n, names in cfg.company_groups.items()
              if names]
    return F.when(key != "", F.coalesce(
        F.when(t == "S", "tier_s"), F.when(t == "1", "tier_1"), F.when(t == "2", "tier_2"),
        *groups, F.lit(None).cast("string")))


def padded(text: Column) -> Column:
    """Lower-cased with a space on both sides, so phrases can ask for word edges."""
    return F.concat(F.lit(" "), F.lower(text_or_empty(text)), F.lit(" "))


def engagement_of(title: Column | Found, description: Column | Found, blank: Column) -> Column:
    """Engagement label: every rule against the title first, then the description."""
    return F.coalesce(first_of(title, V.ENGAGEMENT_RULES),
                      first_of(description, V.ENGAGEMENT_RULES),
                      F.when(blank, "unclear"), F.lit("fulltime"))


def engagement_type(title: Column, description: Column) -> Column:
    blank = F.btrim(padded(title), F.lit(" \t\n\r\x0b\x0c")) == ""
    return engagement_of(padded(title), padded(description), blank)


def qol_breakdown(work_mode: Column, salary_min: Column, salary_max: Column,
                  posted_at: Column, description: Column | Found, as_of: Column,
                  cfg: ScoringConfig) -> Column:
    """map(name -> points) of the quality-of-life signals that fired."""
    w = cfg.qol_weights
    mode = F.lower(F.trim(text_or_empty(work_mode)))
    desc = description if isinstance(description, Found) \
        else F.lower(text_or_empty(description))
    lo, hi = F.when(salary_min > 0, salary_min), F.when(salary_max > 0, salary_max)
    paid = F.coalesce(lo, hi)
    conditions = {
        "work_mode_remote": mode == "remote",
        "work_mode_hybrid": mode == "hybrid",
        "salary_listed": paid.isNotNull(),
        "salary_above_floor": F.coalesce(paid >= cfg.qol_salary_floor, F.lit(False)),
        "posted_recent": F.coalesce(
            posted_at > as_of - F.make_dt_interval(days=F.lit(cfg.qol_recent_days)),
            F.lit(False)),
        "equity_keywords": any_of(desc, cfg.qol_keywords["equity_keywords"]),
        "benefits_keywords": any_of(desc, cfg.qol_keywords["benefits_keywords"]),
        "flexibility_keywords": any_of(desc, cfg.qol_keywords["flexibility_keywords"]),
    }
    entries = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(n).alias("key"), F.lit(int(w[n])).alias("value")))
        for n, c in conditions.items()]))
    return F.map_from_entries(entries)


def qol_score(breakdown: Column) -> Column:
    points = F.aggregate(F.map_values(breakdown), F.lit(0), lambda acc, v: acc + v)
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def score_band(score: Column) -> Column:
    return (F.when(score >= 78, "T1").when(score >= 65, "T2").when(score >= 50, "T3")
            .otherwise("below"))


def score_colour(score: Column) -> Column:
    """Display variant with an extra top band."""
    return (F.when(score >= 90, "s-purple").when(score >= 78, "s-green")
            .when(score >= 65, "s-yellow").when(score >= 50, "s-orange").otherwise("s-gray"))


def text_phrases(cfg: ScoringConfig) -> list[str]:
    """Everything industries and role types look for in the text."""
    lists = [r.get("keywords") or [] for r in cfg.industries.values()]
    lists += [r.get("description_keywords") or [] for r in cfg.role_types.values()]
    return [p for phrases in lists for p in phrases]


def classify(df: DataFrame, cfg: ScoringConfig, found_in: str | None = None) -> DataFrame:
    """Add industries, role_types and company_group.

    ``found_in``: column with the phrases of the full text, ``text_phrases`` among those looked
    for. It keeps the separators of missing parts, which this text leaves out, so rows that lack a
    part are read here.
    """
    key = company_key(F.col("company_normalized"), F.col("company"))
    parts = [F.col("title"), F.col("company"), F.col("description")]
    text = find_phrases(build_text(*parts), text_phrases(cfg))
    if found_in is not None:
        whole = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit("")) != "" for c in parts])
        text = F.when(whole, F.col(found_in)).otherwise(text)
    texts = df.withColumns({
        "_title": F.lower(text_or_empty(F.col("title"))),
        "_text": text,
        "_key": key,
    })
    found = Found(F.col("_text"))
    return texts.withColumns({
        "industries": industries(found, F.col("_key"), cfg),
        "role_types": role_types(F.col("_title"), found, cfg),
        "company_group": company_group(F.col("_key"), F.col("company_tier"), cfg),
    }).drop("_title", "_text", "_key")


def with_classifiers(df: DataFrame, cfg: ScoringConfig, as_of: Column,
                     found_in: str | None = None) -> DataFrame:
    """Tags, quality of life and engagement. Quality of life reads the *stored* work mode,
    so it follows a new verdict one run later."""
    rules = [p for phrases in V.ENGAGEMENT_RULES.values() for p in phrases]
    perks = [p for phrases in cfg.qol_keywords.values() for p in phrases]
    read = classify(df, cfg, found_in).withColumns({
        "_in_title": find_phrases(padded(F.col("title")), rules),
        "_in_text": find_phrases(padded(F.col("description")), rules + perks),
    })
    title, text = Found(F.col("_in_title")), Found(F.col("_in_text"))
    blank = F.btrim(text_or_empty(F.col("title")), F.lit(" \t\n\r\x0b\x0c")) == ""
    tagged = read.withColumns({
        "engagement_type": engagement_of(title, text, blank),
        "qol_breakdown": qol_breakdown(F.col("work_mode"), F.col("salary_min"),
                                       F.col("salary_max"), F.col("posted_at"), text, as_of,
                                       cfg),
    })
    return tagged.withColumn("qol_score", qol_score(F.col("qol_breakdown"))) \
        .drop("_in_title", "_in_text")


def _label(name: str) -> str:
    return name.replace("_", " ").title()


def facet_labels(spark: SparkSession, cfg: ScoringConfig, companies: DataFrame) -> DataFrame:
    """facet, value, label, ord. Tier groups appear only when a company has that tier."""
    rows: list[tuple[str, str, str, int]] = []

    def add(facet: str, items: list[tuple[str, str]], start: int = 0) -> None:
        rows.extend((facet, v, label, start + i) for i, (v, label) in enumerate(items))

    add("industries", [(k, r.get("label", _label(k))) for k, r in cfg.industries.items()])
    add("role_types", [(k, r.get("label", _label(k))) for k, r in cfg.role_types.items()])
    add("company_groups", [(k, _label(k)) for k in cfg.company_groups], start=3)
    add("work_modes", [(m, m.title()) for m in ("remote", "hybrid", "onsite", "unclear")])
    add("engagement_types", list(V.ENGAGEMENT_LABELS.items()))
    add("sort_options", [
        ("score", "Best match"), ("qol", "Quality of life"), ("comp", "Compensation"),
        ("newest", "Newest"), ("oldest", "Oldest"), ("company_asc", "Company (A–Z)"),
        ("company_desc", "Company (Z–A)")])
    add("statuses", [(s, s.title()) for s in ("active", "saved", "applied", "archived")])
    fixed = spark.createDataFrame(rows, "facet string, value string, label string, ord int")
    t = F.upper(F.trim("tier"))
    tiers = (companies.select(t.alias("t")).where(F.col("t").isin("S", "1", "2")).distinct()
             .select(F.lit("company_groups").alias("facet"),
                     F.concat(F.lit("tier_"), F.lower("t")).alias("value"),
                     F.concat(F.lit("Tier "), F.col("t")).alias("label"),
                     F.when(F.col("t") == "S", 0).when(F.col("t") == "1", 1).otherwise(2)
                     .alias("ord")))
    return fixed.unionByName(tiers)
