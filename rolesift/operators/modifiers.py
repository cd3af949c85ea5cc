"""Score modifiers: each fires at most once, deltas add up, names keep a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.config import vocabulary as V
from rolesift.config.model import ScoringConfig
from rolesift.functions.text import Found, any_of, any_pattern, count_of, percent_after, strip


def conditions(cfg: ScoringConfig) -> dict[str, Column]:
    """Condition per modifier over the columns title_lo, text_lo and text_found (with
    location), industry, company_tier, remote and is_equality_co."""
    title, raw_text, bucket = F.col("title_lo"), F.col("text_lo"), F.col("industry")
    text = Found(F.col("text_found"))
    tier = F.upper(strip(F.col("company_tier")))
    kw, loc = cfg.keywords, cfg.location_patterns
    bare = strip(title)
    starts = F.lit(False)
    for head in V.MOD_BELOW_VP_STARTS:
        starts = starts | F.startswith(bare, F.lit(head))
    stated_remote = F.coalesce(F.col("remote"), F.lit(False))
    raw = {
        "company_tier_s": tier == "S",
        "company_tier_1": tier == "1",
        "company_tier_2": tier == "2",
        "immersive_themed": bucket.isin(V.MOD_IMMERSIVE_INDUSTRIES)
        & any_of(text, V.MOD_IMMERSIVE),
        "tcg_ccg": any_of(text, V.MOD_TCG),
        "ma_gaming_media": bucket.isin(V.MOD_MA_INDUSTRIES)
        & any_of(text, kw["ma_integration"]),
        "vp_analyst": any_of(title, V.MOD_VP_ANALYST),
        "remote_vp_gaming": bucket.isin(V.MOD_REMOTE_VP_INDUSTRIES)
        & any_of(title, V.MOD_EXEC_WORDS)
        & (stated_remote | any_pattern(raw_text, loc["remote_us"])),
        "nj_office_bonus": ~stated_remote
        & (any_of(text, kw["nj_office"]) | any_pattern(raw_text, loc["nj_office"])),
        "mental_health_accessibility": any_of(text, V.MOD_MISSION),
        "hrc_trans_inclusive": F.col("is_equality_co") & any_of(text, V.MOD_INCLUSIVE_HEALTH),
        "multiplayer_live_service": bucket.isin(V.MOD_LIVE_INDUSTRIES)
        & (count_of(text, V.POSITIVE_SIGNALS["multiplayer_live_service"]) >= 2),
        "interim_advisor_fit": any_of(title, V.MOD_ENGAGEMENT_MARKERS)
        & any_of(title, V.MOD_SCOPE_MARKERS),
        "below_vp_title": ~any_of(bare, V.MOD_EXEC_TITLES)
        & (any_of(bare, V.MOD_BELOW_VP) | starts),
        "d2c_in_title": any_of(title, V.MOD_D2C_TITLE),
        "temp_contract_title": any_of(title, V.MOD_TEMP_TITLE)
        & ~any_of(title, V.MOD_TEMP_EXEMPT),
        "d2c_heavy": count_of(text, kw["d2c_payments"]) >= 3,
        "coding_heavy": count_of(text, kw["hands_on_coding"]) >= 3,
        "crunch_culture": count_of(text, kw["crunch_pace"]) >= 3,
        "high_travel": percent_after(raw_text, V.TRAVEL_PATTERN, 2) >= 50,
        "rto_mandate": any_pattern(raw_text, loc["heavy_office"]),
    }
    return {name: F.coalesce(c, F.lit(False)) for name, c in raw.items()}


def fired(cfg: ScoringConfig) -> Column:
    """Array of struct(name, delta) for the modifiers that fire."""
    return F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(n).alias("name"), F.lit(cfg.modifier_deltas[n]).alias("delta")))
        for n, c in conditions(cfg).items()]))


def total(fired_col: Column) -> Column:
    return F.aggregate(fired_col, F.lit(0), lambda acc, m: acc + m["delta"])
