"""Prefilter, gates, category scores, modifiers and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.config import vocabulary as V
from rolesift.functions.text import Found
from rolesift.operators import classify as C
from rolesift.operators import gates, modifiers, prefilter, weighted
from rolesift.operators.companies import with_company_facts
from catalog import bindings as B
from catalog.registry import add, joined
from catalog.sqlgen import (CATEGORY_SQL, CFG, GATE_LIST, MOD_SQL, PF, TIER_SQL, WC, WG, WS,
                            any_sql, first_sql, isin_sql, q, which_sql)


def _texts(s: SparkSession, d: str) -> DataFrame:
    facts = with_company_facts(B.postings(s, d), CFG, B.companies(s, d))
    return prefilter.with_texts(facts, CFG)


def _prefiltered(s: SparkSession, d: str) -> DataFrame:
    return prefilter.prefilter(B.postings(s, d), CFG, B.companies(s, d))


T, X = F.col, F.col  # names keep the lambdas below short
FOUND = lambda: Found(F.col("text_found"))


def _pf(key: str, column, name: str, sql_expr: str) -> None:
    add(key, lambda s, d: _texts(s, d).select("job_id", column().alias(name)),
        f"SELECT job_id, {sql_expr} AS {name} FROM pf", *PF)


_pf("pf_wrong_function", lambda: prefilter.wrong_function(
    F.col("title_lo"), F.col("function_hit"), F.col("title_found"), CFG), "reason", "r_function")
_pf("pf_seniority", lambda: prefilter.seniority(F.col("title_lo"), CFG), "reason",
    "r_seniority")
_pf("pf_unpaid", lambda: prefilter.unpaid(FOUND(), CFG), "reason", "r_unpaid")
_pf("pf_location_flag", lambda: prefilter.location_flag(F.col("place_text"), CFG),
    "location_flag", "location_flag")
_pf("pf_positive_signals", lambda: F.array_join(
    prefilter.positive_signals(FOUND(), CFG), "|"), "positive_signals", "positive_signals")
_pf("pf_leadership_title", lambda: prefilter.is_leadership_title(F.col("title_lo"), CFG),
    "is_leadership_title", "is_leadership_title")

add("pf_industry", lambda s, d: _texts(s, d).select(
    "job_id", prefilter.industry(F.col("map_industry"), FOUND(), CFG).alias("industry"))
    .withColumn("industry_score",
                prefilter.industry_score(F.col("industry"), CFG).cast("bigint")),
    "SELECT job_id, industry, CAST(industry_score AS BIGINT) AS industry_score FROM pf", *PF)
add("pf_soft_warnings", lambda s, d: _prefiltered(s, d).select(
    "job_id", joined("soft_warnings")), "SELECT job_id, soft_warnings FROM pf", *PF)
add("pf_track", lambda s, d: _prefiltered(s, d).select("job_id", "track"),
    "SELECT job_id, track FROM pf", *PF)
add("pf_company_flags", lambda s, d: _prefiltered(s, d).select(
    "job_id", "is_dream_company", "is_hrc100", "is_crunch_co"),
    "SELECT job_id, is_dream_company, is_hrc100, is_crunch_co FROM pf", *PF)
add("prefilter", lambda s, d: _prefiltered(s, d).select(
    "job_id", "passed_prefilter", "prefilter_reason", joined("hard_disqualifiers"),
    joined("soft_warnings"), joined("positive_signals"), "industry",
    F.col("industry_score").cast("bigint").alias("industry_score"), "track", "location_flag",
    "is_dream_company", "is_hrc100", "is_crunch_co", "is_leadership_title"),
    """SELECT job_id, passed_prefilter, prefilter_reason, hard_disqualifiers, soft_warnings,
    positive_signals, industry, CAST(industry_score AS BIGINT) AS industry_score, track,
    location_flag, is_dream_company, is_hrc100, is_crunch_co, is_leadership_title FROM pf""",
    *PF)


# --- gates -----------------------------------------------------------------

def _gated(s: SparkSession, d: str) -> DataFrame:
    return weighted.with_gates(
        weighted.with_texts(B.postings(s, d), CFG, B.companies(s, d)), CFG)


for _name, _col in (("function", "g_function"), ("seniority", "g_seniority"),
                    ("engagement", "g_engagement"), ("compensation", "g_compensation")):
    add(f"gate_{_name}", lambda s, d, n=_name: _gated(s, d).select(
        "job_id", F.col(f"gate_{n}").alias("fired")),
        f"SELECT job_id, {_col} AS fired FROM ws_gates", *WG)
add("gate_geo", lambda s, d: _gated(s, d).select(
    "job_id", F.col("geo.mult").alias("mult"), F.col("geo.score").alias("geo_score"),
    F.col("geo.label").alias("label")),
    f"""SELECT job_id, CASE geo_label WHEN 'ambiguous' THEN 0.5::DOUBLE
      WHEN 'relocation_required' THEN 0.0 WHEN 'international_title' THEN 0.0
      WHEN 'out_of_area_required' THEN 0.0 ELSE 1.0 END AS mult,
      {CATEGORY_SQL['geographic']} AS geo_score, geo_label AS label FROM ws_gates""", *WG)
add("gates_all", lambda s, d: _gated(s, d).select("job_id", joined("gates_triggered")),
    f"SELECT job_id, {GATE_LIST} AS gates_triggered FROM ws_gates", *WG)


# --- category scores -------------------------------------------------------

def _found(s: SparkSession, d: str) -> DataFrame:
    return weighted.with_found(_gated(s, d), CFG, F.lit(True))


_CATEGORY_KEYS = {
    "score_role_fit": "role_fit", "score_industry": "industry_alignment",
    "score_compensation": "compensation", "score_passion": "passion_identity",
    "score_work_life": "work_life_quality", "score_company_health": "company_health",
    "score_trajectory": "career_trajectory", "score_culture": "cultural_alignment",
    "score_engagement_cat": "engagement_type",
}
for _key, _cat in _CATEGORY_KEYS.items():
    add(_key, lambda s, d, c=_cat: _found(s, d).select(
        "job_id", F.bround(weighted.category_scores(CFG)[c], 4).alias("value")),
        f"SELECT job_id, round_even({_cat}, 4) AS value FROM ws_cat", *WC)
add("leadership_level", lambda s, d: _gated(s, d).select(
    "job_id", weighted.leadership_level(F.col("title_lo")).alias("level")),
    "SELECT job_id, level FROM ws_cat", *WC)


def _weighted(s: SparkSession, d: str) -> DataFrame:
    return weighted.weighted_score(B.postings(s, d), CFG, B.companies(s, d))


add("weighted_score", lambda s, d: _weighted(s, d).select(
    "job_id", F.col("score").cast("bigint").alias("score"), "tier", "track",
    joined("gates_triggered"), joined("modifiers_applied"),
    F.bround(F.try_element_at("score_breakdown", F.lit("role_fit")), 2).alias("role_fit")),
    """SELECT job_id, CAST(score AS BIGINT) AS score, tier, track, gates_triggered,
    CASE WHEN gates_triggered = '' THEN modifiers ELSE '' END AS modifiers_applied,
    CASE WHEN gates_triggered = '' THEN round_even(role_fit, 2) END AS role_fit FROM ws""",
    *WS)
add("tier_from_score", lambda s, d: B.verdicts(s, d).select(
    "job_id", weighted.tier_from_score(F.col("semantic_score"), CFG).alias("tier")),
    f"SELECT job_id, {TIER_SQL.replace('score', 'semantic_score')} AS tier FROM verdicts",
    "verdicts")
add("detect_track_text", lambda s, d: _gated(s, d).select(
    "job_id", weighted.track_of_text(FOUND(), F.col("industry"), CFG).alias("track")),
    f"""SELECT job_id, CASE WHEN {any_sql('text_lo', CFG.keywords['interim_fractional'])}
    THEN 'TRACK_2_INTERIM' WHEN {isin_sql('industry', V.PIVOT_INDUSTRIES)}
    THEN 'TRACK_3_PIVOT' ELSE 'TRACK_1_FULLTIME' END AS track FROM ws_gates""", *WG)


# --- modifiers -------------------------------------------------------------

_MODIFIER_KEYS = {
    "mod_company_tier": ["company_tier_s", "company_tier_1", "company_tier_2"],
    "mod_immersive": ["immersive_themed"], "mod_tcg": ["tcg_ccg"],
    "mod_ma_media": ["ma_gaming_media"], "mod_vp_analyst": ["vp_analyst"],
    "mod_remote_vp": ["remote_vp_gaming"], "mod_nj_office": ["nj_office_bonus"],
    "mod_mission": ["mental_health_accessibility"],
    "mod_live_service": ["multiplayer_live_service"],
    "mod_interim_advisor": ["interim_advisor_fit"],
    "mod_inclusive_health": ["hrc_trans_inclusive"], "mod_below_vp": ["below_vp_title"],
    "mod_d2c_title": ["d2c_in_title"], "mod_temp_title": ["temp_contract_title"],
    "mod_d2c_heavy": ["d2c_heavy"], "mod_coding_heavy": ["coding_heavy"],
    "mod_crunch": ["crunch_culture"], "mod_high_travel": ["high_travel"],
    "mod_rto": ["rto_mandate"],
}


def _one_modifier(s: SparkSession, d: str, names: list[str]) -> DataFrame:
    conds = modifiers.conditions(CFG)
    applied = F.coalesce(*[F.when(conds[n], F.lit(n)) for n in names], F.lit(""))
    delta = F.coalesce(*[F.when(conds[n], F.lit(CFG.modifier_deltas[n])) for n in names],
                       F.lit(0))
    return _gated(s, d).select("job_id", applied.alias("applied"),
                               delta.cast("bigint").alias("delta"))


for _key, _names in _MODIFIER_KEYS.items():
    add(_key, lambda s, d, n=_names: _one_modifier(s, d, n),
        f"""SELECT job_id, {first_sql({n: MOD_SQL[n] for n in _names}, "''")} AS applied,
        CAST(CASE {' '.join(f'WHEN {MOD_SQL[n]} THEN {V.MODIFIER_DELTAS[n]}' for n in _names)}
        ELSE 0 END AS BIGINT) AS delta FROM ws_gates""", *WG)
add("modifiers", lambda s, d: _gated(s, d).withColumn("fired", modifiers.fired(CFG)).select(
    "job_id", modifiers.total(F.col("fired")).cast("bigint").alias("delta"),
    F.array_join(F.transform("fired", lambda m: m["name"]), "|").alias("applied")),
    f"""SELECT job_id, CAST({' + '.join(
        f'CASE WHEN {c} THEN {V.MODIFIER_DELTAS[n]} ELSE 0 END' for n, c in MOD_SQL.items())}
    AS BIGINT) AS delta, {which_sql(MOD_SQL)} AS applied FROM ws_gates""", *WG)


# --- classifiers -----------------------------------------------------------

_KEYED = """(SELECT *, lower(title) AS t, lower(array_to_string(list_filter(
  [title, company, description], lambda v: v IS NOT NULL AND v <> ''), ' ')) AS x,
  company_normalized AS ckey FROM postings)"""
_IND = which_sql({n: isin_sql("ckey", r["companies"]) + " OR " + any_sql("x", r["keywords"])
                  for n, r in V.TAXONOMY_INDUSTRIES.items()})
_ROLE = which_sql({n: f"CASE WHEN {any_sql('t', r['title_keywords'])} THEN NOT "
                      f"{any_sql('t', r['title_excludes'])} ELSE "
                      f"{any_sql('x', r['description_keywords'])} END"
                   for n, r in V.TAXONOMY_ROLE_TYPES.items()})
_GROUP = "CASE company_tier WHEN 'S' THEN 'tier_s' WHEN '1' THEN 'tier_1' WHEN '2' THEN " \
         "'tier_2' ELSE " + first_sql({n: isin_sql("ckey", c) for n, c in
                                       V.TAXONOMY_GROUPS.items()}, "NULL") + " END"


def _classified(s: SparkSession, d: str) -> DataFrame:
    return C.classify(B.postings(s, d), CFG)


add("tag_industries", lambda s, d: _classified(s, d).select("job_id", joined("industries")),
    f"SELECT job_id, {_IND} AS industries FROM {_KEYED}", "postings")
add("tag_role_types", lambda s, d: _classified(s, d).select("job_id", joined("role_types")),
    f"SELECT job_id, {_ROLE} AS role_types FROM {_KEYED}", "postings")
add("tag_company_group", lambda s, d: _classified(s, d).select("job_id", "company_group"),
    f"SELECT job_id, {_GROUP} AS company_group FROM {_KEYED}", "postings")
add("classify", lambda s, d: _classified(s, d).select(
    "job_id", joined("industries"), joined("role_types"), "company_group"),
    f"SELECT job_id, {_IND} AS industries, {_ROLE} AS role_types, {_GROUP} AS company_group "
    f"FROM {_KEYED}", "postings")

_QOL_FLAGS = {
    "work_mode_remote": "work_mode = 'remote'", "work_mode_hybrid": "work_mode = 'hybrid'",
    "salary_listed": "coalesce(salary_min, 0) > 0 OR coalesce(salary_max, 0) > 0",
    "salary_above_floor": "coalesce(CASE WHEN salary_min > 0 THEN salary_min ELSE salary_max "
                          f"END, 0) >= {V.QOL_SALARY_FLOOR}",
    "posted_recent": f"posted_at > as_of - INTERVAL {V.QOL_RECENT_DAYS} DAY",
    "equity_keywords": any_sql("lower(description)", V.QOL_EQUITY),
    "benefits_keywords": any_sql("lower(description)", V.QOL_BENEFITS),
    "flexibility_keywords": any_sql("lower(description)", V.QOL_FLEXIBILITY),
}


def _qol(s: SparkSession, d: str) -> DataFrame:
    b = C.qol_breakdown(F.col("work_mode"), F.col("salary_min"), F.col("salary_max"),
                        F.col("posted_at"), F.col("description"), B.as_of(), CFG)
    return B.postings(s, d).withColumn("b", b).select(
        "job_id", C.qol_score(F.col("b")).cast("bigint").alias("qol_score"),
        F.array_join(F.map_keys("b"), "|").alias("fired"))


add("score_qol", _qol, f"""SELECT job_id, CAST(least(100, {' + '.join(
    f'CASE WHEN {c} THEN {V.QOL_WEIGHTS[n]} ELSE 0 END' for n, c in _QOL_FLAGS.items())})
    AS BIGINT) AS qol_score, {which_sql(_QOL_FLAGS)} AS fired FROM postings, params""",
    "params", "postings")
_PAD_T, _PAD_D = "' ' || lower(title) || ' '", "' ' || lower(description) || ' '"
add("detect_engagement", lambda s, d: B.postings(s, d).select(
    "job_id", C.engagement_type(F.col("title"), F.col("description"))
    .alias("engagement_type")),
    "SELECT job_id, CASE " + " ".join(
        f"WHEN {any_sql(e, ps)} THEN {q(n)}" for e in (_PAD_T, _PAD_D)
        for n, ps in V.ENGAGEMENT_RULES.items())
    + " WHEN trim(title) = '' THEN 'unclear' ELSE 'fulltime' END AS engagement_type "
      "FROM postings", "postings")
add("score_band", lambda s, d: B.verdicts(s, d).select(
    "job_id", C.score_band(F.col("semantic_score")).alias("band"),
    C.score_colour(F.col("semantic_score")).alias("colour")),
    """SELECT job_id, CASE WHEN semantic_score >= 78 THEN 'T1' WHEN semantic_score >= 65
    THEN 'T2' WHEN semantic_score >= 50 THEN 'T3' ELSE 'below' END AS band,
    CASE WHEN semantic_score >= 90 THEN 's-purple' WHEN semantic_score >= 78 THEN 's-green'
    WHEN semantic_score >= 65 THEN 's-yellow' WHEN semantic_score >= 50 THEN 's-orange'
    ELSE 's-gray' END AS colour FROM verdicts""", "verdicts")


def _facet_sql() -> str:
    def named(key: str) -> str:
        return " ".join(w.capitalize() for w in key.split("_"))

    rows = [("industries", k, r.get("label") or named(k), i)
            for i, (k, r) in enumerate(CFG.industries.items())]
    rows += [("role_types", k, r.get("label") or named(k), i)
             for i, (k, r) in enumerate(CFG.role_types.items())]
    rows += [("company_groups", k, named(k), i + 3) for i, k in enumerate(CFG.company_groups)]
    rows += [("engagement_types", k, label, i)
             for i, (k, label) in enumerate(V.ENGAGEMENT_LABELS.items())]
    fixed = ", ".join(f"({q(f)}, {q(v)}, {q(label)}, {i})" for f, v, label, i in rows)
    return f"""SELECT * FROM (VALUES {fixed},
      ('work_modes', 'remote', 'Remote', 0), ('work_modes', 'hybrid', 'Hybrid', 1),
      ('work_modes', 'onsite', 'Onsite', 2), ('work_modes', 'unclear', 'Unclear', 3),
      ('sort_options', 'score', 'Best match', 0), ('sort_options', 'qol', 'Quality of life', 1),
      ('sort_options', 'comp', 'Compensation', 2), ('sort_options', 'newest', 'Newest', 3),
      ('sort_options', 'oldest', 'Oldest', 4), ('sort_options', 'company_asc', 'Company (A–Z)', 5),
      ('sort_options', 'company_desc', 'Company (Z–A)', 6), ('statuses', 'active', 'Active', 0),
      ('statuses', 'saved', 'Saved', 1), ('statuses', 'applied', 'Applied', 2),
      ('statuses', 'archived', 'Archived', 3)) AS f(facet, value, label, ord)
    UNION ALL SELECT DISTINCT 'company_groups', 'tier_' || lower(trim(tier)),
      'Tier ' || upper(trim(tier)), CASE upper(trim(tier)) WHEN 'S' THEN 0 WHEN '1' THEN 1
      ELSE 2 END FROM companies WHERE upper(trim(tier)) IN ('S', '1', '2')"""


add("facet_labels", lambda s, d: C.facet_labels(s, CFG, B.companies(s, d)), _facet_sql(),
    "companies")
