"""DuckDB SQL fragments for phrase tests, written independently of the Spark side."""

from __future__ import annotations

from rolesift.config import vocabulary as V
from rolesift.config.model import ScoringConfig
from catalog.bindings import CTE, array, q

CFG = ScoringConfig()


def any_sql(expr: str, phrases: list[str]) -> str:
    if not phrases:
        return "FALSE"
    return f"(len(list_filter({array(phrases)}, lambda p: contains({expr}, p))) > 0)"


def count_sql(expr: str, phrases: list[str]) -> str:
    distinct = list(dict.fromkeys(phrases))
    return f"len(list_filter({array(distinct)}, lambda p: contains({expr}, p)))"


def first_phrase_sql(expr: str, phrases: list[str]) -> str:
    return f"(list_filter({array(phrases)}, lambda p: contains({expr}, p))[1])"


def which_sql(flags: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN {q(name)} END" for name, cond in flags.items())
    return f"array_to_string(list_filter([{cases}], lambda v: v IS NOT NULL), '|')"


def first_sql(conds: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {cond} THEN {q(name)}" for name, cond in conds.items())
    return f"CASE {whens} ELSE {default} END"


def steps_sql(expr: str, steps, default: float) -> str:
    whens = " ".join(f"WHEN {any_sql(expr, ps)} THEN {float(v)}" for ps, v in steps)
    return f"CASE {whens} ELSE {float(default)} END"


def re_sql(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {q(p)}, 'i')" for p in patterns) + ")"


def isin_sql(expr: str, values: list[str]) -> str:
    return f"coalesce({expr} IN ({', '.join(q(v) for v in values)}), FALSE)" if values \
        else "FALSE"


def diluted_sql(title: str, phrase: str) -> str:
    return (f"(strpos({title}, {phrase}) > 1 AND len(list_filter({array(V.DILUTING_PREFIXES)}, "
            f"lambda d: contains(left({title}, strpos({title}, {phrase}) - 1), d))) > 0)")


def longest_sql(expr: str, phrases: list[str]) -> str:
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    body = "|".join(p.replace("+", r"\+").replace(".", r"\.") for p in ordered)
    return f"regexp_extract({expr}, {q(chr(92) + 'b(?:' + body + ')' + chr(92) + 'b')}, 0)"


TRAVEL = f"TRY_CAST(regexp_extract(text_lo, {q(V.TRAVEL_PATTERN)}, 2) AS INTEGER)"


def _exceptions(kind: str) -> str:
    test = diluted_sql("title_lo", "e")
    test = test if kind == "diluted" else f"NOT {test}"
    return (f"list_filter({array(V.LEADERSHIP_EXCEPTIONS)}, lambda e: contains(title_lo, e) "
            f"AND {test})")


ACRONYM = re_sql("title_lo", [r"\b(?:cto|coo|cpo)\b"])
STRONG_TITLES = [p for p in V.POSITIVE_SIGNALS["senior_titles"]
                 if p not in V.WEAK_SENIOR_TITLES]

CTE["pf_text"] = """pf_text AS (
  SELECT p.*, lower(coalesce(title, '')) AS title_lo,
    lower(coalesce(title, '') || ' ' || coalesce(company, '') || ' ' ||
          coalesce(description, '')) AS text_lo,
    coalesce(location, '') || ' ' || coalesce(title, '') || ' ' || coalesce(description, '')
      AS place, c.industry AS map_industry, coalesce(c.equality, FALSE) AS equality,
    coalesce(c.crunch, FALSE) AS crunch, coalesce(c.crunch_reduced, FALSE) AS crunch_reduced
  FROM postings p LEFT JOIN companies c ON p.company_normalized = c.company_name_normalized)"""

CTE["pf_parts"] = f"""pf_parts AS (
  SELECT *,
    CASE WHEN {any_sql('title_lo', V.PRIORITY_TITLES)}
           THEN 'priority_disqualifier:' || {first_phrase_sql('title_lo', V.PRIORITY_TITLES)}
         WHEN function_hit = '' OR leadership OR len({_exceptions('plain')}) > 0 OR {ACRONYM}
           THEN NULL
         WHEN len({_exceptions('diluted')}) > 0
           THEN 'diluted_exception:' || ({_exceptions('diluted')}[1])
         ELSE 'wrong_function:' || function_hit END AS r_function,
    'sub_vp_seniority:' || trim({first_phrase_sql('title_lo', V.SENIORITY_TITLES)})
      AS r_seniority,
    'unpaid_engagement:' || {first_phrase_sql('text_lo', V.UNPAID_PHRASES)} AS r_unpaid
  FROM (SELECT *, {longest_sql('title_lo', CFG.function_titles)} AS function_hit,
          {re_sql('title_lo', V.LEADERSHIP_PATTERNS)} AS leadership,
          coalesce(map_industry, {first_sql({b: any_sql('text_lo', ps)
                                             for b, ps in V.INDUSTRY_KEYWORDS.items()},
                                            "'unknown'")}) AS industry,
          {first_sql({f: re_sql('place', ps) for f, ps in V.LOCATION_PATTERNS.items()},
                     "'unknown'")} AS location_flag,
          {which_sql({n: any_sql('text_lo', ps) for n, ps in V.POSITIVE_SIGNALS.items()})}
            AS positive_signals
        FROM pf_text))"""

SCORE_CASE = "CASE industry " + " ".join(
    f"WHEN {q(n)} THEN {s}" for n, s in V.INDUSTRY_SCORES.items()) + " ELSE {} END"

SOFT = which_sql({
    "temp_contract": any_sql("title_lo", V.WARN_TEMP_CONTRACT),
    "d2c_in_title": any_sql("title_lo", V.WARN_D2C_TITLE),
    "tpm_title": any_sql("title_lo", V.WARN_TPM),
    "below_vp": f"NOT {any_sql('title_lo', STRONG_TITLES)} AND "
                f"{any_sql('title_lo', V.WARN_BELOW_VP)}",
    "crunch_language": any_sql("text_lo", V.WARN_CRUNCH),
    "culture_red_flags": any_sql("text_lo", V.WARN_CULTURE),
    "high_travel": f"{TRAVEL} >= 50",
    "rto_mandate": f"location_flag = 'heavy_office' OR {any_sql('text_lo', V.WARN_RTO)}",
    "hands_on_coding": any_sql("text_lo", V.WARN_HANDS_ON),
})

CTE["pf"] = f"""pf AS (
  SELECT *, industry_score >= 9 AND map_industry IS NOT NULL AS is_dream_company,
    CASE WHEN contains('|' || positive_signals || '|', '|interim|') THEN 'TRACK_2_INTERIM'
         WHEN {isin_sql('industry', V.PIVOT_INDUSTRIES)} THEN 'TRACK_3_PIVOT'
         ELSE 'TRACK_1_FULLTIME' END AS track,
    r_function IS NULL AND r_seniority IS NULL AND r_unpaid IS NULL AS passed_prefilter,
    coalesce(r_function, r_seniority, r_unpaid, 'passed') AS prefilter_reason,
    array_to_string(list_filter([r_function, r_seniority, r_unpaid], lambda v: v IS NOT NULL),
                    '|') AS hard_disqualifiers
  FROM (SELECT *, {SCORE_CASE.format(0)} AS industry_score, {SOFT} AS soft_warnings,
          leadership AS is_leadership_title, equality AS is_hrc100,
          crunch AND NOT crunch_reduced AS is_crunch_co FROM pf_parts))"""
PF = ("postings", "companies", "pf_text", "pf_parts", "pf")

# ---------------------------------------------------------------------------
# Weighted generation
# ---------------------------------------------------------------------------

KW = CFG.keywords
_P = V.LOCATION_PATTERNS
_between = "left(substr(bare, 11), strpos(substr(bare, 11), 'director') - 1)"

CTE["ws_text"] = """ws_text AS (
  SELECT p.*, lower(coalesce(title, '')) AS title_lo, trim(lower(coalesce(title, ''))) AS bare,
    lower(coalesce(description, '')) AS desc_lo,
    lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS role_text,
    lower(array_to_string(list_filter([title, company, description, location],
      lambda v: v IS NOT NULL AND v <> ''), ' ')) AS text_lo,
    coalesce(title, '') || ' ' || coalesce(description, '') || ' ' ||
      lower(coalesce(location, '')) AS place,
    c.industry AS map_industry, coalesce(c.equality, FALSE) AS equality,
    coalesce(c.crunch, FALSE) AS crunch, coalesce(c.crunch_reduced, FALSE) AS crunch_reduced
  FROM postings p LEFT JOIN companies c ON p.company_normalized = c.company_name_normalized)"""

CTE["ws_gates"] = f"""ws_gates AS (
  SELECT *,
    CASE WHEN {re_sql('place', V.RELOCATION_PATTERNS)} THEN 'relocation_required'
      WHEN {any_sql('title_lo', V.INTERNATIONAL_TITLES)} AND NOT far THEN 'international_title'
      WHEN far THEN 'remote_us' WHEN {re_sql('place', _P['nj_office'])} THEN 'nj_office'
      WHEN {re_sql('place', _P['nyc_metro'])} AND {re_sql('place', _P['heavy_office'])}
        THEN 'nyc_heavy_office'
      WHEN {re_sql('place', _P['nyc_metro'])} THEN 'nyc_hybrid'
      WHEN {re_sql('place', _P['out_of_area'])} THEN 'out_of_area_required'
      WHEN {any_sql("lower(coalesce(location, ''))", V.US_LOCATION_TERMS)}
        THEN 'us_unspecified' ELSE 'ambiguous' END AS geo_label,
    CASE WHEN {any_sql('bare', V.SENIORITY_TITLES)} THEN TRUE
      WHEN NOT (starts_with(bare, 'associate ') OR starts_with(bare, 'associate,')) THEN FALSE
      WHEN contains(bare, 'associate director') AND strpos(substr(bare, 11), 'director') > 0
        AND NOT {any_sql(_between, V.ASSOCIATE_CRAFT)} THEN FALSE
      ELSE NOT {any_sql('bare', V.ASSOCIATE_PASSTHROUGH)} END AS g_seniority,
    CASE WHEN {any_sql('title_lo', V.PRIORITY_TITLES)} THEN TRUE
      WHEN len({_exceptions('plain')}) > 0 OR {ACRONYM} THEN FALSE
      WHEN {any_sql('title_lo', CFG.function_titles)} THEN TRUE
      ELSE len({_exceptions('diluted')}) > 0 END AS g_function,
    coalesce(coalesce(salary_max, salary_min) < {V.SALARY_FLOOR}, FALSE) AS g_compensation,
    {any_sql('text_lo', V.UNPAID_PHRASES)} AS g_engagement
  FROM (SELECT *, coalesce(remote, FALSE) OR {re_sql('place', _P['remote_us'])} AS far,
          coalesce(map_industry, {first_sql({b: any_sql('text_lo', ps)
                                             for b, ps in V.INDUSTRY_KEYWORDS.items()},
                                            "'general_enterprise_tech'")}) AS industry
        FROM ws_text))"""

_LEVEL = (f"CASE WHEN {any_sql('title_lo', V.IC_PRINCIPAL)} THEN 1.0 ELSE "
          f"{steps_sql('title_lo', V.LEADERSHIP_LEVELS, 1.0)} END")


def _cap(expr: str, step: float) -> str:
    return f"least(10.0::DOUBLE, {expr} * {step}::DOUBLE)"


def _avoid(expr: str) -> str:
    return f"greatest(0.0::DOUBLE, 10.0 - {expr} * 3.0::DOUBLE)"


def _two(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 2.0::DOUBLE ELSE 0.0 END"


_C = V.COMPENSATION
_near = isin_sql("industry", V.GAMING_ADJACENT)
CATEGORY_SQL = {
    "role_fit": "(" + " + ".join([
        _cap(count_sql("role_text", KW["strategy"]), 2.0),
        _cap(count_sql("role_text", KW["program_architecture"]), 2.0),
        _cap(count_sql("role_text", KW["ma_integration"]), 3.0), "level",
        _avoid(count_sql("role_text", KW["d2c_payments"])),
        _avoid(count_sql("role_text", KW["hands_on_coding"]))]) + ") / 6.0::DOUBLE",
    "industry_alignment": f"({SCORE_CASE.format(3)})::DOUBLE",
    "compensation": f"""least(10.0::DOUBLE, (CASE
        WHEN coalesce(salary_max, salary_min) IS NULL THEN {_C['neutral']}::DOUBLE
        WHEN coalesce(salary_max, salary_min) < {_C['low']} THEN 2.0
        WHEN coalesce(salary_max, salary_min) < {_C['mid_upper']} THEN
          (coalesce(salary_max, salary_min)::DOUBLE - {float(_C['mid_lower'])}::DOUBLE)
            / {float(_C['mid_upper'] - _C['mid_lower'])}::DOUBLE * 3.0::DOUBLE + 5.0::DOUBLE
        WHEN coalesce(salary_max, salary_min) <= {_C['high_max']} THEN 10.0
        WHEN coalesce(salary_max, salary_min) <= {_C['overpay_max']} THEN 9.0 ELSE 7.0 END
        + CASE WHEN benefit_hits >= 4 THEN 10.0::DOUBLE WHEN benefit_hits >= 2 THEN 6.0
          WHEN benefit_hits = 1 THEN 3.0 ELSE {_C['neutral']} END) / 2.0::DOUBLE
        + ({steps_sql('desc_lo', V.EQUITY_STEPS, 0.0)})::DOUBLE)""",
    "geographic": "CASE geo_label " + " ".join(
        f"WHEN '{lab}' THEN {float(V.LOCATION_SCORES[sc])}::DOUBLE" for lab, sc in {
            "relocation_required": "international", "international_title": "international",
            "remote_us": "remote_us", "nj_office": "nj_office",
            "nyc_heavy_office": "nyc_heavy", "nyc_hybrid": "nyc_hybrid_3d",
            "out_of_area_required": "international"}.items())
    + f" ELSE {float(V.LOCATION_SCORES['ambiguous'])} END",
    "passion_identity": "least(10.0::DOUBLE, " + " + ".join([
        _two(any_sql("text_lo", KW["helping_people"])),
        _two(f"{_near} OR {any_sql('text_lo', KW['gaming_culture'])}"),
        _two(any_sql("text_lo", KW["music_connection"])),
        _two(any_sql("text_lo", KW["immersive_experiential"])),
        _two(f"{isin_sql('industry', V.GAMING_ADJACENT + V.STRATEGY_PASSION_EXTRA)} AND "
             f"{any_sql('text_lo', KW['strategy'])}"),
        _two(any_sql("text_lo", KW["ccg_boardgame"])),
        _two(f"{_near} AND {any_sql('text_lo', V.ACCESSIBLE_GAMING)}")]) + ")",
    "work_life_quality": f"""greatest(0.0::DOUBLE, least(10.0::DOUBLE, 7.0::DOUBLE
        - CASE WHEN crunch_reduced THEN 1.0 WHEN crunch THEN 2.5 ELSE 0.0 END
        - {count_sql('text_lo', KW['crunch_pace'])} * 0.5
        - {count_sql('text_lo', KW['culture_red_flags'])} * 1.0
        + {count_sql('text_lo', KW['family_friendly'])} * 0.5
        - CASE WHEN {TRAVEL} >= 50 THEN 2.0 WHEN {TRAVEL} >= 25 THEN 0.5 ELSE 0.0 END
        - CASE WHEN {any_sql('text_lo', V.ON_CALL)} THEN 1.5 ELSE 0.0 END))""",
    "company_health": "greatest(0.0::DOUBLE, least(10.0::DOUBLE, 7.0" + "".join(
        f" + CASE WHEN {any_sql('desc_lo', ps)} THEN {v}::DOUBLE ELSE 0.0 END"
        for ps, v in V.HEALTH_STEPS) + "))",
    "career_trajectory": f"""(level
        + CASE WHEN {any_sql('desc_lo', V.REPORTS_TO_C)} THEN 10.0::DOUBLE
          WHEN {any_sql('desc_lo', V.REPORTS_TO_DIRECTOR)} THEN 4.0 ELSE 6.0 END
        + CASE WHEN {any_sql('desc_lo', V.SCOPE_NARROW)} THEN 5.0::DOUBLE
          WHEN {any_sql('desc_lo', V.SCOPE_WIDE)} THEN 8.0 ELSE 6.0 END
        + CASE WHEN {isin_sql('company_normalized', V.BRAND_COMPANIES)} THEN 8.0::DOUBLE
          ELSE 6.0 END) / 4.0::DOUBLE""",
    "cultural_alignment": f"""CASE WHEN {any_sql('text_lo', V.CULTURE_ROLLBACK)}
        THEN 0.0::DOUBLE WHEN equality THEN 10.0
        WHEN {count_sql('text_lo', KW['lgbtq_signals'])} >= 3 THEN 6.0
        WHEN {count_sql('text_lo', KW['lgbtq_signals'])} >= 1 THEN 4.0 ELSE 3.0 END""",
    "engagement_type": f"({steps_sql('text_lo', V.ENGAGEMENT_STEPS, 9.0)})::DOUBLE",
}

CTE["ws_cat"] = f"""ws_cat AS (
  SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in CATEGORY_SQL.items())}
  FROM (SELECT *, ({_LEVEL})::DOUBLE AS level,
          {count_sql('desc_lo', KW['family_friendly'] + V.BENEFIT_TERMS)} AS benefit_hits
        FROM ws_gates))"""

_stated = "coalesce(remote, FALSE)"
MOD_SQL = {
    "company_tier_s": "coalesce(company_tier = 'S', FALSE)",
    "company_tier_1": "coalesce(company_tier = '1', FALSE)",
    "company_tier_2": "coalesce(company_tier = '2', FALSE)",
    "immersive_themed": f"industry = 'immersive_lbe' AND {any_sql('text_lo', V.MOD_IMMERSIVE)}",
    "tcg_ccg": any_sql("text_lo", V.MOD_TCG),
    "ma_gaming_media": f"{isin_sql('industry', V.MOD_MA_INDUSTRIES)} AND "
                       f"{any_sql('text_lo', KW['ma_integration'])}",
    "vp_analyst": any_sql("title_lo", V.MOD_VP_ANALYST),
    "remote_vp_gaming": f"{isin_sql('industry', V.MOD_REMOTE_VP_INDUSTRIES)} AND "
                        f"{any_sql('title_lo', V.MOD_EXEC_WORDS)} AND ({_stated} OR "
                        f"{re_sql('text_lo', _P['remote_us'])})",
    "nj_office_bonus": f"NOT {_stated} AND ({any_sql('text_lo', KW['nj_office'])} OR "
                       f"{re_sql('text_lo', _P['nj_office'])})",
    "mental_health_accessibility": any_sql("text_lo", V.MOD_MISSION),
    "hrc_trans_inclusive": f"equality AND {any_sql('text_lo', V.MOD_INCLUSIVE_HEALTH)}",
    "multiplayer_live_service": f"{isin_sql('industry', V.MOD_LIVE_INDUSTRIES)} AND " + count_sql(
        "text_lo", V.POSITIVE_SIGNALS["multiplayer_live_service"]) + " >= 2",
    "interim_advisor_fit": f"{any_sql('title_lo', V.MOD_ENGAGEMENT_MARKERS)} AND "
                           f"{any_sql('title_lo', V.MOD_SCOPE_MARKERS)}",
    "below_vp_title": f"NOT {any_sql('bare', V.MOD_EXEC_TITLES)} AND "
                      f"({any_sql('bare', V.MOD_BELOW_VP)} OR " + " OR ".join(
                          f"starts_with(bare, {q(h)})" for h in V.MOD_BELOW_VP_STARTS) + ")",
    "d2c_in_title": any_sql("title_lo", V.MOD_D2C_TITLE),
    "temp_contract_title": f"{any_sql('title_lo', V.MOD_TEMP_TITLE)} AND NOT "
                           f"{any_sql('title_lo', V.MOD_TEMP_EXEMPT)}",
    "d2c_heavy": f"{count_sql('text_lo', KW['d2c_payments'])} >= 3",
    "coding_heavy": f"{count_sql('text_lo', KW['hands_on_coding'])} >= 3",
    "crunch_culture": f"{count_sql('text_lo', KW['crunch_pace'])} >= 3",
    "high_travel": f"coalesce({TRAVEL} >= 50, FALSE)",
    "rto_mandate": re_sql("text_lo", _P["heavy_office"]),
}
GATE_LIST = which_sql({
    "seniority": "g_seniority", "function": "g_function", "compensation": "g_compensation",
    "engagement": "g_engagement",
    "geographic": "geo_label IN ('relocation_required', 'international_title', "
                  "'out_of_area_required')"})
_WEIGHTED = " + ".join(f"{n} * {float(V.CATEGORY_WEIGHTS[n])}::DOUBLE" for n in CATEGORY_SQL)
_DELTA = " + ".join(f"CASE WHEN {c} THEN {V.MODIFIER_DELTAS[n]} ELSE 0 END"
                    for n, c in MOD_SQL.items())
TIER_SQL = "CASE WHEN score >= 78 THEN 'T1' WHEN score >= 65 THEN 'T2' WHEN score >= 50 " \
           "THEN 'T3' WHEN score >= 35 THEN 'watchlist' ELSE 'skip' END"

CTE["ws"] = f"""ws AS (
  SELECT *, {TIER_SQL} AS tier,
    CASE WHEN {any_sql('text_lo', KW['interim_fractional'])} THEN 'TRACK_2_INTERIM'
      WHEN {isin_sql('industry', V.PIVOT_INDUSTRIES)} THEN 'TRACK_3_PIVOT'
      ELSE 'TRACK_1_FULLTIME' END AS track
  FROM (SELECT *, CASE WHEN gates_triggered <> '' THEN 0 ELSE CAST(greatest(0, least(100,
          round_even(({_WEIGHTED}) * CASE geo_label WHEN 'ambiguous' THEN 0.5 ELSE 1.0 END
            * 10.0::DOUBLE + delta, 0))) AS INTEGER) END AS score
        FROM (SELECT *, {GATE_LIST} AS gates_triggered, {_DELTA} AS delta,
                {which_sql(MOD_SQL)} AS modifiers FROM ws_cat)))"""
WG = ("postings", "companies", "ws_text", "ws_gates")
WC = WG + ("ws_cat",)
WS = WC + ("ws",)

# ---------------------------------------------------------------------------
# Scored postings: prefilter, classifiers and fresh verdicts together
# ---------------------------------------------------------------------------

SCORED_CFG = CFG.with_(cache_days=1000)
_X = "lower(array_to_string(list_filter([title, company, description], " \
     "lambda v: v IS NOT NULL AND v <> ''), ' '))"
IND_SQL = which_sql({n: isin_sql("company_normalized", r["companies"]) + " OR "
                     + any_sql("x", r["keywords"]) for n, r in V.TAXONOMY_INDUSTRIES.items()})
ROLE_SQL = which_sql({n: f"CASE WHEN {any_sql('t', r['title_keywords'])} THEN NOT "
                         f"{any_sql('t', r['title_excludes'])} ELSE "
                         f"{any_sql('x', r['description_keywords'])} END"
                      for n, r in V.TAXONOMY_ROLE_TYPES.items()})
GROUP_SQL = ("CASE company_tier WHEN 'S' THEN 'tier_s' WHEN '1' THEN 'tier_1' WHEN '2' THEN "
             "'tier_2' ELSE " + first_sql({n: isin_sql("company_normalized", c)
                                           for n, c in V.TAXONOMY_GROUPS.items()}, "NULL")
             + " END")
QOL_FLAGS = {
    "work_mode_remote": "work_mode = 'remote'", "work_mode_hybrid": "work_mode = 'hybrid'",
    "salary_listed": "coalesce(salary_min, 0) > 0 OR coalesce(salary_max, 0) > 0",
    "salary_above_floor": "coalesce(CASE WHEN salary_min > 0 THEN salary_min ELSE salary_max "
                          f"END, 0) >= {V.QOL_SALARY_FLOOR}",
    "posted_recent": f"posted_at > as_of - INTERVAL {V.QOL_RECENT_DAYS} DAY",
    "equity_keywords": any_sql("lower(description)", V.QOL_EQUITY),
    "benefits_keywords": any_sql("lower(description)", V.QOL_BENEFITS),
    "flexibility_keywords": any_sql("lower(description)", V.QOL_FLEXIBILITY),
}
QOL_SQL = "CAST(least(100, " + " + ".join(
    f"CASE WHEN {c} THEN {V.QOL_WEIGHTS[n]} ELSE 0 END" for n, c in QOL_FLAGS.items()) \
    + ") AS BIGINT)"
ENGAGEMENT_SQL = "CASE " + " ".join(
    f"WHEN {any_sql(e, ps)} THEN {q(n)}"
    for e in ("' ' || lower(title) || ' '", "' ' || lower(description) || ' '")
    for n, ps in V.ENGAGEMENT_RULES.items()) \
    + " WHEN trim(title) = '' THEN 'unclear' ELSE 'fulltime' END"

CTE["scored"] = f"""scored AS (
  SELECT *, CASE WHEN NOT passed_prefilter THEN 'DISQUALIFIED'
      WHEN verdict_state <> 'scored' THEN 'needs_review'
      WHEN score < 35 AND watchlist_dream AND is_dream_company AND is_leadership_title
        AND geography_match = 'unreachable' THEN 'watchlist_dream'
      ELSE {TIER_SQL} END AS tier
  FROM (SELECT f.* EXCLUDE (work_mode),
      coalesce(CASE WHEN passed_prefilter THEN v.verdict_work_mode END, f.work_mode)
        AS work_mode,
      {IND_SQL} AS industries, {ROLE_SQL} AS role_types, {GROUP_SQL} AS company_group,
      {QOL_SQL.replace('work_mode =', 'f.work_mode =')} AS qol_score,
      {ENGAGEMENT_SQL} AS engagement_type,
      CASE WHEN NOT passed_prefilter THEN 'skipped' WHEN v.job_id IS NULL THEN 'missing'
        ELSE 'scored' END AS verdict_state,
      CASE WHEN passed_prefilter THEN v.semantic_score END AS semantic_score,
      CASE WHEN passed_prefilter THEN v.semantic_rationale END AS semantic_rationale,
      CASE WHEN passed_prefilter THEN v.semantic_scored_at END AS semantic_scored_at,
      CASE WHEN passed_prefilter THEN coalesce(v.semantic_score, 0) ELSE 0 END AS score,
      CASE WHEN passed_prefilter THEN 100 ELSE 0 END AS algo_score,
      passed_prefilter AND coalesce(v.watchlist_dream, FALSE) AS watchlist_dream,
      CASE WHEN passed_prefilter THEN coalesce(v.geography_match, 'unclear')
        ELSE 'unclear' END AS geography_match,
      CASE WHEN passed_prefilter THEN coalesce(v.role_family_match, 'unclear')
        ELSE 'unclear' END AS role_family_match
    FROM (SELECT *, lower(title) AS t, {_X} AS x FROM pf, params) f
    LEFT JOIN (SELECT verdicts.* FROM verdicts, params
               WHERE semantic_scored_at > as_of - INTERVAL 1000 DAY) v
      ON f.job_id = v.job_id))"""
SCORED = ("params",) + PF + ("verdicts", "scored")
