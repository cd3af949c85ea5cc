"""Verdicts, browse, reports, joins, windows, set operations and table changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolesift.functions.normalize import iso_z, score_posted
from rolesift.operators import browse as BR
from rolesift.operators import combine as CO
from rolesift.operators import prefilter as PFO
from rolesift.operators import reports as R
from rolesift.operators import tables as TB
from rolesift.operators import verdicts as VD
from rolesift.operators.companies import with_company_facts
from rolesift.operators.weighted import tier_from_score
from catalog import bindings as B
from catalog.registry import add, joined
from catalog.scalar_queries import iso_sql
from catalog.sqlgen import CFG, PF, SCORED, SCORED_CFG, TIER_SQL


def scored(s: SparkSession, d: str) -> DataFrame:
    """Scored postings: the table every browse and report query reads."""
    return VD.score_combined(B.postings(s, d), B.verdicts(s, d), SCORED_CFG, B.as_of(),
                             B.companies(s, d))


def _int(name: str):
    return F.col(name).cast("bigint").alias(name)


def _iso(name: str):
    return iso_z(F.col(name)).alias(name)


# --- verdicts --------------------------------------------------------------

def _prefiltered(s: SparkSession, d: str) -> DataFrame:
    return PFO.prefilter(B.postings(s, d), CFG, B.companies(s, d))


_SEP = "chr(10)"
_FLAGS = ("list_filter([CASE WHEN is_dream_company THEN 'dream-tier' END, CASE WHEN is_hrc100 "
          "THEN 'HRC 100' END, CASE WHEN is_crunch_co THEN 'crunch-company risk' END], "
          "lambda v: v IS NOT NULL)")
_REPLY = VD.REPLY_SHAPE.replace("'", "''")
_MESSAGE = f"""array_to_string(list_filter(['--- Pre-filter context ---', 'Track: ' || track,
    'Detected industry: ' || industry || ' (preference score ' ||
      CAST(industry_score AS VARCHAR) || '/10)', 'Location flag: ' || location_flag,
    CASE WHEN len({_FLAGS}) > 0 THEN 'Company flags: ' || array_to_string({_FLAGS}, ', ') END,
    CASE WHEN positive_signals <> '' THEN 'Positive signals fired: ' ||
      replace(positive_signals, '|', ', ') END,
    CASE WHEN soft_warnings <> '' THEN 'Soft warnings fired: ' ||
      replace(soft_warnings, '|', ', ') END,
    '--- End pre-filter ---'], lambda v: v IS NOT NULL), {_SEP})
  || {_SEP} || {_SEP} || 'Title: ' || trim(title) || {_SEP} || 'Company: ' || trim(company)
  || {_SEP} || 'Location: ' || trim(location) || {_SEP} || 'Remote: ' ||
  CASE WHEN remote THEN 'yes' ELSE 'no' END
  || CASE WHEN coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0 THEN
     {_SEP} || 'Salary: ' || coalesce('$' || format('{{:,}}', salary_min), '?') || ' - ' ||
     coalesce('$' || format('{{:,}}', salary_max), '?') ELSE '' END
  || {_SEP} || {_SEP} || 'Description:' || {_SEP} || trim(description) || {_SEP} || {_SEP}
  || '{_REPLY}'"""
add("verdict_requests", lambda s, d: VD.requests(
    _prefiltered(s, d), B.verdicts(s, d), B.as_of(), SCORED_CFG),
    f"""SELECT job_id, {_MESSAGE} AS message FROM pf, params WHERE passed_prefilter
    AND job_id NOT IN (SELECT job_id FROM verdicts, params
      WHERE semantic_scored_at > as_of - INTERVAL 1000 DAY)""",
    "params", *PF, "verdicts")
add("verdict_fresh", lambda s, d: B.verdicts(s, d).select("job_id", VD.is_fresh(
    F.col("semantic_scored_at"), F.col("semantic_score"), B.as_of(), SCORED_CFG)
    .alias("fresh")),
    "SELECT job_id, semantic_scored_at > as_of - INTERVAL 1000 DAY AS fresh "
    "FROM verdicts, params", "params", "verdicts")
add("verdict_replay", lambda s, d: VD.replay(B.verdicts(s, d).withColumns({
    "level_match": F.lit(None).cast("string"),
    "watchlist_dream": F.when(F.col("k") % 2 == 0, F.col("watchlist_dream")),
    "semantic_rationale": F.when(F.col("k") % 3 == 1, F.col("semantic_rationale"))})).select(
    "job_id", _int("semantic_score"), "semantic_rationale", "verdict_work_mode",
    "level_match", "geography_match", "watchlist_dream"),
    """SELECT job_id, CAST(semantic_score AS BIGINT) AS semantic_score,
      CASE WHEN k % 3 = 1 THEN semantic_rationale ELSE '' END AS semantic_rationale,
      verdict_work_mode, 'unclear' AS level_match, geography_match,
      CASE WHEN k % 2 = 0 THEN watchlist_dream ELSE FALSE END AS watchlist_dream
    FROM verdicts""", "verdicts")


def replies(s: SparkSession, d: str) -> DataFrame:
    """Raw replies in the shapes a text scorer produces."""
    v, k = B.verdicts(s, d), F.col("k")
    body = F.to_json(F.struct(
        F.when(k % 7 == 0, F.col("semantic_score") + 0.5).otherwise(
            F.col("semantic_score").cast("double")).alias("score"),
        F.col("verdict_work_mode").alias("work_mode"),
        F.col("semantic_rationale").alias("rationale"),
        F.concat("role_family_match", F.lit(" fit")).alias("role_family_match"),
        F.lit("weak").alias("industry_match"), F.upper("geography_match")
        .alias("geography_match"),
        F.col("level_match"), F.col("watchlist_dream"), F.col("life_fit_concerns")))
    v, body = v.withColumn("body", body), F.col("body")
    cut = F.substring(body, F.lit(1), F.length(body) - 9)
    raw = (F.when(k % 11 == 0, "I cannot score this.")
           .when(k % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(k % 5 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Thanks")))
           .when(k % 5 == 3, cut).otherwise(body))
    return v.select("job_id", "k", raw.alias("raw_text"))


add("verdict_parse", lambda s, d: VD.parse(replies(s, d)).select(
    "job_id", _int("semantic_score"), "semantic_rationale", "verdict_work_mode",
    "role_family_match", "industry_match", "geography_match", "level_match",
    "watchlist_dream", joined("life_fit_concerns")),
    """SELECT job_id, CAST(least(100, CASE WHEN k % 7 = 0 THEN
        round_even(semantic_score + 0.5, 0) ELSE semantic_score END) AS BIGINT)
        AS semantic_score, semantic_rationale, verdict_work_mode, role_family_match,
      'unclear' AS industry_match, geography_match, level_match, watchlist_dream,
      CASE WHEN k % 5 = 3 THEN left('concern ' || CAST(k % 9 AS VARCHAR), 3)
        ELSE 'concern ' || CAST(k % 9 AS VARCHAR) END AS life_fit_concerns
    FROM verdicts WHERE k % 11 <> 0""", "verdicts")
add("verdict_salvage", lambda s, d: replies(s, d).select(
    "job_id", F.get_json_object(VD.salvage(F.col("raw_text")), "$.work_mode").alias("mode")),
    """SELECT job_id, CASE WHEN k % 11 <> 0 AND k % 5 NOT IN (1, 2) THEN verdict_work_mode END
    AS mode FROM verdicts""", "verdicts")
_MODES = ["Remote-first", "HYBRID 3 days", "in-office", "On-site", "anywhere", "", "moon"]
add("normalize_work_mode", lambda s, d: B.postings(s, d).select("job_id",
    VD.normalize_work_mode(B.pick(_MODES, F.col("k") % 7)).alias("mode")),
    """SELECT job_id, list_extract(['remote','hybrid','onsite','onsite','remote','unclear',
    'unclear'], CAST(k % 7 + 1 AS INTEGER)) AS mode FROM postings""", "postings")
_GEO = ["Reachable", "unreachable", "totally unreachable", "reachable by train", "weak", " "]
add("coerce_enum", lambda s, d: B.postings(s, d).select("job_id", VD.coerce_enum(
    B.pick(_GEO, F.col("k") % 6), VD.ALLOWED["geography_match"]).alias("geo")),
    """SELECT job_id, list_extract(['reachable','unreachable','unreachable','reachable',
    'unclear','unclear'], CAST(k % 6 + 1 AS INTEGER)) AS geo FROM postings""", "postings")
_BOOLS = ["true", "Yes", "0", "2", "no", "maybe", ""]
add("coerce_bool_json", lambda s, d: B.postings(s, d).select("job_id", VD.coerce_bool_json(
    B.pick(_BOOLS, F.col("k") % 7)).alias("flag")),
    "SELECT job_id, k % 7 IN (0, 1, 3) AS flag FROM postings", "postings")
add("coerce_str_list", lambda s, d: B.postings(s, d).select("job_id", VD.coerce_str_list(
    F.array(F.lit(" a "), F.col("title"), F.lit(""), F.repeat("description", F.lit(3)),
            F.col("company_tier"), F.lit("f"), F.lit("g"), F.lit("h"), F.lit("ninth")))
    .alias("items")).select("job_id", joined("items")),
    """SELECT job_id, array_to_string(list_filter(list_transform([' a ', title,
      '', repeat(description, 3), company_tier, 'f', 'g', 'h', 'ninth'], lambda v: trim(v)),
      lambda v: v IS NOT NULL AND v <> ''), '|') AS items
    FROM postings""", "postings")
add("derive_tier", lambda s, d: scored(s, d).select("job_id", "tier"),
    "SELECT job_id, tier FROM scored", *SCORED)
add("score_combined", lambda s, d: scored(s, d).select(
    "job_id", _int("score"), _int("algo_score"), "tier", "track", "verdict_state",
    _int("semantic_score"), "semantic_rationale", _iso("semantic_scored_at"), "work_mode",
    "role_family_match", "geography_match", "watchlist_dream", joined("industries"),
    joined("role_types"), "company_group", _int("qol_score"), "engagement_type",
    joined("gates_triggered"), joined("modifiers_applied"), "prefilter_reason"),
    f"""SELECT job_id, CAST(score AS BIGINT) AS score, CAST(algo_score AS BIGINT) AS algo_score,
      tier, track, verdict_state, CAST(semantic_score AS BIGINT) AS semantic_score,
      semantic_rationale, {iso_sql('semantic_scored_at')} AS semantic_scored_at, work_mode,
      role_family_match, geography_match, watchlist_dream, industries, role_types,
      company_group, qol_score, engagement_type, hard_disqualifiers AS gates_triggered,
      soft_warnings AS modifiers_applied, prefilter_reason FROM scored""", *SCORED)
add("score_failure_default", lambda s, d: VD.with_failure_defaults(
    B.postings(s, d).select("job_id").join(
        B.verdicts(s, d).select("job_id", F.col("semantic_score").alias("score"),
                                F.lit("TRACK_1_FULLTIME").alias("track")), "job_id", "left"))
    .select("job_id", _int("score"), "track"),
    """SELECT p.job_id, CAST(coalesce(v.semantic_score, 0) AS BIGINT) AS score,
    CASE WHEN v.job_id IS NULL THEN 'unscored' ELSE 'TRACK_1_FULLTIME' END AS track
    FROM postings p LEFT JOIN verdicts v ON p.job_id = v.job_id""", "postings", "verdicts")
add("calibration_check", lambda s, d: VD.calibration(scored(s, d), B.postings(s, d).select(
    "job_id", F.col("title").alias("name"), (F.col("k") % 60).alias("expected_min"),
    (F.col("k") % 60 + 40).alias("expected_max"))).groupBy("verdict").agg(
    F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN score BETWEEN k % 60 AND k % 60 + 40 THEN 'PASS' ELSE 'FAIL' END
    AS verdict, count(*) AS n FROM scored GROUP BY 1""", *SCORED)

# --- projections and filters ----------------------------------------------

PAGE = ["job_id", "title", "company", "status", "source"]
add("project_browse", lambda s, d: BR.project_browse(scored(s, d)).select(
    "job_id", "title", "company", "company_normalized", "company_group", "company_tier",
    _int("score"), _int("qol_score"), "track", "engagement_type", "work_mode",
    joined("industries"), joined("role_types"), "salary_min", "salary_max", _iso("posted_at"),
    _int("semantic_score"), "semantic_rationale", "status", "source", "location", "url"),
    f"""SELECT job_id, title, company, company_normalized, company_group, company_tier,
    CAST(score AS BIGINT) AS score, qol_score, track, engagement_type, work_mode, industries,
    role_types, salary_min, salary_max, {iso_sql('posted_at')} AS posted_at,
    CAST(semantic_score AS BIGINT) AS semantic_score, semantic_rationale, status, source, location,
    url FROM scored""", *SCORED)
add("project_index", lambda s, d: BR.project_index(B.postings(s, d).withColumn(
    "score", F.lit(0)), "company").select(
    "company_normalized", _iso("posted_at"), "job_id", "title", _int("score"), "status", "url"),
    f"""SELECT company_normalized, {iso_sql('posted_at')} AS posted_at, job_id, title,
    CAST(0 AS BIGINT) AS score, status, url FROM postings""", "postings")
add("filter_status", lambda s, d: BR.filter_status(B.postings(s, d), "saved").select(PAGE),
    "SELECT job_id, title, company, status, source FROM postings WHERE status = 'saved'",
    "postings")
add("scan_active", lambda s, d: BR.filter_status(B.postings(s, d)).select(PAGE),
    "SELECT job_id, title, company, status, source FROM postings WHERE status = 'active'",
    "postings")
add("filter_search", lambda s, d: B.postings(s, d).where(BR.search("  New YORK ")).select(PAGE),
    """SELECT job_id, title, company, status, source FROM postings WHERE contains(
    lower(title || ' ' || company || ' ' || location), 'new york')""", "postings")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags"))


add("filter_array_overlap", lambda s, d: _parts(s, d).where(
    BR.overlaps("tags", ["ECONOMY", "brand#17"])).select("p_partkey"),
    "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#17' OR lower(p_type) = 'economy'")
add("filter_in", lambda s, d: B.postings(s, d).where(
    BR.one_of("work_mode", ["Remote", ""]) & BR.one_of("company_tier", ["s", "unclear"],
                                                       "unclear")).select(PAGE),
    """SELECT job_id, title, company, status, source FROM postings
    WHERE coalesce(work_mode, '') IN ('remote', '')
      AND lower(coalesce(company_tier, 'unclear')) IN ('s', 'unclear')""", "postings")
add("filter_min_score", lambda s, d: scored(s, d).where(
    BR.at_least("score", 50) & BR.at_least("qol_score", 40)).select("job_id"),
    "SELECT job_id FROM scored WHERE score >= 50 AND qol_score >= 40", *SCORED)
add("filter_min_salary", lambda s, d: B.postings(s, d).where(
    BR.min_salary(200000)).select("job_id"),
    """SELECT job_id FROM postings WHERE coalesce(nullif(salary_min, 0), nullif(salary_max, 0),
    0) >= 200000""", "postings")
_PARAMS = {"limit": "999", "offset": "-3", "min_score": "x", "min_qol": "35",
           "sort_by": "semantic", "dedup": "off", "industries": " gaming, ,tabletop"}
add("browse_params", lambda s, d: BR.browse(scored(s, d), BR.browse_params(_PARAMS)).select(
    "job_id", _int("score")),
    """SELECT job_id, CAST(score AS BIGINT) AS score FROM scored WHERE status = 'active'
    AND qol_score >= 35 AND (contains('|' || industries || '|', '|gaming|')
      OR contains('|' || industries || '|', '|tabletop|'))
    ORDER BY score DESC, job_id LIMIT 200""", *SCORED)
add("filter_fresh_cutoff", lambda s, d: B.postings(s, d).join(
    B.verdicts(s, d).select("job_id", "semantic_scored_at"), "job_id", "left").where(
    BR.not_fresh("semantic_scored_at", B.as_of() - F.make_dt_interval(days=F.lit(400))))
    .select("job_id"),
    """SELECT p.job_id FROM postings p LEFT JOIN verdicts v ON p.job_id = v.job_id, params
    WHERE v.job_id IS NULL OR semantic_scored_at <= as_of - INTERVAL 400 DAY""",
    "params", "postings", "verdicts")
add("filter_min_semantic", lambda s, d: R.filter_min_semantic(B.verdicts(s, d), 60).select(
    "job_id", _int("semantic_score")),
    "SELECT job_id, CAST(semantic_score AS BIGINT) AS semantic_score FROM verdicts "
    "WHERE semantic_score >= 60", "verdicts")
add("hidden_company_filter", lambda s, d: BR.hide_companies(
    scored(s, d), B.companies(s, d).where("crunch").select(
        F.col("company_name_normalized").alias("company_normalized")), 20)
    .select("job_id"),
    """SELECT job_id FROM scored WHERE score >= 20 AND company_normalized NOT IN
    (SELECT company_name_normalized FROM companies WHERE crunch)""", *SCORED)

# --- dedup, sort, pages ----------------------------------------------------

_DEDUP = """keyed AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS tk
    FROM scored), ranked AS (SELECT *, row_number() OVER (PARTITION BY company_normalized, tk
      ORDER BY score DESC, job_id) AS rn, count(*) OVER (PARTITION BY company_normalized, tk)
      AS n FROM keyed WHERE tk <> ''),
  srcs AS (SELECT company_normalized, tk, string_agg(source, '|' ORDER BY f) AS sources
    FROM (SELECT company_normalized, tk, source, min(job_id) AS f FROM keyed WHERE tk <> ''
          GROUP BY ALL) GROUP BY ALL),
  deduped AS (SELECT r.* EXCLUDE (rn, n, tk), n AS dupe_count, sources AS dupe_sources
    FROM ranked r JOIN srcs USING (company_normalized, tk) WHERE rn = 1
    UNION ALL BY NAME SELECT * EXCLUDE (tk), NULL::BIGINT AS dupe_count,
      NULL::VARCHAR AS dupe_sources FROM keyed WHERE tk = '')"""
_DSQL = _DEDUP.replace("FROM scored", "FROM scored")
add("dedup_postings", lambda s, d: BR.dedup_postings(BR.project_browse(scored(s, d))).select(
    "job_id", _int("score"), "dupe_count",
    F.array_join("dupe_sources", "|").alias("dupe_sources")),
    f"WITH {_DSQL} SELECT job_id, CAST(score AS BIGINT) AS score, dupe_count, dupe_sources "
    "FROM deduped", *SCORED)
_PAY = "coalesce(nullif(salary_min, 0), nullif(salary_max, 0), -1)"
_SORTS = {
    "sort_score": ("score", "desc", "score DESC"), "sort_qol": ("qol", "desc",
                                                                "qol_score DESC"),
    "sort_comp": ("comp", "asc", f"{_PAY} ASC"),
    "sort_newest": ("newest", "desc", "posted_at DESC"),
    "sort_semantic": ("semantic", "desc", "coalesce(semantic_score, -1) DESC"),
    "sort_oldest": ("oldest", "desc", "posted_at ASC"),
    "sort_company": ("company_desc", "asc", "lower(trim(company)) DESC, score DESC"),
}
for _key, (_by, _dir, _order) in _SORTS.items():
    add(_key, lambda s, d, b=_by, r=_dir: scored(s, d).select("job_id", F.row_number().over(
        W.partitionBy("company_normalized").orderBy(*BR.sort_columns(b, r))).cast("bigint")
        .alias("place")),
        f"""SELECT job_id, row_number() OVER (PARTITION BY company_normalized
        ORDER BY {_order}, job_id) AS place FROM scored""", *SCORED)
_SPEC = BR.BrowseSpec(min_score=1, sort_by="qol", limit=40, offset=20)
add("paginate_offset", lambda s, d: BR.paginate_offset(
    BR.apply_filters(scored(s, d), _SPEC), _SPEC).select("job_id", _int("qol_score")),
    """SELECT job_id, qol_score FROM scored WHERE status = 'active' AND score >= 1
    ORDER BY qol_score DESC, job_id LIMIT 40 OFFSET 20""", *SCORED)
add("page_totals", lambda s, d: BR.page_totals(BR.filter_status(scored(s, d)),
                                               BR.BrowseSpec(offset=10)),
    """SELECT raw_total, total, raw_total - total AS dupes_collapsed, total > 60 AS has_more,
      CASE WHEN total > 60 THEN CAST(60 AS BIGINT) END AS next_offset
    FROM (SELECT count(*) AS raw_total, count(DISTINCT CASE WHEN tk <> '' THEN
        company_normalized || chr(31) || tk END) + count(CASE WHEN tk = '' THEN 1 END) AS total
      FROM (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS tk FROM scored
            WHERE status = 'active'))""", *SCORED)


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return B.postings(s, d).join(B.verdicts(s, d).select(
        "job_id", F.col("semantic_score").alias("score")), "job_id").withColumn(
        "score_posted", score_posted(F.col("score"), iso_z(F.col("posted_at"))))


_KEYED = f"""keyed AS (SELECT p.*, v.semantic_score AS score, lpad(CAST(least(
    v.semantic_score, 100) AS VARCHAR), 4, '0') || '#' || {iso_sql('p.posted_at')}
    AS score_posted FROM postings p JOIN verdicts v ON p.job_id = v.job_id)"""
_AFTER = ("0080#2000-01-01T00:00:00Z", "lever:1")
add("paginate_cursor", lambda s, d: BR.paginate_cursor(_keyed(s, d), 50, _AFTER).select(
    "job_id", "score_posted"),
    f"""WITH {_KEYED} SELECT job_id, score_posted FROM keyed WHERE status = 'active' AND
    (score_posted < '{_AFTER[0]}' OR (score_posted = '{_AFTER[0]}' AND job_id > '{_AFTER[1]}'))
    ORDER BY score_posted DESC, job_id LIMIT 50""", "postings", "verdicts")
add("next_cursor", lambda s, d: BR.next_cursor(BR.paginate_cursor(_keyed(s, d), 50)),
    f"""WITH {_KEYED} SELECT score_posted, job_id FROM (SELECT * FROM keyed
    WHERE status = 'active' ORDER BY score_posted DESC, job_id LIMIT 50)
    ORDER BY score_posted, job_id DESC LIMIT 1""", "postings", "verdicts")
add("hydrate_fields", lambda s, d: BR.hydrate_fields(
    scored(s, d).select("job_id", "track", _int("score")), scored(s, d)).select(
    "job_id", "track", "score", "work_mode", "engagement_type"),
    """SELECT job_id, track, CAST(score AS BIGINT) AS score, work_mode, engagement_type
    FROM scored""", *SCORED)
_BROWSE = BR.BrowseSpec(min_qol=20, work_modes=["remote", "hybrid"], min_salary=50000)
add("browse", lambda s, d: BR.browse(scored(s, d), _BROWSE).select(
    "job_id", "title", "company", _int("score"), _int("qol_score"), "work_mode",
    "semantic_rationale", "dupe_count", F.array_join("dupe_sources", "|")
    .alias("dupe_sources"), _iso("posted_at")),
    f"""WITH base AS (SELECT * FROM scored WHERE status = 'active' AND qol_score >= 20
      AND work_mode IN ('remote', 'hybrid') AND {_PAY} >= 50000),
    {_DSQL.replace('FROM scored', 'FROM base')}
    SELECT job_id, title, company, CAST(score AS BIGINT) AS score, qol_score, work_mode,
      coalesce(semantic_rationale, '') AS semantic_rationale, dupe_count, dupe_sources,
      {iso_sql('posted_at')} AS posted_at
    FROM deduped ORDER BY score DESC, job_id LIMIT 50""", *SCORED)
add("postings_by_company", lambda s, d: BR.top_by(
    B.postings(s, d), F.col("company_normalized") == "customer#000000011",
    [F.col("posted_at").desc(), F.col("job_id")], 50).select("job_id", _iso("posted_at")),
    f"""SELECT job_id, {iso_sql('posted_at')} AS posted_at FROM postings
    WHERE company_normalized = 'customer#000000011' ORDER BY posted_at DESC, job_id LIMIT 50""",
    "postings")
add("postings_by_track", lambda s, d: BR.top_by(
    scored(s, d).withColumn("score_posted", score_posted(F.col("score"),
                                                         iso_z(F.col("posted_at")))),
    F.col("track") == "TRACK_2_INTERIM", [F.col("score_posted").desc(), F.col("job_id")], 50,
    computed=True).select("job_id", "score_posted"),
    f"""SELECT job_id, sp AS score_posted FROM (SELECT job_id, track, lpad(CAST(least(score, 100)
      AS VARCHAR), 4, '0') || '#' || {iso_sql('posted_at')} AS sp FROM scored)
    WHERE track = 'TRACK_2_INTERIM' ORDER BY sp DESC, job_id LIMIT 50""", *SCORED)
add("postings_by_source_date", lambda s, d: BR.top_by(
    B.postings(s, d), (F.col("source") == "lever") & (F.col("scraped_at") >= F.lit(
        "1999-01-01").cast("timestamp")), [F.col("scraped_at").desc(), F.col("job_id")], 50)
    .select("job_id", _iso("scraped_at")),
    f"""SELECT job_id, {iso_sql('scraped_at')} AS scraped_at FROM postings WHERE
    source = 'lever' AND scraped_at >= TIMESTAMP '1999-01-01'
    ORDER BY scraped_at DESC, job_id LIMIT 50""", "postings")
add("companies_by_tier", lambda s, d: B.companies(s, d).where("tier = 'S'").orderBy(
    "company_name").select("company_name", "tier"),
    "SELECT company_name, tier FROM companies WHERE tier = 'S'", "companies")
add("top_n_scores", lambda s, d: BR.top_by(
    B.verdicts(s, d), F.lit(True), [F.col("semantic_score").desc(), F.col("job_id")], 20)
    .select("job_id", _int("semantic_score")),
    """SELECT job_id, CAST(semantic_score AS BIGINT) AS semantic_score FROM verdicts
    ORDER BY semantic_score DESC, job_id LIMIT 20""", "verdicts")

# --- reports ---------------------------------------------------------------

_BAND = ("CASE WHEN score >= 78 THEN 'T1' WHEN score >= 65 THEN 'T2' WHEN score >= 50 THEN 'T3' "
         "ELSE 'below' END")
for _dim, _expr in (("band", _BAND), ("track", "track"), ("source", "source")):
    add(f"stats_by_{_dim}", lambda s, d, n=_dim: R.stats_by(scored(s, d), n),
        f"SELECT {_expr} AS value, count(*) AS n FROM scored WHERE status = 'active' "
        "GROUP BY 1", *SCORED)
add("score_distribution", lambda s, d: R.score_distribution(scored(s, d)).select(
    _int("ord"), "bucket", "n"),
    """WITH b AS (SELECT unnest(['gated_0','1-34','35-49','50-64','65-77_T2','78+_T1'])
      AS bucket, unnest(range(6)) AS ord)
    SELECT ord, b.bucket, count(s.job_id) AS n FROM b LEFT JOIN (SELECT job_id, CASE WHEN
      score = 0 THEN 'gated_0' WHEN score < 35 THEN '1-34' WHEN score < 50 THEN '35-49'
      WHEN score < 65 THEN '50-64' WHEN score < 78 THEN '65-77_T2' ELSE '78+_T1' END AS bucket
      FROM scored) s ON s.bucket = b.bucket GROUP BY 1, 2""", *SCORED)
add("coverage_by_status", lambda s, d: R.coverage_by_status(scored(s, d).withColumns({
    "passed_prefilter": F.when(F.col("k") % 3 != 0, F.col("passed_prefilter")),
    "status": F.when(F.col("k") % 13 != 0, F.col("status"))})),
    """SELECT coalesce(st, 'TOTAL') AS status, w AS with_pf, n - w AS without_pf, n AS total,
      round_even(w * 100.0::DOUBLE / n, 1) AS coverage_pct
    FROM (SELECT st, count(*) AS n, count(CASE WHEN k % 3 <> 0 THEN 1 END) AS w
      FROM (SELECT k, CASE WHEN k % 13 <> 0 THEN status ELSE '<none>' END AS st FROM scored)
      GROUP BY ROLLUP (st))""", *SCORED)
_VIEW = f"""CASE WHEN tier = 'needs_review' THEN '{R.REVIEW}'
  WHEN tier = 'DISQUALIFIED' THEN '{R.REJECTS}' WHEN watchlist_dream THEN '{R.REVIEW}'
  WHEN passed_prefilter THEN '{R.APPLY}' ELSE '{R.REJECTS}' END"""
_BANDS = f"""CASE {' '.join(f"WHEN semantic_score >= {c} THEN '{t}'" for c, t in R.BANDS)}
  ELSE '{R.LOWEST_BAND}' END"""


def _sub(reject: str) -> str:
    return f"""CASE WHEN view = '{R.APPLY}' THEN {_BANDS} WHEN view = '{R.REVIEW}' THEN
      CASE WHEN tier = 'needs_review' THEN 'Needs review' WHEN watchlist_dream
      THEN 'Watchlist - dream company' ELSE 'Other' END ELSE {reject} END"""


_AUDIT = f"""audit AS (SELECT *, {_sub("split_part(prefilter_reason, ':', 1)")} AS sub_group,
  {_sub('prefilter_reason')} AS full_group FROM (SELECT *, {_VIEW} AS view FROM scored))"""
add("audit_view", lambda s, d: R.with_audit(scored(s, d)).select("job_id", "view"),
    f"WITH {_AUDIT} SELECT job_id, view FROM audit", *SCORED)
add("audit_subgroup", lambda s, d: R.with_audit(scored(s, d)).select(
    "job_id", "view", "sub_group"),
    f"WITH {_AUDIT} SELECT job_id, view, sub_group FROM audit", *SCORED)
add("filter_views", lambda s, d: R.filter_views(R.with_audit(scored(s, d)), "3,1").select(
    "job_id", "view"),
    f"WITH {_AUDIT} SELECT job_id, view FROM audit WHERE view <> '{R.REVIEW}'", *SCORED)
add("audit_sort", lambda s, d: R.audit_sort(R.with_audit(scored(s, d))).select("job_id"),
    f"""WITH {_AUDIT} SELECT job_id FROM audit ORDER BY view,
      CASE WHEN view <> '{R.REJECTS}' THEN -coalesce(nullif(semantic_score, 0), -1) END,
      lower(company), CASE WHEN view = '{R.REJECTS}' THEN lower(title) END, job_id""",
    *SCORED)
add("audit_summary", lambda s, d: R.audit_summary(R.with_audit(scored(s, d))),
    f"""WITH {_AUDIT} SELECT v.view, coalesce(sub_group, '') AS sub_group, count(job_id) AS n
    FROM (SELECT unnest(['{R.APPLY}', '{R.REVIEW}', '{R.REJECTS}']) AS view) v
    LEFT JOIN audit a ON a.view = v.view GROUP BY 1, 2""", *SCORED)
add("export_csv", lambda s, d: R.audit_export(scored(s, d)).select(
    "job_id", "view", "sub_group", "semantic_score", "final_score", "passed_prefilter",
    "salary_min", "salary_max", "posted_at", "hard_disqualifiers", "soft_warnings",
    "positive_signals", "is_dream_company", "industries", "semantic_rationale"),
    f"""WITH {_AUDIT} SELECT job_id, view, full_group AS sub_group,
      coalesce(CAST(semantic_score AS VARCHAR), '') AS semantic_score,
      CAST(score AS VARCHAR) AS final_score,
      CASE WHEN passed_prefilter THEN 'true' ELSE 'false' END AS passed_prefilter,
      coalesce(CAST(nullif(salary_min, 0) AS VARCHAR), '') AS salary_min,
      coalesce(CAST(nullif(salary_max, 0) AS VARCHAR), '') AS salary_max,
      {iso_sql('posted_at')} AS posted_at,
      replace(hard_disqualifiers, '|', '; ') AS hard_disqualifiers,
      replace(soft_warnings, '|', '; ') AS soft_warnings,
      replace(positive_signals, '|', '; ') AS positive_signals,
      CASE WHEN is_dream_company THEN 'true' ELSE 'false' END AS is_dream_company,
      replace(industries, '|', '; ') AS industries,
      coalesce(semantic_rationale, '') AS semantic_rationale FROM audit""", *SCORED)


def _items(s: SparkSession, d: str) -> DataFrame:
    """Item outcomes of runs: one run per event type and day."""
    e = B.table(s, d, "events")
    i = F.col("event_id")
    return e.select(
        F.col("event_type").alias("source_name"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("run_timestamp"),
        i.alias("item_no"), F.when(i % 4 != 0, i % 4 == 1).alias("existed"),
        F.when((i % 4 == 0) & (F.col("event_type") != "click"),
               F.concat(F.lit("ValueError: "), i.cast("string"))).alias("error"),
        F.floor("value").cast("bigint").alias("duration_ms"), (i % 1000 == 0).alias("fatal"))


add("run_errors", lambda s, d: R.run_errors(_items(s, d)).withColumn(
    "run_timestamp", iso_z(F.col("run_timestamp"))),
    f"""SELECT event_type AS source_name,
      {iso_sql("date_trunc('day', ts)::TIMESTAMP")} AS run_timestamp, event_id AS item_no,
      'ValueError: ' || CAST(event_id AS VARCHAR) AS error FROM events
    WHERE event_id % 4 = 0 AND event_type <> 'click'""")
add("run_summary", lambda s, d: R.run_summary(_items(s, d)).withColumn(
    "run_timestamp", iso_z(F.col("run_timestamp"))),
    f"""SELECT source_name, {iso_sql('run_timestamp')} AS run_timestamp,
      CASE WHEN fatal THEN 'error' WHEN n_err > 0 THEN 'partial' ELSE 'ok' END AS status,
      jobs_found, jobs_new, jobs_updated, duration_ms,
      CAST(epoch(run_timestamp) AS BIGINT) + 2592000 AS expires_at,
      n_err AS n_errors, error_message
    FROM (SELECT event_type AS source_name, date_trunc('day', ts)::TIMESTAMP AS run_timestamp,
        count(*) AS jobs_found, count(CASE WHEN event_id % 4 IN (2, 3) THEN 1 END) AS jobs_new,
        count(CASE WHEN event_id % 4 = 1 THEN 1 END) AS jobs_updated,
        max(CAST(floor(value) AS BIGINT)) AS duration_ms, bool_or(event_id % 1000 = 0) AS fatal,
        count(CASE WHEN event_id % 4 = 0 AND event_type <> 'click' THEN 1 END) AS n_err,
        'ValueError: ' || CAST(min(CASE WHEN event_id % 4 = 0 AND event_type <> 'click' THEN
          event_id END) AS VARCHAR) AS error_message
      FROM events GROUP BY 1, 2)""")
_RUNS = f"""SELECT run_id, source_name, {iso_sql("date_trunc('second', run_timestamp)")}
  AS run_timestamp, status, jobs_found"""
add("latest_runs_per_source", lambda s, d: R.latest_runs_per_source(B.runs(s, d)).select(
    "run_id", "source_name", _iso("run_timestamp"), "status", "jobs_found"),
    f"""{_RUNS} FROM (SELECT *, row_number() OVER (PARTITION BY source_name
      ORDER BY run_timestamp DESC, run_id) AS rn FROM runs) WHERE rn <= 3
    ORDER BY runs.run_timestamp DESC, run_id LIMIT 20""".replace("runs.run", "run"), "runs")
add("source_health_card", lambda s, d: R.source_health_card(B.runs(s, d)).select(
    "source_name", "status", _iso("run_timestamp"), "jobs_found", "runs_shown", "ok_runs"),
    f"""WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name
      ORDER BY run_timestamp DESC, run_id) AS rn FROM runs) WHERE rn <= 3)
    SELECT source_name, max(CASE WHEN rn = 1 THEN status END) AS status,
      {iso_sql("date_trunc('second', max(run_timestamp))")} AS run_timestamp,
      max(CASE WHEN rn = 1 THEN jobs_found END) AS jobs_found, count(*) AS runs_shown,
      count(CASE WHEN status = 'ok' THEN 1 END) AS ok_runs FROM recent GROUP BY 1""", "runs")


def before_rescore(s: SparkSession, d: str) -> DataFrame:
    stored = B.postings(s, d).join(B.verdicts(s, d).where("k % 2 = 0").select(
        "job_id", F.col("semantic_score"), "semantic_scored_at"), "job_id", "left")
    return stored.withColumns({"score": F.coalesce("semantic_score", F.lit(7)),
                               "tier": F.lit("old"), "track": F.lit("unscored")})


def rescored(s: SparkSession, d: str, stored: DataFrame,
             verdicts: DataFrame | None = None) -> DataFrame:
    verdicts = B.verdicts(s, d) if verdicts is None else verdicts
    return TB.rescore(stored, verdicts, SCORED_CFG, B.as_of(), B.companies(s, d),
                      fresh_hours=24 * 500)


def _rescored(s: SparkSession, d: str) -> DataFrame:
    return rescored(s, d, before_rescore(s, d))


_RESCORED = f"""old AS (SELECT k AS ok, semantic_score AS old_score,
    semantic_scored_at AS old_at FROM verdicts WHERE k % 2 = 0),
  results AS (SELECT s.job_id, s.k, CASE WHEN old_at > as_of - INTERVAL 500 DAY THEN 'skipped'
      WHEN verdict_state = 'missing' THEN 'api_failed' ELSE 'updated' END AS outcome,
      verdict_state, s.score AS new_score, s.tier AS new_tier, s.track AS new_track,
      s.semantic_score AS new_sem, old_score FROM scored s LEFT JOIN old ON s.k = old.ok)"""
add("rescore", lambda s, d: _rescored(s, d).select(
    "job_id", "outcome", _int("score"), "tier", "track", _int("semantic_score")),
    f"""WITH {_RESCORED} SELECT job_id, outcome,
      CAST(CASE WHEN outcome = 'updated' THEN new_score ELSE coalesce(old_score, 7) END
        AS BIGINT) AS score,
      CASE WHEN outcome = 'updated' THEN new_tier ELSE 'old' END AS tier,
      CASE WHEN outcome = 'updated' THEN new_track ELSE 'unscored' END AS track,
      CAST(CASE WHEN outcome = 'updated' THEN coalesce(new_sem, old_score) ELSE old_score END
        AS BIGINT) AS semantic_score FROM results""", *SCORED)
add("rescore_summary", lambda s, d: R.rescore_summary(_rescored(s, d)),
    f"""WITH {_RESCORED} SELECT count(*) AS total,
      count(CASE WHEN outcome = 'updated' THEN 1 END) AS updated,
      count(CASE WHEN outcome = 'updated' AND verdict_state = 'scored' THEN 1 END)
        AS scored_rows,
      count(CASE WHEN outcome = 'skipped' THEN 1 END) AS skipped,
      count(CASE WHEN outcome = 'api_failed' THEN 1 END) AS api_failed_skipped,
      count(CASE WHEN outcome = 'error' THEN 1 END) AS errors FROM results""", *SCORED)


# --- joins, windows, sets --------------------------------------------------

def _wanted(s: SparkSession, d: str) -> DataFrame:
    """Requested ids: some known, some unknown, some blank or repeated."""
    k = F.col("l_partkey")
    return B.table(s, d, "lineitem").select(F.when(k % 10 == 0, F.lit("  ")).when(
        k % 3 == 0, F.concat(F.lit(" missing:"), k.cast("string"))).otherwise(
        F.concat(B.pick(B.SOURCES, k % 6), F.lit(":"), k.cast("string"), F.lit(" ")))
        .alias("job_id"))


_WANTED = """wanted AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'missing:' ||
    CAST(l_partkey AS VARCHAR) ELSE list_extract(['greenhouse','lever','ashby',
    'apify_linkedin','remoteok','workday'], CAST(l_partkey % 6 + 1 AS INTEGER)) || ':' ||
    CAST(l_partkey AS VARCHAR) END AS job_id FROM lineitem WHERE l_partkey % 10 <> 0)"""
add("join_small_inner", lambda s, d: B.postings(s, d).join(
    B.companies(s, d).where("ats_slug IS NOT NULL").select(
        F.col("company_name_normalized").alias("company_normalized"), "ats_slug"),
    "company_normalized").select("job_id", "ats_slug"),
    """SELECT job_id, ats_slug FROM postings JOIN companies ON company_normalized =
    company_name_normalized WHERE ats_slug IS NOT NULL""", "postings", "companies")
add("join_small_left", lambda s, d: with_company_facts(
    B.postings(s, d), CFG, B.companies(s, d)).select(
    "job_id", "map_industry", "is_equality_co", "is_crunch_listed"),
    """SELECT job_id, industry AS map_industry, coalesce(equality, FALSE) AS is_equality_co,
    coalesce(crunch, FALSE) AS is_crunch_listed FROM postings LEFT JOIN companies
    ON company_normalized = company_name_normalized""", "postings", "companies")
add("join_large_left", lambda s, d: B.postings(s, d).join(
    B.verdicts(s, d).select("job_id", "semantic_score"), "job_id", "left").select(
    "job_id", _int("semantic_score")),
    """SELECT p.job_id, CAST(semantic_score AS BIGINT) AS semantic_score FROM postings p
    LEFT JOIN verdicts v ON p.job_id = v.job_id""", "postings", "verdicts")
add("join_skewed_left", lambda s, d: CO.salted_left_join(
    B.postings(s, d), B.companies(s, d).select(
        F.col("tier").alias("company_tier"), "company_name", "equality").where("tier = 'S'")
    .groupBy("company_tier").agg(F.count(F.lit(1)).alias("members")), "company_tier").select(
    "job_id", "members"),
    """SELECT job_id, CASE WHEN company_tier = 'S' THEN (SELECT count(*) FROM companies
    WHERE tier = 'S') END AS members FROM postings""", "postings", "companies")
add("join_semi", lambda s, d: TB.existing_ids(B.postings(s, d), _wanted(s, d)),
    f"WITH {_WANTED} SELECT job_id FROM wanted WHERE job_id IN (SELECT job_id FROM postings)",
    "postings")
add("join_anti", lambda s, d: TB.missing_ids(B.postings(s, d), _wanted(s, d)),
    f"WITH {_WANTED} SELECT job_id FROM wanted WHERE job_id NOT IN "
    "(SELECT job_id FROM postings)", "postings")
add("join_phrases", lambda s, d: CO.phrase_matches(
    B.postings(s, d).select("job_id", "title"), CFG.to_df(s).where(
        "kind = 'function_titles'"), "job_id", "title", 3).select("job_id", "phrase"),
    "SELECT job_id, unnest(list_filter(" + B.array(CFG.function_titles) + ", lambda p: "
    "contains(w, ' ' || p || ' '))) AS phrase FROM (SELECT job_id, ' ' || array_to_string("
    "regexp_extract_all(lower(title), '\\w+'), ' ') || ' ' AS w FROM postings)", "postings")
add("per_company_cap", lambda s, d: CO.cap_per_key(
    B.postings(s, d), "company_normalized", [F.col("posted_at").desc(), F.col("job_id")], 5)
    .select("job_id", "company_normalized"),
    """SELECT job_id, company_normalized FROM (SELECT *, row_number() OVER (PARTITION BY
    company_normalized ORDER BY posted_at DESC, job_id) AS rn FROM postings) WHERE rn <= 5""",
    "postings")
_UNION = {source: columns for source, columns in zip(B.SOURCES, [
    ("title",), ("company",), ("title", "company"), ("location",), ("title", "location"), ()])}
add("union_sources", lambda s, d: CO.union_sources({
    source: B.postings(s, d).where(F.col("source") == source).select("job_id", *columns)
    for source, columns in _UNION.items()}),
    "SELECT job_id, " + ", ".join(
        f"CASE WHEN source IN ({', '.join(repr(s) for s, cs in _UNION.items() if c in cs)}) "
        f"THEN {c} END AS {c}" for c in ("title", "company", "location"))
    + " FROM postings", "postings")
add("union_passthrough", lambda s, d: BR.dedup_postings(BR.project_browse(scored(s, d))).agg(
    F.count(F.lit(1)).alias("n"), F.count("dupe_count").alias("keyed"),
    F.sum("dupe_count").alias("rows")),
    f"""WITH {_DSQL} SELECT count(*) AS n, count(dupe_count) AS keyed,
    CAST(sum(dupe_count) AS BIGINT) AS rows FROM deduped""", *SCORED)
add("distinct_ids", lambda s, d: TB.distinct_ids(_wanted(s, d)),
    f"WITH {_WANTED} SELECT job_id FROM wanted")
add("distinct_cards", lambda s, d: CO.distinct_first(
    B.postings(s, d).select("title", "posted_at", "job_id", "location"), "title",
    ["posted_at", "job_id"]).select("title", "job_id", "location"),
    """SELECT title, job_id, location FROM (SELECT *, row_number() OVER (PARTITION BY title
    ORDER BY posted_at, job_id) AS rn FROM postings) WHERE rn = 1""", "postings")


# --- table changes ---------------------------------------------------------

def _stored(s: SparkSession, d: str) -> DataFrame:
    return B.postings(s, d).where("k % 5 <> 0").withColumn("score", F.lit(11)).select(
        "job_id", "title", "salary_max", "status", "user_notes", "scraped_at", "score")


def _incoming(s: SparkSession, d: str) -> DataFrame:
    """Re-deliveries (some twice) and new postings, without user state of their own."""
    p = B.postings(s, d).where("k % 4 <> 1 OR k % 5 = 0")
    first = p.select("job_id", F.concat(F.lit("v1 "), F.col("title")).alias("title"),
                     F.lit(None).cast("bigint").alias("salary_max"),
                     F.lit("active").alias("status"), "scraped_at", "work_mode")
    again = p.where("k % 8 = 0").select(
        "job_id", F.concat(F.lit("v2 "), F.col("title")).alias("title"),
        F.lit(1).cast("bigint").alias("salary_max"), F.lit("active").alias("status"),
        (F.col("scraped_at") + F.expr("INTERVAL 1 DAY")).alias("scraped_at"), "work_mode")
    return first.unionByName(again)


add("upsert_postings", lambda s, d: TB.upsert_postings(_stored(s, d), _incoming(s, d)).select(
    "job_id", "title", "salary_max", "status", "user_notes", _int("score"), "work_mode",
    "change"),
    """SELECT job_id, CASE WHEN NOT sent THEN title WHEN k % 8 = 0 THEN 'v2 ' || title
        ELSE 'v1 ' || title END AS title,
      CASE WHEN k % 8 = 0 THEN 1 WHEN k % 5 <> 0 THEN salary_max END AS salary_max,
      CASE WHEN k % 5 <> 0 THEN status ELSE 'active' END AS status,
      CASE WHEN k % 5 <> 0 THEN user_notes END AS user_notes,
      CASE WHEN k % 5 <> 0 THEN 11::BIGINT END AS score,
      CASE WHEN sent THEN work_mode END AS work_mode,
      CASE WHEN NOT sent THEN 'kept' WHEN k % 5 = 0 THEN 'new' ELSE 'updated' END AS change
    FROM (SELECT *, k % 4 <> 1 OR k % 5 = 0 AS sent FROM postings)""", "postings")
add("carry_semantic", lambda s, d: TB.carry_verdicts(
    _incoming(s, d).where("title LIKE 'v1%'"), B.verdicts(s, d).withColumn(
        "work_mode", F.col("verdict_work_mode"))).select(
    "job_id", _int("semantic_score"), "semantic_model", "work_mode"),
    """SELECT p.job_id, CAST(semantic_score AS BIGINT) AS semantic_score, semantic_model,
    coalesce(p.work_mode, v.verdict_work_mode) AS work_mode FROM postings p
    LEFT JOIN verdicts v ON p.job_id = v.job_id WHERE p.k % 4 <> 1 OR p.k % 5 = 0""",
    "postings", "verdicts")
add("apply_action", lambda s, d: TB.apply_action(
    B.postings(s, d), _wanted(s, d), "applied", "sent").select("job_id", "status",
                                                               "user_notes"),
    f"""WITH {_WANTED} SELECT job_id, CASE WHEN hit THEN 'applied' ELSE status END AS status,
      CASE WHEN hit THEN 'sent' ELSE user_notes END AS user_notes
    FROM (SELECT *, job_id IN (SELECT job_id FROM wanted) AS hit FROM postings)""", "postings")
add("bulk_summary", lambda s, d: TB.bulk_summary(B.postings(s, d), _wanted(s, d)),
    f"""WITH {_WANTED} SELECT count(*) AS requested, count(p.job_id) AS updated,
    count(*) - count(p.job_id) AS missing FROM wanted w LEFT JOIN postings p
    ON w.job_id = p.job_id""", "postings")
add("shard", lambda s, d: TB.shard(B.postings(s, d), 2, 8).select("job_id"))
add("shard_union", lambda s, d: reduce(lambda a, b: a.unionByName(b), [
    TB.shard(B.postings(s, d), i, 4).select("job_id") for i in range(4)]).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n")),
    "SELECT job_id, count(*) AS n FROM postings GROUP BY job_id", "postings")
add("resume_tail", lambda s, d: B.verdicts(s, d).where(BR.not_fresh(
    "semantic_scored_at", B.as_of() - F.make_dt_interval(hours=F.lit(24 * 90)))).select(
    "job_id"),
    "SELECT job_id FROM verdicts, params WHERE semantic_scored_at <= as_of - INTERVAL 90 DAY",
    "params", "verdicts")
add("expire_runs", lambda s, d: TB.expire_runs(
    B.runs(s, d), F.lit("2024-02-15 00:00:00").cast("timestamp")).select("run_id"),
    "SELECT run_id FROM runs WHERE expires_at > epoch(TIMESTAMP '2024-02-15')", "runs")
add("expire_raw", lambda s, d: TB.expire_raw(B.postings(s, d).select(
    "job_id", F.year("posted_at").alias("y"), F.month("posted_at").alias("m"),
    F.day("posted_at").alias("d")), B.as_of()).select("job_id"),
    "SELECT job_id FROM postings, params WHERE posted_at > as_of - INTERVAL 90 DAY",
    "params", "postings")


def _prefs(s: SparkSession, d: str) -> DataFrame:
    e = B.table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("user_id"),
                    F.col("event_type").alias("config_key"), F.col("props").alias("value"),
                    F.struct(F.col("ts"), F.col("event_id")).alias("updated_at"))


_PREFS = """SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS config_key,
  arg_max(props, ts) AS value FROM events GROUP BY 1, 2"""
add("prefs_put", lambda s, d: TB.prefs_put(
    _prefs(s, d).where("updated_at.event_id % 2 = 0"),
    _prefs(s, d).where("updated_at.event_id % 2 = 1")).select("user_id", "config_key", "value"),
    _PREFS)
add("prefs_read", lambda s, d: TB.prefs_map(TB.prefs_put(
    _prefs(s, d), _prefs(s, d).limit(0))).select(
    "user_id", F.array_join(F.map_keys("prefs"), "|").alias("keys"),
    F.try_element_at("prefs", F.lit("click")).alias("click")),
    f"""SELECT user_id, string_agg(config_key, '|' ORDER BY config_key) AS keys,
    max(CASE WHEN config_key = 'click' THEN value END) AS click FROM ({_PREFS})
    GROUP BY 1""")
add("companies_seed", lambda s, d: TB.upsert_rows(
    B.companies(s, d).where("ck % 3 <> 0").select("company_name_normalized", "tier"),
    B.companies(s, d).where("ck % 2 = 0 OR ck % 3 = 0").select(
        "company_name_normalized", F.lit("2").alias("tier")),
    "company_name_normalized"),
    """SELECT company_name_normalized, CASE WHEN ck % 2 = 0 OR ck % 3 = 0 THEN '2'
    ELSE tier END AS tier FROM companies""", "companies")
add("point_lookup", lambda s, d: TB.lookup(B.companies(s, d), "company_name_normalized",
                                           "customer#000000042").select(
    "company_name", "tier", "industry"),
    """SELECT company_name, tier, industry FROM companies
    WHERE company_name_normalized = 'customer#000000042'""", "companies")
add("tier_counts", lambda s, d: B.verdicts(s, d).groupBy(
    tier_from_score(F.col("semantic_score"), CFG).alias("tier")).agg(
    F.count(F.lit(1)).alias("n")),
    f"SELECT {TIER_SQL.replace('score', 'semantic_score')} AS tier, count(*) AS n "
    "FROM verdicts GROUP BY 1", "verdicts")
