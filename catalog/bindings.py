"""The driver tables seen as postings, verdicts, runs and companies.

Every view exists twice: as a Spark DataFrame and as a DuckDB common table expression, so
each operator can be compared with independent SQL at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01 00:00:00"

SOURCES = ["greenhouse", "lever", "ashby", "apify_linkedin", "remoteok", "workday"]
SUFFIXES = [" Inc.", ", LLC", " (CX)", ""]
TITLES = [
    "VP of Product", "Senior Data Analyst", "Marketing Intern", "Senior Software Engineer",
    "Senior Engineering Manager", "Associate 3D Design Director",
    "Director of Product - Ads Performance", "Interim CTO", "Fractional Chief Product Officer",
    "Operating Partner, Platform", "Senior Manager, Strategy", "VP, Live Service",
    "Associate Vice President, Technology", "Principal Software Engineer",
    "Payments Lead (Contract)", "International Operations Director",
    "Machine Learning Engineer", "Head of Engineering", "Junior Designer",
    "Technical Program Manager", "Board Advisor", "  VP   of  Product ", "", "Data Engineer",
]
LOCATIONS = [
    "Remote, United States", "New York, NY", "Hybrid, NYC", "Jersey City, NJ",
    "On-site in Seattle", "London, UK", "Austin, TX", "", "San Francisco, CA", "Remote (US)",
    "Berlin, Germany", "Hoboken NJ",
]
SNIPPETS = [
    "Own corporate strategy and M&A integration for a growth strategy team.",
    "Write production code daily with pair programming and live coding.",
    "A fast-paced group that will hustle and wear many hats.",
    "RSU grants, parental leave and a 401k are part of the offer.",
    "Expect travel up to 60% across regions.",
    "Some travel 25% of the time.",
    "This is an unpaid, equity only engagement.",
    "Series B company with on-call 24/7 rotation.",
    "The role reports to CEO with global scope.",
    "Live service platform with matchmaking and live ops at scale.",
    "A trading card game and esports studio.",
    "5 days in office, no remote.",
]
TIERS = {"MACHINERY": "S", "BUILDING": "1", "AUTOMOBILE": "2"}
INDUSTRY_BY_KEY = [
    "gaming_publisher_platform", "digital_tcg_ccg", "immersive_lbe",
    "gaming_b2b_infrastructure", "music_tech", "gaming_accessibility_nonprofit",
    "streaming_media", "analyst_firm", "gaming_vc_pe_operating", "sports_betting_tech",
    "science_education_nonprofit", "hospitality_tech", "defense_simulation",
    "general_enterprise_tech", "adtech_martech", "crypto_web3",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined with their customer, one posting per order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("bigint")
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("k"), F.col("c_custkey").alias("ck"),
        pick(SOURCES, k % 6).alias("source"), k.cast("string").alias("native_id"),
        pick(TITLES, k % 24).alias("title"),
        F.concat("c_name", pick(SUFFIXES, k % 4)).alias("company"),
        F.lower("c_name").alias("company_normalized"),
        pick(LOCATIONS, F.expr("(o_orderkey div 24) % 12")).alias("location"),
        F.concat(pick(SNIPPETS, k % 12), F.lit(" "),
                 pick(SNIPPETS, F.expr("(o_orderkey div 12) % 12"))).alias("description"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("remote"),
        F.when(k % 5 != 0, price).alias("salary_min"),
        F.when(k % 7 != 0, price + 40000).alias("salary_max"),
        F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        F.col("o_orderdate").cast("timestamp").alias("scraped_at"),
        F.when(F.col("o_orderstatus") == "O", "active")
        .when(F.col("o_orderstatus") == "F", "archived").otherwise("saved").alias("status"),
        F.try_element_at(tier, F.col("c_mktsegment")).alias("company_tier"),
        F.concat(F.lit("https://example.com/jobs/"), k.cast("string")).alias("url"),
        pick(["remote", "hybrid", "onsite"], k % 4 % 3).alias("_m"),
    )
    return rows.withColumns({
        "job_id": F.concat("source", F.lit(":"), "native_id"),
        "work_mode": F.when(F.col("k") % 4 != 3, F.col("_m")),
        "user_notes": F.when(F.col("k") % 10 == 0, F.concat(F.lit("note "), F.col("native_id"))),
    }).drop("_m")


def _array(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    """DuckDB list literal."""
    return _array(values) if values else "[]::VARCHAR[]"


CTE = {
    "params": f"params AS (SELECT TIMESTAMP '{AS_OF}' AS as_of)",
    "postings": f"""postings AS (
  SELECT *, source || ':' || native_id AS job_id,
         CASE WHEN k % 10 = 0 THEN 'note ' || native_id END AS user_notes
  FROM (
    SELECT o_orderkey AS k, c_custkey AS ck,
      list_extract({_array(SOURCES)}, CAST(o_orderkey % 6 + 1 AS INTEGER)) AS source,
      CAST(o_orderkey AS VARCHAR) AS native_id,
      list_extract({_array(TITLES)}, CAST(o_orderkey % 24 + 1 AS INTEGER)) AS title,
      c_name || list_extract({_array(SUFFIXES)}, CAST(o_orderkey % 4 + 1 AS INTEGER))
        AS company,
      lower(c_name) AS company_normalized,
      list_extract({_array(LOCATIONS)}, CAST((o_orderkey // 24) % 12 + 1 AS INTEGER))
        AS location,
      list_extract({_array(SNIPPETS)}, CAST(o_orderkey % 12 + 1 AS INTEGER)) || ' ' ||
        list_extract({_array(SNIPPETS)}, CAST((o_orderkey // 12) % 12 + 1 AS INTEGER))
        AS description,
      CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS remote,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END
        AS salary_min,
      CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) + 40000 END
        AS salary_max,
      o_orderdate AS posted_at, o_orderdate AS scraped_at,
      CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'archived' ELSE 'saved' END
        AS status,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'S' WHEN 'BUILDING' THEN '1'
        WHEN 'AUTOMOBILE' THEN '2' END AS company_tier,
      'https://example.com/jobs/' || CAST(o_orderkey AS VARCHAR) AS url,
      CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END
        AS work_mode
    FROM orders JOIN customer ON o_custkey = c_custkey) )""",
    "companies": f"""companies AS (
  SELECT c_custkey AS ck, lower(c_name) AS company_name_normalized, c_name AS company_name,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'S' WHEN 'BUILDING' THEN '1'
      WHEN 'AUTOMOBILE' THEN '2' END AS tier,
    CASE WHEN c_custkey % 4 <> 0 THEN list_extract({_array(INDUSTRY_BY_KEY)},
      CAST(c_custkey % 16 + 1 AS INTEGER)) END AS industry,
    c_custkey % 7 = 0 AS equality, c_custkey % 11 = 0 AS crunch,
    c_custkey % 22 = 0 AS crunch_reduced,
    CASE c_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END
      AS ats_type,
    CASE WHEN c_custkey % 5 <> 0 THEN 'co-' || CAST(c_custkey AS VARCHAR) END AS ats_slug
  FROM customer)""",
    "verdicts": """verdicts AS (
  SELECT list_extract(['greenhouse','lever','ashby','apify_linkedin','remoteok','workday'],
      CAST(l_orderkey % 6 + 1 AS INTEGER)) || ':' || CAST(l_orderkey AS VARCHAR) AS job_id,
    l_orderkey AS k, CAST(sum(l_quantity) AS INTEGER) % 101 AS semantic_score,
    'Rationale for ' || CAST(l_orderkey AS VARCHAR) AS semantic_rationale,
    max(l_shipdate) AS semantic_scored_at, 'scorer-1' AS semantic_model,
    CASE l_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite'
      ELSE 'unclear' END AS verdict_work_mode,
    CASE l_orderkey % 3 WHEN 1 THEN 'strong' ELSE 'partial' END AS role_family_match,
    'partial' AS industry_match,
    CASE WHEN l_orderkey % 5 = 0 THEN 'unreachable' WHEN l_orderkey % 5 <= 2 THEN 'reachable'
      ELSE 'unclear' END AS geography_match,
    'match' AS level_match, l_orderkey % 4 = 0 AS watchlist_dream
  FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey)""",
    "runs": """runs AS (
  SELECT event_id AS run_id, event_type AS source_name, ts AS run_timestamp,
    CASE WHEN value < 69 THEN 'ok' WHEN value < 113 THEN 'partial' ELSE 'error' END AS status,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS jobs_found,
    CAST(json_extract_string(props, '$.k') AS BIGINT) // 2 AS jobs_new,
    CAST(json_extract_string(props, '$.k') AS BIGINT)
      - CAST(json_extract_string(props, '$.k') AS BIGINT) // 2 AS jobs_updated,
    CAST(floor(value * 1000) AS BIGINT) AS duration_ms,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 30 * 86400 AS expires_at
  FROM events)""",
}


def sql(body: str, *ctes: str) -> str:
    """Statement with the named view definitions in front."""
    if not ctes:
        return body
    defs = [CTE[c] for c in ctes]
    lead = body.lstrip()
    if lead.upper().startswith("WITH "):
        return "WITH " + ",\n".join(defs) + ",\n" + lead[5:]
    return "WITH " + ",\n".join(defs) + "\n" + body


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    tier = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    return c.select(
        k.alias("ck"), F.lower("c_name").alias("company_name_normalized"),
        F.col("c_name").alias("company_name"),
        F.try_element_at(tier, F.col("c_mktsegment")).alias("tier"),
        F.when(k % 4 != 0, pick(INDUSTRY_BY_KEY, k % 16)).alias("industry"),
        (k % 7 == 0).alias("equality"), (k % 11 == 0).alias("crunch"),
        (k % 22 == 0).alias("crunch_reduced"),
        pick(["greenhouse", "lever", "ashby"], k % 3).alias("ats_type"),
        F.when(k % 5 != 0, F.concat(F.lit("co-"), k.cast("string"))).alias("ats_slug"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    g = li.where(k % 3 != 0).groupBy(k).agg(
        (F.sum("l_quantity").cast("int") % 101).alias("semantic_score"),
        F.max("l_shipdate").cast("timestamp").alias("semantic_scored_at"))
    return g.select(
        F.concat(pick(SOURCES, k % 6), F.lit(":"), k.cast("string")).alias("job_id"),
        k.alias("k"), "semantic_score",
        F.concat(F.lit("Rationale for "), k.cast("string")).alias("semantic_rationale"),
        "semantic_scored_at", F.lit("scorer-1").alias("semantic_model"),
        pick(["remote", "hybrid", "onsite", "unclear"], k % 4).alias("verdict_work_mode"),
        F.when(k % 3 == 1, "strong").otherwise("partial").alias("role_family_match"),
        F.lit("partial").alias("industry_match"),
        F.when(k % 5 == 0, "unreachable").when(k % 5 <= 2, "reachable").otherwise("unclear")
        .alias("geography_match"),
        F.lit("match").alias("level_match"), (k % 4 == 0).alias("watchlist_dream"),
        F.array(F.concat(F.lit("concern "), (k % 9).cast("string"))).alias("life_fit_concerns"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = F.get_json_object("props", "$.k").cast("bigint")
    half = F.expr("cast(get_json_object(props, '$.k') as bigint) div 2")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("source_name"),
        F.col("ts").cast("timestamp").alias("run_timestamp"),
        F.when(F.col("value") < 69, "ok").when(F.col("value") < 113, "partial")
        .otherwise("error").alias("status"),
        found.alias("jobs_found"), half.alias("jobs_new"), (found - half).alias("jobs_updated"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        (F.unix_timestamp("ts") + 30 * 86400).alias("expires_at"))
