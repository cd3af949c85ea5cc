"""Sources, sinks, source specs and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.normalize import iso_z
from rolesift.functions.text import find_phrases
from rolesift.operators.companies import company_rows
from rolesift.operators.combine import broadcast_if_small
from rolesift.session import work_folder
from rolesift.sources import archive as A
from rolesift.sources.html_cards import Pick, anchor_cards, card_fields, extract_cards
from rolesift.sources.specs import SPECS, normalize_posting, normalize_source, sheet_jobs
from rolesift.streaming import ingest as ST
from catalog import bindings as B
from catalog.registry import add
from catalog.scalar_queries import assign_sql, iso_sql
from catalog.sqlgen import CFG

# Company facts the payloads carry, by the posting's customer.
META_SQL = "'co-' || CAST(ck AS VARCHAR)"
OUT = ["job_id", "title", "company", "url", "location", "description", "remote", "salary_min",
       "salary_max", "posted_at", "company_tier"]


def folder(spark: SparkSession) -> str:
    """New folder for this query below the cluster's shared one."""
    return f"{work_folder(spark).rstrip('/')}/rolesift-{uuid.uuid4().hex}"


def out(df: DataFrame) -> DataFrame:
    return df.withColumn("posted_at", iso_z(F.col("posted_at"))).select(*OUT)


def _slug() -> Column:
    return F.concat(F.lit("co-"), F.col("ck").cast("string"))


def _meta() -> Column:
    return F.struct(F.col("company").alias("name"), _slug().alias("ats_slug"),
                    F.col("company_tier").alias("tier"), F.lit("x").alias("industry"))


def spec_query(name: str, payload) -> None:
    """Query of a JSON spec: payloads made from every posting, normalised back."""
    def run(s: SparkSession, d: str) -> DataFrame:
        body = F.to_json(F.struct(*[c.alias(n) for n, c in payload().items()]))
        return out(normalize_source(B.postings(s, d).select(body.alias("payload")),
                                    SPECS[name], B.as_of()))
    return run


def expected(native: str, source: str, **over: str) -> str:
    """SQL of the postings a spec should produce."""
    values = {
        "title": "title", "company": "company", "url": "url", "location": "location",
        "description": "description", "remote": "NULL::BOOLEAN", "salary_min": "NULL::BIGINT",
        "salary_max": "NULL::BIGINT", "posted": "posted_at", "tier": "NULL::VARCHAR",
        "where": "title <> ''"} | over
    return f"""SELECT '{source}:' || {native} AS job_id, {values['title']} AS title,
      {values['company']} AS company, {values['url']} AS url,
      nullif({values['location']}, '') AS location,
      nullif({values['description']}, '') AS description, {values['remote']} AS remote,
      {values['salary_min']} AS salary_min, {values['salary_max']} AS salary_max,
      {iso_sql(values['posted'])} AS posted_at, {values['tier']} AS company_tier
    FROM postings, params WHERE {values['where']}"""


#: Payload of a posting, the SQL of its native id and of its result, by spec.
PAYLOADS: dict[str, tuple] = {}


def spec(key: str, name: str, payload, native: str, **over: str) -> None:
    PAYLOADS[name] = (payload, native, over)
    add(key, spec_query(name, payload), expected(native, name, **over), "params", "postings")


c = F.col
K = lambda: F.col("native_id")
DESC_HTML = lambda: F.concat(F.lit("<p>"), c("description"), F.lit("</p>"))
REMOTE_DEFAULT = "coalesce(nullif(location, ''), 'Remote')"
ISO = lambda: iso_z(c("posted_at"))
NZ = "CASE WHEN {0} <> 0 THEN {0} END"

spec("src_remoteok", "remoteok", lambda: {
    "id": c("k"), "position": F.when(c("k") % 2 == 0, c("title")),
    "title": c("title"), "company": c("company"), "apply_url": c("url"),
    "location": c("location"), "description": c("description"),
    "epoch": F.when(c("k") % 3 != 0, F.unix_timestamp("posted_at")), "date": ISO(),
    "salary_min": c("salary_min"), "salary_max": c("salary_max")},
    "native_id", location=REMOTE_DEFAULT, remote="TRUE", salary_min="salary_min",
    salary_max="salary_max")
spec("src_himalayas", "himalayas", lambda: {
    "guid": F.when(c("k") % 2 == 0, K()), "id": c("k"), "title": c("title"),
    "companyName": F.when(c("k") % 3 == 0, c("company")),
    "company_name": c("company"), "applicationLink": F.when(c("k") % 7 != 0, c("url")),
    "pubDate": F.unix_timestamp("posted_at"),
    "locationRestrictions": F.when(c("k") % 2 == 0, F.array(c("location"), F.lit("EU"))),
    "location": c("location"), "excerpt": c("description"), "minSalary": c("salary_min"),
    "salary_max": c("salary_max")},
    "native_id", remote="TRUE", salary_min="salary_min", salary_max="salary_max",
    location=f"CASE WHEN k % 2 = 0 THEN location || ', EU' ELSE {REMOTE_DEFAULT} END",
    where="title <> '' AND k % 7 <> 0")
spec("src_working_nomads", "working_nomads", lambda: {
    "id": F.when(c("k") % 2 == 0, c("k")), "title": c("title"), "company": c("company"),
    "url": F.concat(c("url"), F.lit("/")), "location": c("location"),
    "description": DESC_HTML(), "pub_date": ISO()},
    "native_id", title="trim(title)", url="url || '/'", location=REMOTE_DEFAULT,
    remote="TRUE", company="trim(company)", where="trim(title) <> ''")
spec("src_greenhouse", "greenhouse", lambda: {
    "id": c("k"), "title": c("title"), "absolute_url": c("url"),
    "location": F.struct(c("location").alias("name")), "content": DESC_HTML(),
    "updated_at": ISO(), "_company_meta": _meta()},
    f"{META_SQL} || ':' || native_id", title="trim(title)", tier="company_tier",
    where="trim(title) <> ''")
spec("src_lever", "lever", lambda: {
    "id": K(), "text": c("title"), "hostedUrl": c("url"),
    "categories": F.struct(c("location").alias("location")),
    "descriptionPlain": F.when(c("k") % 2 == 0, c("description")),
    "description": c("description"), "createdAt": F.unix_timestamp("posted_at") * 1000,
    "workplaceType": B.pick(["Remote", "onsite", "hybrid"], c("k") % 3),
    "_company_meta": _meta()},
    f"{META_SQL} || ':' || native_id", title="trim(title)", tier="company_tier",
    remote="CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END", where="trim(title) <> ''")
spec("src_ashby", "ashby", lambda: {
    "id": K(), "title": c("title"), "applyUrl": c("url"),
    "location": F.when(c("k") % 2 == 0, c("location")), "locationName": c("location"),
    "isRemote": c("remote"), "descriptionPlain": c("description"),
    "publishedAt": F.when(c("k") % 4 != 0, ISO()), "_company_meta": _meta()},
    f"{META_SQL} || ':' || native_id", title="trim(title)", tier="company_tier",
    remote="remote", posted="CASE WHEN k % 4 <> 0 THEN posted_at ELSE as_of END",
    where="trim(title) <> ''")
spec("src_smartrecruiters", "smartrecruiters", lambda: {
    "id": K(), "name": c("title"), "company": F.struct(c("company").alias("name")),
    "location": F.struct(F.when(c("k") % 2 == 0, c("location")).alias("fullLocation"),
                         F.lit("Springfield").alias("city"), F.lit("").alias("region"),
                         F.lit("us").alias("country"), c("remote").alias("remote")),
    "postingUrl": F.when(c("k") % 2 == 0, c("url")), "applyUrl": c("url"),
    "jobAd": F.struct(F.struct(
        F.struct(F.lit("<b>About</b>").alias("text")).alias("companyDescription"),
        F.struct(DESC_HTML().alias("text")).alias("jobDescription")).alias("sections")),
    "releasedDate": ISO(), "_company_meta": _meta()},
    f"{META_SQL} || ':' || native_id", title="trim(title)", tier="company_tier",
    remote="remote", description="'About ' || description",
    location="CASE WHEN k % 2 = 0 AND location <> '' THEN location ELSE 'Springfield, us' END",
    where="trim(title) <> ''")
spec("src_workday", "workday", lambda: {
    "title": c("title"), "externalPath": F.concat(F.lit("/job/x/"), K()),
    "locationsText": c("location"),
    "postedOn": F.concat(F.lit("Posted "), (c("k") % 40).cast("string"), F.lit(" Days Ago")),
    "bulletFields": F.when(c("k") % 2 == 0, F.array(F.concat(F.lit("R"), K()))),
    "_workday": F.struct(F.lit("https://wd.example").alias("base_url"),
                         F.lit("acme").alias("tenant"), F.lit("careers").alias("site")),
    "_company_meta": _meta()},
    "'acme:' || CASE WHEN k % 2 = 0 THEN 'R' ELSE '' END || native_id", title="trim(title)",
    url="'https://wd.example/careers/job/x/' || native_id", description="''",
    posted="as_of - to_days(CAST(k % 40 AS INTEGER))", tier="company_tier",
    where="trim(title) <> ''")
spec("src_linkedin_export", "apify_linkedin", lambda: {
    "jobId": F.when(c("k") % 2 == 0, K()), "title": c("title"), "companyName": c("company"),
    "jobUrl": F.concat(F.lit("https://www.linkedin.com/jobs/view/"), K(), F.lit("/")),
    "location": c("location"), "descriptionText": c("description"), "postedAt": ISO(),
    "salary": F.concat(F.lit("$"), c("salary_min").cast("string"), F.lit(" - $"),
                       c("salary_max").cast("string")),
    "workType": B.pick(["remote", "On-site", ""], c("k") % 3)},
    "native_id", title="trim(title)", url="'https://www.linkedin.com/jobs/view/' || native_id "
    "|| '/'", remote="CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE CASE WHEN "
    "contains(lower(location), 'remote') THEN TRUE END END",
    salary_min="CASE WHEN salary_min >= 20000 AND salary_max >= 20000 THEN salary_min END",
    salary_max="CASE WHEN salary_min >= 20000 AND salary_max >= 20000 THEN salary_max END",
    where="trim(title) <> ''")
spec("src_bettingjobs", "bettingjobs", lambda: {
    "uuid": K(), "job_title": c("title"), "company_name": F.when(c("k") % 5 != 0, c("company")),
    "URL": F.when(c("k") % 2 == 0, F.concat(F.lit("slug/"), K())),
    "job_body": DESC_HTML(), "location_label": c("location"),
    "location_state_code": F.when(c("k") % 4 == 0, "remote-france"),
    "pay_min_norm": F.lit(""), "pay_min": c("salary_min"), "pay_max_norm": c("salary_max"),
    "created_at": ISO()},
    "native_id", title="trim(title)", company="CASE WHEN k % 5 <> 0 THEN company ELSE "
    "'BettingJobs' END", url="'https://www.bettingjobs.com/jobs/' || CASE WHEN k % 2 = 0 THEN "
    "'slug/' ELSE '' END || native_id || '/'",
    remote="CASE WHEN k % 4 = 0 OR contains(lower(location), 'remote') THEN TRUE WHEN "
    "contains(lower(location), 'on-site') THEN FALSE END",
    salary_min="CASE WHEN salary_min >= 20000 THEN salary_min END",
    salary_max="CASE WHEN salary_max >= 20000 THEN salary_max END",
    where="trim(title) <> ''")

# --- feeds, lists, sheets, archive ----------------------------------------


def _feeds(s: SparkSession, d: str) -> DataFrame:
    """One RSS document per posting; every ninth is cut off and unreadable."""
    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), F.replace(value, F.lit("&"), F.lit("&amp;")),
                        F.lit(f"</{name}>"))
    item = F.concat(
        F.lit("<rss><channel><title>feed</title><item>"),
        tag("title", F.concat(c("company"), F.lit(": "), c("title"))),
        tag("link", c("url")), tag("description", c("description")),
        tag("region", c("location")),
        tag("pubDate", F.date_format("posted_at", "E, dd MMM yyyy HH:mm:ss '+0000'")),
        F.lit("</item>"))
    return B.postings(s, d).select("k", F.when(c("k") % 9 == 0, item).otherwise(
        F.concat(item, F.lit("</channel></rss>"))).alias("body"))


add("rss_scan", lambda s, d: A.read_rss(_feeds(s, d)).select("k", "title", "link", "region"),
    """SELECT k, trim(company || ': ' || title) AS title, url AS link,
    location AS region FROM postings WHERE k % 9 <> 0""", "postings")
add("src_weworkremotely", lambda s, d: out(normalize_source(A.read_rss(_feeds(s, d)).select(
    F.to_json(F.struct("title", "link", "description", "region", "pubDate"))
    .alias("payload")), SPECS["weworkremotely"], B.as_of())),
    expected("native_id", "weworkremotely", title="trim(title)", company="trim(company)",
             location=REMOTE_DEFAULT, remote="TRUE",
             where="trim(title) <> '' AND k % 9 <> 0"), "params", "postings")


def _lists(s: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit('[{"id": '), K(), F.lit(', "n": 1}, "skip", {"id": -'), K(),
                     F.lit("}]"))
    wrap = lambda name: F.concat(F.lit(f'{{"{name}": '), entry, F.lit("}"))
    body = F.when(c("k") % 5 == 0, entry).when(c("k") % 5 == 1, wrap("jobs")) \
        .when(c("k") % 5 == 2, wrap("data")).when(c("k") % 5 == 3, wrap("results")) \
        .otherwise(wrap("other"))
    return B.postings(s, d).select("k", body.alias("body"))


add("json_api_scan", lambda s, d: A.explode_payload(_lists(s, d)).select(
    "k", F.get_json_object("payload", "$.id").cast("bigint").alias("id")),
    """SELECT k, unnest([k, -k]) AS id FROM postings WHERE k % 5 <> 4""", "postings")


def _archived(s: SparkSession, d: str) -> DataFrame:
    root = folder(s)
    rows = B.postings(s, d).select("source", c("posted_at").alias("run_ts"), F.to_json(
        F.struct("job_id", "title")).alias("payload"))
    # One directory per source and year keeps the demonstration archive small.
    A.write_raw(rows.withColumn("run_ts", F.date_trunc("year", "run_ts")), root)
    return A.read_raw(s, root, ["lever", "ashby"], F.lit("1998-01-01").cast("timestamp"))


_ARCHIVE = """SELECT source, job_id, CAST(year(posted_at) AS BIGINT) AS y FROM postings
  WHERE source IN ('lever', 'ashby') AND posted_at >= TIMESTAMP '1998-01-01'"""
add("raw_archive_read", lambda s, d: _archived(s, d).select(
    "source", F.get_json_object("payload", "$.job_id").alias("job_id"),
    c("y").cast("bigint").alias("y")), _ARCHIVE, "postings")
add("raw_archive_write", lambda s, d: _archived(s, d).groupBy("source", "y").agg(
    F.count(F.lit(1)).alias("n"), F.countDistinct("run_ts").alias("runs")).select(
    "source", c("y").cast("bigint").alias("y"), "n", "runs"),
    """SELECT source, CAST(year(posted_at) AS BIGINT) AS y, count(*) AS n,
    count(DISTINCT date_trunc('year', posted_at)) AS runs FROM postings WHERE source IN
    ('lever', 'ashby') AND posted_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2""", "postings")


def _sheet(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    B.postings(s, d).select(
        c("company").alias("Employer"), F.nullif(c("title"), F.lit("")).alias("Job Title"),
        F.nullif(c("location"), F.lit("")).alias("City"), c("url").alias("Apply Link"),
        c("description").alias("Notes"), ISO().alias("Date Added"), c("k").alias("Ref")) \
        .write.option("header", True).option("escape", '"').csv(f"{path}/sheet")
    return A.read_sheet(s, f"{path}/sheet")


add("csv_sheet_scan", lambda s, d: _sheet(s, d).select(
    c("ref").cast("bigint").alias("k"), c("employer").alias("company"),
    F.trim("job title").alias("title"), c("apply link").alias("url")),
    "SELECT k, company, nullif(trim(title), '') AS title, url FROM postings", "postings")
add("src_sheet", lambda s, d: out(normalize_posting(
    sheet_jobs(_sheet(s, d)), "asgc_sheet", B.as_of())),
    expected("native_id", "asgc_sheet", title="trim(title)", company="trim(company)",
             where="trim(title) <> ''"), "params", "postings")


def _stories(s: SparkSession, d: str) -> DataFrame:
    """One story per customer with its orders as children; every second one is hiring."""
    return B.postings(s, d).groupBy(c("ck").alias("story_id")).agg(
        F.max(F.struct("posted_at", "k")).alias("created_at"),
        F.collect_list(F.struct(c("k").alias("id"), c("title").alias("text"),
                                c("posted_at").alias("created_at"))).alias("children")) \
        .withColumn("title", F.when(c("story_id") % 2 == 0, "Ask: Who is HIRING? ")
                    .otherwise("Who wants to be hired?"))


add("thread_children_scan", lambda s, d: A.explode_thread(_stories(s, d)).select(
    "story_id", "id", "text"),
    """WITH newest AS (SELECT ck FROM postings WHERE ck % 2 = 0
      ORDER BY posted_at DESC, k DESC LIMIT 1)
    SELECT ck AS story_id, k AS id, title AS text FROM postings WHERE title <> ''
      AND ck = (SELECT ck FROM newest)""", "postings")
add("ats_company_scan", lambda s, d: A.with_company_meta(
    B.postings(s, d).select("job_id", _slug().alias("ats_slug")), B.companies(s, d), "lever")
    .select("job_id", "ats_slug", F.col("company_meta.tier").alias("tier")),
    """SELECT job_id, c.ats_slug, c.tier FROM postings p JOIN companies c ON
    c.ats_slug = 'co-' || CAST(p.ck AS VARCHAR) WHERE c.ats_type = 'lever'""",
    "postings", "companies")
add("html_listing_scan", lambda s, d: extract_cards(
    B.table(s, d, "pages"), r"^/[A-Za-z]", "https://site.example").select(
    "href", "url", "page_id", c("pos").cast("bigint").alias("pos")),
    """SELECT href, 'https://site.example' || href AS url, page_id, CAST(pos - 1 AS BIGINT)
      AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS rn
      FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS pos
        FROM (SELECT page_id, regexp_extract_all(html,
          '(?s)<a\\s[^>]*?href=["'']([^"'']*)["''][^>]*>.*?</a>', 1) AS l FROM pages))
      WHERE regexp_matches(href, '^/[A-Za-z]')) WHERE rn = 1""")
add("page_anchors", lambda s, d: anchor_cards(
    B.table(s, d, "pages").select("page_id", "html")).groupBy("page_id").agg(
    F.count(F.lit(1)).alias("n")),
    """SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html,
    '(?s)<a\\s[^>]*?href=["'']([^"'']*)["''][^>]*>.*?</a>', 1)) FROM pages) GROUP BY 1""")


def _dictionary_counts(s: SparkSession, d: str) -> DataFrame:
    """Postings per dictionary bucket: one pass over each text, then an equality join."""
    words = CFG.to_df(s)
    known = [p for kind in (CFG.positive_signals, CFG.industry_keywords, CFG.keywords,
                            CFG.qol_keywords, CFG.company_groups)
             for phrases in kind.values() for p in phrases]
    known += CFG.function_titles + CFG.seniority_titles + CFG.unpaid_phrases \
        + CFG.priority_titles + CFG.leadership_exceptions
    text = F.lower(F.concat_ws(" ", "title", "description"))
    hits = B.postings(s, d).select("job_id", F.explode(find_phrases(text, known))
                                   .alias("phrase"))
    return hits.join(broadcast_if_small(words), "phrase").groupBy("kind", "bucket").agg(
        F.countDistinct("job_id").alias("postings"))


def _dictionary_sql() -> str:
    rows = []
    for kind in ("positive_signals", "industry_keywords", "keywords", "qol_keywords",
                 "company_groups"):
        rows += [(kind, b, p) for b, ps in getattr(CFG, kind).items() for p in ps]
    for kind in ("function_titles", "seniority_titles", "unpaid_phrases", "priority_titles",
                 "leadership_exceptions"):
        rows += [(kind, kind, p) for p in getattr(CFG, kind)]
    values = ", ".join(f"({B.q(a)}, {B.q(b)}, {B.q(p)})" for a, b, p in rows)
    return f"""SELECT kind, bucket, count(DISTINCT job_id) AS postings FROM
      (SELECT job_id, lower(title || ' ' || description) AS t FROM postings)
      JOIN (VALUES {values}) w(kind, bucket, phrase) ON contains(t, phrase) GROUP BY 1, 2"""


add("config_dict_scan", _dictionary_counts, _dictionary_sql(), "postings")
add("company_dim_load", lambda s, d: company_rows(s, [
    {"name": "Acme", "tier": 1, "ats": "lever", "ats_slug": "acme"}, {"name": " "},
    {"name": "ACME", "tier": "S"}, {"name": "Customer#000000007", "tier": 2}])
    .drop("industry").join(
    B.companies(s, d).select("company_name_normalized", "industry"),
    "company_name_normalized", "full_outer").select(
    "company_name_normalized", "company_name", "tier", "industry"),
    """SELECT company_name_normalized, CASE WHEN ck = 7 THEN company_name END AS company_name,
      CASE WHEN ck = 7 THEN '2' END AS tier, industry FROM companies
    UNION ALL SELECT 'acme', 'ACME', 'S', NULL""", "companies")

# --- listing cards ---------------------------------------------------------

TITLE = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"
LOC_REMOTE = "CASE WHEN contains(lower(location), 'remote') THEN TRUE {} END"
ONSITE = "WHEN contains(lower(location), 'on-site') THEN FALSE"


#: Link, html and SQL of a card, by spec.
CARDS: dict[str, tuple] = {}
ORACLE_OF: dict[str, str] = {}


def card(key: str, name: str, href, html, native: str, **over: str) -> None:
    """Query of a card spec: cards made from every posting, read back."""
    CARDS[name] = (href, html)
    def run(s: SparkSession, d: str) -> DataFrame:
        p = B.postings(s, d)
        cards = p.select(href().alias("href"), c("url").alias("url"),
                         F.concat(*[x if isinstance(x, Column) else F.lit(x)
                                    for x in html()]).alias("card_html"))
        return out(normalize_source(cards, SPECS[name], B.as_of()))
    base = {"title": TITLE, "description": "''", "posted": "as_of",
            "where": "trim(title) <> ''"} | over
    ORACLE_OF[name] = expected(native, name, **base)
    add(key, run, ORACLE_OF[name], "params", "postings")


def _path(prefix: str, tail: str = ""):
    return lambda: F.concat(F.lit(prefix), K(), F.lit(tail))


card("src_hitmarker", "hitmarker", _path("/jobs/", "/"), lambda: [
    "<a><img src='x' alt='", c("company"), " logo'><span class='x font-bold'>", c("title"),
    "</span><div><p>", c("location"), "</p></div><p>Full time</p></a>"],
    "native_id", remote=LOC_REMOTE.format(""), location="CASE WHEN "
    "contains(lower(location), 'remote') OR regexp_matches(location, ',\\s*[A-Z]{2}\\b|"
    ",\\s*[A-Z][a-z]+') THEN location END")
_STATE = "CASE WHEN contains(lower(location), 'remote') OR regexp_matches(location, " \
         "',\\s*[A-Z]{2}\\b') THEN location END"
card("src_wellfound", "wellfound", lambda: F.when(c("k") % 2 == 0, F.concat(
    F.lit("/company/acme-labs/jobs/"), K(), F.lit("-x"))).otherwise(
    F.concat(F.lit("/jobs/"), K(), F.lit("-x"))), lambda: [
    "<a><h2>", c("title"), "</h2><span>", c("location"), "</span><span>", c("company"),
    "</span></a>"], "native_id", location=_STATE, remote=LOC_REMOTE.format(""),
    company=f"CASE WHEN k % 2 = 0 THEN 'Acme Labs' WHEN ({_STATE}) IS NULL AND location <> '' "
            "THEN location ELSE company END")
card("src_wttj", "welcometothejungle", lambda: F.concat(
    F.lit("/en/companies/acme-labs/jobs/j"), K(), F.lit("?q=1")), lambda: [
    "<a><h4>", c("title"), "</h4><p>", F.when(c("k") % 2 == 0, c("company")).otherwise(""),
    "</p><p>", c("location"), "</p></a>"], "'acme-labs:j' || native_id", location=_STATE,
    remote=LOC_REMOTE.format(""),
    company=f"CASE WHEN k % 2 = 0 THEN company WHEN ({_STATE}) IS NULL AND location <> '' "
            "THEN location ELSE 'Acme Labs' END")
card("src_builtin", "builtinnyc", _path("/job/x/"), lambda: [
    "<div><a data-id='job-card-title'>", c("title"), "</a><img data-id='company-img' alt='",
    c("company"), " Logo'><div class='bounded-attribute-section'><div>"
    "<div><i class='fa-regular fa-house-building'></i></div><span>Hybrid</span></div><div>"
    "<div><i class='fa-location-dot'></i></div><span>", c("location"),
    "</span></div></div></div>"], "native_id",
    location="CASE WHEN location = '' THEN 'Hybrid' ELSE 'Hybrid, ' || location END",
    remote=LOC_REMOTE.format(""))
card("src_fractional", "fractional_jobs", _path("/jobs/"), lambda: [
    "<div><div class='job-item_name_url'><h3>", c("company"), "</h3><h3>-</h3><h3>", c("title"),
    "</h3></div><div class='job-item_more-info'><p>10h</p><p>", c("location"),
    "</p></div></div>"], "native_id", location="CASE WHEN location = '' THEN '10h' ELSE "
    "location END", remote=LOC_REMOTE.format(ONSITE), where="TRUE",
    title=f"CASE WHEN trim(title) = '' THEN company || ' -' ELSE {TITLE} END",
    company="CASE WHEN trim(title) = '' THEN '10h' ELSE company END")
card("src_game_jobs_uk", "game_jobs_uk", _path("/vacancy/"), lambda: [
    "<article><h3>", c("company"), "</h3><h4>", c("title"), "</h4><span class='z'>a - b</span>"
    "<span>", c("location"), " - UK</span><span>",
    B.pick(["Remote", "Hybrid", "Onsite"], c("k") % 3), "</span><i class='local-date'>",
    F.date_format("posted_at", "dd.MM.yyyy"), "</i></article>"], "native_id",
    location="CASE WHEN location <> '' THEN location || ' - UK' WHEN k % 3 = 0 THEN 'Remote' "
             "END", posted="posted_at",
    remote="CASE k % 3 WHEN 0 THEN TRUE WHEN 2 THEN FALSE ELSE CASE WHEN "
           "contains(lower(location), 'remote') THEN TRUE END END",
    where="trim(title) <> ''")
card("src_games_career", "games_career", _path("/Joboffer/", "/x"), lambda: [
    "<div><h3><span itemprop='title'>", c("title"), "</span></h3><div "
    "itemprop='hiringOrganization'><b itemprop='name'>", c("company"), "</b> GmbH</div><div "
    "itemprop='jobLocation'><i itemprop='addressLocality'>", c("location"), "</i><i "
    "itemprop='addressCountry'>", F.when(c("k") % 2 == 0, "Germany").otherwise(""),
    "</i></div><time itemprop='datePosted' datetime='", F.date_format("posted_at",
                                                                      "yyyy-MM-dd"),
    "'>x</time></div>"], "native_id", posted="posted_at", remote=LOC_REMOTE.format(""),
    location="CASE WHEN k % 2 = 0 AND location <> '' THEN location || ', Germany' WHEN "
             "k % 2 = 0 THEN 'Germany' ELSE location END")
card("src_games_jobs_direct", "games_jobs_direct", _path("/job/some-studio/lead/"), lambda: [
    "<a><h4 class='job-title'>", c("title"), "</h4>", F.when(c("k") % 2 == 0, F.concat(
        F.lit("<div title='Posted by "), c("company"), F.lit("'></div>"))).otherwise(""),
    "<p class='job-location'>", c("location"), "</p><div class='job-desc'>", c("description"),
    "</div></a>"], "native_id", description="description",
    company="CASE WHEN k % 2 = 0 THEN company ELSE 'Some Studio' END",
    remote="CASE WHEN contains(lower(location || ' ' || description), 'remote') THEN TRUE WHEN "
           "contains(lower(location || ' ' || description), 'on-site') THEN FALSE END")
card("src_gamesindustry", "gamesindustry", _path("/job/"), lambda: [
    "<article><h2><a>", c("title"), "</a></h2>", F.when(c("k") % 2 == 0, F.concat(
        F.lit("<span class='recruiter-company'>"), c("company"), F.lit("</span>"))).otherwise(
        F.concat(F.lit("<picture title='"), c("company"), F.lit("'></picture>"))),
    "<span class='location'>", c("location"), "</span><span class='date'>",
    F.date_format("posted_at", "d MMM yyyy"), ",</span></article>"], "native_id",
    posted="posted_at", remote=LOC_REMOTE.format(ONSITE))
card("src_ingamejob", "ingamejob", _path("/en/job/j-"), lambda: [
    "<div><h5><a>", c("title"), "</a></h5><strong><i class='la la-building-o'></i>",
    c("company"), "</strong><p><i class='la la-map-marker'></i> ", c("location"),
    "</p><p><i class='la la-briefcase'></i> Full time</p></div>"], "'j-' || native_id",
    description="'Full time'", remote=LOC_REMOTE.format(ONSITE))
card("src_outscal", "outscal", _path("/job/x-"), lambda: [
    "<a>", F.when(c("k") % 2 == 0, F.concat(F.lit("<h3>"), c("title"), F.lit("</h3>")))
    .otherwise(F.concat(F.lit("<img alt='"), c("title"), F.lit("'>"))),
    "<p class='a font-medium line-clamp-1'>", c("company"), "</p><p class='line-clamp-1'>",
    c("location"), "</p></a>"], "'x-' || native_id", remote=LOC_REMOTE.format(ONSITE))
card("src_remote_game_jobs", "remote_game_jobs", _path("/jobs/"), lambda: [
    "<div><a title='", c("company"), " is hiring ", c("title"), " (Remote Job)'>x</a>",
    F.when(c("k") % 2 == 0, F.concat(F.lit("<strong class='f-20'>"), c("title"),
                                     F.lit("</strong><small class='f-15'>"), c("company"),
                                     F.lit("</small>"))).otherwise(""),
    "<span class='tag'>Unity</span><span class='tag'>", c("location"), "</span></div>"],
    "native_id", location="'Remote'", remote="TRUE",
    description="CASE WHEN location = '' THEN 'Unity' ELSE 'Unity, ' || location END")
card("src_work_with_indies", "work_with_indies", _path("/careers/"), lambda: [
    "<a class='job-card'><img class='company-logo' alt='",
    F.when(c("k") % 2 == 0, c("company")).otherwise(""), "'><div class='text-block-14'>",
    c("title"), "</div><b class='bold job-card-text'>", c("company"), "</b><b class='bold'>",
    c("location"), "</b></a>"], "native_id", remote=LOC_REMOTE.format(ONSITE))

# --- discussion threads ----------------------------------------------------


def _comments(s: SparkSession, d: str) -> DataFrame:
    return B.postings(s, d).select(
        c("k").alias("comment_id"), c("posted_at").alias("created_at"),
        F.concat(F.lit("<p>"), c("company"), F.lit(" | "), c("title"), F.lit(" | "),
                 c("location"), F.lit("</p> ask for &lt;us&gt;. "), c("description"))
        .alias("text"))


def _thread(s: SparkSession, d: str) -> DataFrame:
    from rolesift.sources.thread import normalize_thread
    return normalize_thread(_comments(s, d), B.as_of())


_COMMENT = ("(SELECT k, trim(regexp_replace(company || ' | ' || title || ' | ' || location || "
            "'  ask for <us>. ' || description, '\\s+', ' ', 'g')) AS t FROM postings)")
add("src_hn_thread", lambda s, d: _thread(s, d).select(
    "job_id", "company", "title", "location", "remote"),
    f"""SELECT 'hnhiring:' || native_id AS job_id, company, title, location, remote
    FROM ({assign_sql(_COMMENT, 'NULL')})""", "postings")

# --- pages to postings ----------------------------------------------------


def _listing(s: SparkSession, d: str, name: str) -> DataFrame:
    """Pages of ten cards, each in its container; every page also repeats the first ten cards."""
    href, html = CARDS[name]
    body = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in html()])
    cards = B.postings(s, d).select(
        "k", F.concat(F.lit("<section class='hit new'><a href='"), href(), F.lit("'></a>"), body,
                      F.lit("<br></section>")).alias("html"))
    pages = cards.groupBy(F.expr("k div 10").alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("k", "html"))).alias("cards"))
    whole = F.array_join(F.transform("cards", lambda e: e["html"]), "\n")
    return pages.select("page_id", F.concat(F.lit("<html><body><div><p>open<div>"), whole,
                                            F.lit("</span></div>"), whole).alias("html"))


def pages_query(key: str, name: str) -> None:
    box = Pick(tags=("section",), cls=r"\bhit\b")

    def run(s: SparkSession, d: str) -> DataFrame:
        fields = card_fields(_listing(s, d, name), box, "/", "https://example.com/jobs",
                             SPECS[name].picks)
        return normalize_source(fields, SPECS[name], B.as_of()).select("job_id", "title", "company",
                                                                       "location")
    add(key, run, f"SELECT job_id, title, company, location FROM ({ORACLE_OF[name]})",
        "params", "postings")


pages_query("pages_game_jobs_uk", "game_jobs_uk")
pages_query("pages_games_career", "games_career")

# --- streaming -------------------------------------------------------------


def _land(s: SparkSession, d: str) -> str:
    """Payload files of every posting, the first half of the sources delivered twice."""
    root = folder(s)
    rows = B.postings(s, d).select(
        "source", c("posted_at").alias("run_ts"), F.to_json(F.struct(
            c("k").alias("id"), c("title"), c("company"), c("url"), c("location"),
            c("description"))).alias("payload"))
    rows.write.mode("append").json(f"{root}/landed")
    rows.where("source IN ('lever', 'ashby', 'greenhouse')").write.mode("append").json(
        f"{root}/landed")
    return root


def _stream_ingest(s: SparkSession, d: str) -> DataFrame:
    root = _land(s, d)

    def normalize(batch: DataFrame) -> DataFrame:
        return normalize_source(batch, SPECS["remoteok"], B.as_of())

    for _ in range(2):  # the second start finds nothing new and changes nothing
        ST.stream_merge(ST.read_landed(s, f"{root}/landed"), normalize, f"{root}/merged",
                        f"{root}/progress", buckets=8).awaitTermination()
    return ST.read_merged(s, f"{root}/merged")


add("stream_ingest", lambda s, d: _stream_ingest(s, d).select("job_id", "title", "company",
                                                              "status"),
    "SELECT 'remoteok:' || native_id AS job_id, title, company, 'active' AS status "
    "FROM postings WHERE title <> ''", "postings")


def _stream_dedup(s: SparkSession, d: str) -> DataFrame:
    root = _land(s, d)
    stream = ST.read_landed(s, f"{root}/landed").select(
        F.concat("source", F.lit(":"), F.get_json_object("payload", "$.id")).alias("job_id"),
        c("run_ts").alias("scraped_at"))
    query = ST.dedup_deliveries(stream, "4000 days").writeStream.format("parquet") \
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{root}/out")


add("stream_dedup", lambda s, d: _stream_dedup(s, d).select("job_id"),
    "SELECT job_id FROM postings", "postings")
add("stream_run_counts", lambda s, d: ST.run_counts(B.runs(s, d), streaming=False).withColumn(
    "day", iso_z(c("day"))),
    f"""SELECT {iso_sql("date_trunc('day', run_timestamp)::TIMESTAMP")} AS day, source_name,
    count(*) AS runs, CAST(sum(jobs_new) AS BIGINT) AS jobs_new,
    CAST(sum(jobs_updated) AS BIGINT) AS jobs_updated FROM runs GROUP BY 1, 2""", "runs")
