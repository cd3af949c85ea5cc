"""Substring dictionaries, stored indexes and bucketed tables over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.normalize import iso_z, score_posted
from rolesift.functions.text import text_or_empty
from rolesift.operators import layouts as L
from rolesift.operators import substrings as SS
from catalog import bindings as B
from catalog.registry import add
from catalog.browse_queries import SCORED, scored
from catalog.scalar_queries import iso_sql
from catalog.source_queries import folder

c = F.col

# --- substrings -----------------------------------------------------------
# Ten phrases of 4 to 12 characters are cut from each document, spaces included.
_PHRASE = "substr({text}, 1 + ({id} * 37) % 400 + 7 * {j}, 4 + ({id} + {j}) % 9)"


def _phrases(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    cut = F.expr(_PHRASE.format(text="text", id="CAST(doc_id AS INT)", j="j"))
    return rows.select(cut.alias("phrase")).where("phrase <> ''").distinct()


add("join_substrings", lambda s, d: SS.substring_counts(
    B.table(s, d, "documents"), _phrases(s, d), "doc_id", "text").select(
    "phrase", "texts", c("first").alias("first_doc")),
    f"""WITH phrases AS (SELECT DISTINCT phrase FROM (SELECT {_PHRASE.format(
        text='text', id='doc_id', j='j')} AS phrase FROM documents, range(10) t(j))
      WHERE phrase <> '')
    SELECT phrase, count(*) AS texts, min(doc_id) AS first_doc
    FROM phrases JOIN documents ON contains(text, phrase) GROUP BY phrase""")
add("join_substrings_titles", lambda s, d: SS.substring_matches(
    B.postings(s, d).select("job_id", F.lower("title").alias("text")),
    s.createDataFrame([("intern",), ("vp",), (" of ",), ("d",), ("lead (",), ("zzz",)],
                      "phrase string"), "job_id", "text"),
    """SELECT job_id, phrase FROM postings JOIN (VALUES ('intern'), ('vp'), (' of '), ('d'),
    ('lead ('), ('zzz')) p(phrase) ON contains(lower(title), phrase)""", "postings")


def _hay():
    return F.lower(F.concat_ws(" ", *[text_or_empty(c(n)) for n in ("title", "company",
                                                                    "location")]))


def _search(s: SparkSession, d: str, needle: str) -> DataFrame:
    root = folder(s)
    SS.build_gram_index(B.postings(s, d), "job_id", _hay(), root)
    return SS.search_gram_index(s, root, needle).withColumnRenamed("id", "job_id")


add("search_index", lambda s, d: _search(s, d, "new york").select("job_id", c("text").alias("hay")),
    """SELECT job_id, hay FROM (SELECT job_id, lower(title || ' ' || company || ' ' || location)
    AS hay FROM postings) WHERE contains(hay, 'new york')""", "postings")
add("search_index_short", lambda s, d: _search(s, d, "vp").select("job_id"),
    """SELECT job_id FROM postings
    WHERE contains(lower(title || ' ' || company || ' ' || location), 'vp')""", "postings")

# --- index tables ---------------------------------------------------------


def _indexed(s: SparkSession, rows: DataFrame, index: str) -> str:
    path = folder(s)
    L.write_index(rows, index, path)
    return path


def _scored(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).withColumn("score_posted", score_posted(c("score"), iso_z(c("posted_at"))))


def _plain(s: SparkSession, d: str) -> DataFrame:
    return B.postings(s, d).withColumn("score", F.lit(0))


_SP = f"lpad(CAST(least(score, 100) AS VARCHAR), 4, '0') || '#' || {iso_sql('posted_at')}"
add("index_by_company", lambda s, d: L.by_company(
    s, _indexed(s, _plain(s, d), "company"), "customer#000000011", 50).select(
    "company_normalized", iso_z(c("posted_at")).alias("posted_at"), "job_id", "title",
    c("score").cast("bigint").alias("score"), "status", "url"),
    f"""SELECT company_normalized, {iso_sql('posted_at')} AS posted_at, job_id, title,
    CAST(0 AS BIGINT) AS score, status, url FROM postings
    WHERE company_normalized = 'customer#000000011' ORDER BY posted_at DESC, job_id LIMIT 50""",
    "postings")
add("index_by_source", lambda s, d: L.by_source_since(
    s, _indexed(s, _plain(s, d), "source"), "lever",
    F.lit("1999-01-01").cast("timestamp"), 50).select(
    "source", iso_z(c("scraped_at")).alias("scraped_at"), "job_id", "title", "company", "status"),
    f"""SELECT source, {iso_sql('scraped_at')} AS scraped_at, job_id, title, company, status
    FROM postings WHERE source = 'lever' AND scraped_at >= TIMESTAMP '1999-01-01'
    ORDER BY scraped_at DESC, job_id LIMIT 50""", "postings")
add("index_by_status", lambda s, d: L.by_status(
    s, _indexed(s, _scored(s, d), "score"), "active", 50, ("0050#1998-01-01T00:00:00Z", "k"))
    .select("status", "score_posted", "job_id", "title", "company", "company_normalized", "url",
            iso_z(c("posted_at")).alias("posted_at"), c("score").cast("bigint").alias("score"),
            "track", "source", "location"),
    f"""SELECT status, {_SP} AS score_posted, job_id, title, company, company_normalized, url,
    {iso_sql('posted_at')} AS posted_at, CAST(score AS BIGINT) AS score, track, source, location
    FROM scored WHERE status = 'active' AND ({_SP} < '0050#1998-01-01T00:00:00Z' OR
      ({_SP} = '0050#1998-01-01T00:00:00Z' AND job_id > 'k'))
    ORDER BY {_SP} DESC, job_id LIMIT 50""", *SCORED)
add("index_by_track", lambda s, d: L.by_track(
    s, _indexed(s, _scored(s, d), "track"), "TRACK_2_INTERIM", 50).select(
    "track", "score_posted", "job_id", "title", "company", "url",
    iso_z(c("posted_at")).alias("posted_at"), c("score").cast("bigint").alias("score"), "status"),
    f"""SELECT track, {_SP} AS score_posted, job_id, title, company, url,
    {iso_sql('posted_at')} AS posted_at, CAST(score AS BIGINT) AS score, status
    FROM scored WHERE track = 'TRACK_2_INTERIM' ORDER BY {_SP} DESC, job_id LIMIT 50""", *SCORED)


def bucketed(s: SparkSession, df: DataFrame, key: str, buckets: int = 8) -> DataFrame:
    return L.write_bucketed(df, f"rolesift_{uuid.uuid4().hex}", key, folder(s), buckets)


def bucketed_join(s: SparkSession, d: str) -> DataFrame:
    postings = bucketed(s, B.postings(s, d).select("job_id", "title", "status"), "job_id")
    verdicts = bucketed(s, B.verdicts(s, d).select("job_id", "semantic_score"), "job_id")
    return postings.join(verdicts, "job_id", "left")


add("join_bucketed_left", lambda s, d: bucketed_join(s, d).select(
    "job_id", "status", c("semantic_score").cast("bigint").alias("semantic_score")),
    """SELECT p.job_id, status, CAST(semantic_score AS BIGINT) AS semantic_score
    FROM postings p LEFT JOIN verdicts v ON p.job_id = v.job_id""", "postings", "verdicts")
add("point_lookup_bucketed", lambda s, d: bucketed(
    s, B.companies(s, d), "company_name_normalized").where(
    c("company_name_normalized") == "customer#000000042").select("company_name", "tier", "industry"),
    """SELECT company_name, tier, industry FROM companies
    WHERE company_name_normalized = 'customer#000000042'""", "companies")
