"""Hiring-thread comments to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import thread as T
from rolesift.functions.html_text import strip_html_full
from rolesift.functions.normalize import parse_salary_range
from rolesift.functions.text import computed_once
from rolesift.sources.specs import RAW_FIELDS, normalize_posting

SOURCE = "hnhiring"


def thread_jobs(comments: DataFrame, text: Column | None = None) -> DataFrame:
    """Intermediate rows of comments (comment_id, text, created_at).

    Tags, pay and remote come from the head of the comment only, so numbers in the prose
    below do not count as pay. ``text`` replaces the HTML clean-up when it is already done.
    """
    clean = strip_html_full(F.col("text")) if text is None else text
    base = comments.select("comment_id", "created_at", clean.alias("body"))
    cut = base.where(F.col("body") != "").withColumns({
        "head": T.head_of(F.col("body")), "parts": T.segments(F.col("body"))})
    named = cut.where(F.size("parts") > 0).withColumn(
        "a", computed_once(T.assign(F.col("body"), F.col("parts")))).withColumn(
        "pay", parse_salary_range(F.col("head")))
    values = {
        "native_id": F.col("comment_id").cast("string"), "title": F.col("a.title"),
        "company": F.col("a.company"),
        "url": F.concat(F.lit("https://news.ycombinator.com/item?id="),
                        F.col("comment_id").cast("string")),
        "location": F.col("a.location"), "description": F.col("body"),
        "posted_at": F.col("created_at").cast("string"),
        "salary_min": F.col("pay.lo"), "salary_max": F.col("pay.hi"),
        "remote": F.contains(F.lower("head"), F.lit("remote")),
    }
    rows = named.select(*[values[n].alias(n) if n in values else F.lit(None).cast(k).alias(n)
                          for n, k in RAW_FIELDS.items()])
    return rows.where(F.col("title").isNotNull() & F.col("company").isNotNull()
                      & F.col("native_id").isNotNull())


def normalize_thread(comments: DataFrame, as_of: Column, text: Column | None = None
                     ) -> DataFrame:
    return normalize_posting(thread_jobs(comments, text), SOURCE, as_of)
