"""Raw payload archive and the simple file sources."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.session import delete_folder, matching_folders

RAW_SCHEMA = "run_ts timestamp, payload string, source string, y int, m int, d int"
LIST_PATHS = ("jobs", "data", "results", "content")


def write_raw(df: DataFrame, root: str, mode: str = "append", files: int = 4) -> None:
    """Gzip JSON lines per source and date from (source, run_ts, payload).

    Rows are clustered by directory first, each spread over ``files`` buckets of the payload's
    hash, so a directory gets that many files at most and a hot one is no single task.
    """
    dated = df.select("source", "run_ts", "payload", F.year("run_ts").alias("y"),
                      F.month("run_ts").alias("m"), F.day("run_ts").alias("d"))
    bucket = F.pmod(F.xxhash64("payload"), F.lit(files))
    dated.repartition("source", "y", "m", "d", bucket).write.mode(mode).partitionBy("source", "y", "m", "d") \
        .option("compression", "gzip").json(root)


def read_raw(spark: SparkSession, root: str, sources: list[str] | None = None,
             since: Column | None = None) -> DataFrame:
    """Archive rows; source and date tests prune directories before anything is read."""
    raw = spark.read.schema(RAW_SCHEMA).json(root)
    if sources is not None:
        raw = raw.where(F.col("source").isin(sources))
    if since is not None:
        raw = raw.where(F.make_date("y", "m", "d") >= F.to_date(since))
    return raw


def replace_runs(df: DataFrame, root: str, files: int = 4) -> None:
    """Archive runs so that writing one again replaces it.

    Each run of a source has its own directory below its date, and only directories that ``df``
    has rows for are exchanged: a replayed run leaves the archive as it was, other runs of the same
    day stay. Rows as for ``write_raw``; a null source or time gets a directory of its own.
    """
    dated = df.select("source", "run_ts", "payload", F.year("run_ts").alias("y"),
                      F.month("run_ts").alias("m"), F.day("run_ts").alias("d"),
                      F.date_format("run_ts", "HHmmssSSSSSS").alias("run"))
    folders = ["source", "y", "m", "d", "run"]
    bucket = F.pmod(F.xxhash64("payload"), F.lit(files))
    dated.repartition(*folders, bucket).write.mode("overwrite").partitionBy(*folders) \
        .option("partitionOverwriteMode", "dynamic").option("compression", "gzip").json(root)


def read_runs(spark: SparkSession, root: str, sources: list[str] | None = None,
              since: Column | None = None) -> DataFrame:
    """Rows of ``replace_runs``; pruned like those of ``read_raw``."""
    raw = spark.read.schema(RAW_SCHEMA + ", run string").json(root)
    if sources is not None:
        raw = raw.where(F.col("source").isin(sources))
    if since is not None:
        raw = raw.where(F.make_date("y", "m", "d") >= F.to_date(since))
    return raw.drop("run")


def drop_expired(spark: SparkSession, root: str, as_of: date, days: int) -> list[str]:
    """Delete the date directories that are ``days`` old or older, and return them.

    Only directory names are listed, no file is read. Works on both archive layouts; directories
    without a date stay.
    """
    oldest, gone = as_of - timedelta(days=days), []
    for path in matching_folders(spark, f"{root}/source=*/y=*/m=*/d=*"):
        y, m, d = re.search(r"/y=([^/]*)/m=([^/]*)/d=([^/]*)$", path).groups()
        if y.isdigit() and date(int(y), int(m), int(d)) <= oldest:
            delete_folder(spark, path)
            gone.append(path)
    return gone


def explode_payload(df: DataFrame, body: str = "body",
                    paths: tuple[str, ...] = LIST_PATHS) -> DataFrame:
    """One row per JSON object in a list response: a bare list, or the first list found
    under one of ``paths``. Entries that are not objects are left out."""
    doc = F.col(body)
    lists = [F.when(F.startswith(F.ltrim(doc), F.lit("[")), doc)]
    for p in paths:
        found = F.get_json_object(doc, f"$.{p}")
        lists.append(F.when(F.startswith(found, F.lit("[")), found))
    entries = F.from_json(F.coalesce(*lists), "array<variant>")
    kept = [c for c in df.columns if c != body]
    items = df.select(*kept, F.explode(entries).alias("_item"))
    return items.where(F.startswith(F.schema_of_variant("_item"), F.lit("OBJECT"))) \
        .select(*kept, F.to_json("_item").alias("payload"))


RSS_ITEM = ("title string, link string, guid string, description string, pubDate string, "
            "region string, category string")


def read_rss(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per feed item; a malformed feed yields nothing."""
    feed = F.from_xml(F.col(body), f"channel struct<item: array<struct<{_nested(RSS_ITEM)}>>>",
                      {"mode": "PERMISSIVE", "rowTag": "rss"})
    kept = [c for c in df.columns if c != body]
    return df.select(*kept, F.explode(feed["channel"]["item"]).alias("item")) \
        .select(*kept, "item.*")


def _nested(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in
                     (part.strip().split(" ") for part in ddl.split(",")))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with a row reference that is the same on every reading.

    ``row_ref`` is a hash of the row's cells: it depends neither on how files are packed into
    tasks nor on rows before it, so re-reading a sheet finds the same postings again.
    """
    rows = spark.read.option("header", True).option("encoding", "UTF-8") \
        .option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    clean = rows.toDF(*[c.replace("﻿", "").strip().lower() for c in rows.columns])
    return clean.withColumn("row_ref", F.hex(F.xxhash64(*clean.columns)))


def explode_thread(stories: DataFrame) -> DataFrame:
    """Children with text of the newest 'who is hiring' story.

    ``stories``: story_id, title, created_at, children array<struct<id, text, created_at>>.
    """
    hiring = stories.where(F.contains(F.lower("title"), F.lit("who is hiring")))
    # A single row, so broadcasting it is safe whatever the archive holds.
    newest = hiring.agg(F.max_by("story_id", "created_at").alias("story_id"))
    return stories.join(F.broadcast(newest), "story_id") \
        .select("story_id", F.explode("children").alias("c")) \
        .where(F.coalesce(F.col("c.text"), F.lit("")) != "").select("story_id", "c.*")


def with_company_meta(payloads: DataFrame, companies: DataFrame, ats: str,
                      slug: str = "ats_slug") -> DataFrame:
    """Payloads of known companies on one hiring platform, with the company record."""
    known = companies.where((F.col("ats_type") == ats) & F.col("ats_slug").isNotNull()).select(
        F.col("ats_slug").alias(slug),
        F.struct(F.col("company_name").alias("name"), F.col("ats_slug"), F.col("tier"),
                 F.col("industry")).alias("company_meta"))
    return payloads.join(known, slug, "inner")
