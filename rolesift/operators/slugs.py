"""Matching companies to the hiring-platform boards that were observed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.functions.normalize import slug_candidates


def match_slugs(companies: DataFrame, observed: DataFrame) -> DataFrame:
    """Per company the first candidate slug seen on a platform and what to do about it.

    ``observed``: ats, slug, rank (platform order). ``action`` is keep, update or null.
    """
    cands = companies.select(
        "company_name_normalized", "company_name", "ats_type", "ats_slug",
        F.posexplode(slug_candidates(F.col("company_name"), F.col("ats_slug")))
        .alias("pos", "slug"))
    hits = cands.join(observed, "slug").groupBy("company_name_normalized").agg(
        F.min_by(F.struct("ats", "slug"), F.struct("pos", "rank")).alias("found"))
    out = companies.join(hits, "company_name_normalized", "left")
    same = (F.col("found.ats") == F.col("ats_type")) & (F.col("found.slug") == F.col("ats_slug"))
    return out.select("company_name_normalized", F.col("found.ats").alias("found_ats"),
                      F.col("found.slug").alias("found_slug"),
                      F.when(F.col("found").isNull(), "null")
                      .when(F.coalesce(same, F.lit(False)), "keep").otherwise("update")
                      .alias("action"))
