"""Company facts joined onto postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig

FACTS = ("map_industry", "is_equality_co", "is_crunch_listed", "is_crunch_reduced")


def company_key(company_normalized: Column, company: Column) -> Column:
    """Stored key when there is one, else the plain lower-cased name."""
    return F.coalesce(F.nullif(F.lower(F.trim(company_normalized)), F.lit("")),
                      F.lower(F.trim(company)), F.lit(""))


def facts_from_config(df: DataFrame, cfg: ScoringConfig, key: str = "company_key") -> DataFrame:
    """Facts from the configured lists only: hash-set membership, no join."""
    k = F.col(key)
    by_bucket: dict[str, list[str]] = {}
    for name, bucket in cfg.company_industries.items():
        by_bucket.setdefault(bucket, []).append(name)
    industry = F.coalesce(*[F.when(k.isin(names), F.lit(b)) for b, names in by_bucket.items()],
                          F.lit(None).cast("string"))
    return df.withColumns({
        "map_industry": industry,
        "is_equality_co": k.isin(cfg.equality_companies),
        "is_crunch_listed": k.isin(cfg.crunch_companies),
        "is_crunch_reduced": k.isin(cfg.crunch_reduced),
    })


def facts_from_table(df: DataFrame, companies: DataFrame, key: str = "company_key") -> DataFrame:
    """Facts from a company table keyed by ``company_name_normalized``.

    The table grows with the market, so no broadcast is forced: Spark broadcasts it while
    its size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both
    sides, with adaptive skew splitting for a company that owns much of the postings.
    """
    # One row per company: a repeated company must not multiply its postings.
    dim = companies.groupBy(F.col("company_name_normalized").alias(key)).agg(
        F.max("industry").alias("map_industry"),
        F.max("equality").alias("is_equality_co"),
        F.max("crunch").alias("is_crunch_listed"),
        F.max("crunch_reduced").alias("is_crunch_reduced"))
    joined = df.join(dim, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in FACTS[1:]})


def with_company_facts(df: DataFrame, cfg: ScoringConfig,
                       companies: DataFrame | None = None) -> DataFrame:
    keyed = df.withColumn(
        "company_key", company_key(F.col("company_normalized"), F.col("company")))
    if companies is None:
        return facts_from_config(keyed, cfg)
    return facts_from_table(keyed, companies)


def company_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Company records from configuration: name required, one row per key, last one wins.

    The entries come from a hand-kept file, so their number is bounded by that file.
    """
    latest: dict[str, tuple] = {}
    for e in entries:
        name = (e.get("name") or "").strip()
        if not name:
            continue
        key = (e.get("name_normalized") or name).strip().lower()
        tier = e.get("tier")
        latest[key] = (key, name, None if tier is None else str(tier), e.get("ats"),
                       e.get("ats_slug"), e.get("industry"), bool(e.get("active", True)))
    return spark.createDataFrame(
        list(latest.values()),
        "company_name_normalized string, company_name string, tier string, ats_type string, "
        "ats_slug string, industry string, active boolean")
