"""Counts, audit views and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolesift.functions.normalize import iso_z, salary_pretty
from rolesift.functions.text import strip, text_or_empty
from rolesift.operators.classify import score_band

APPLY, REVIEW, REJECTS = ("View 1 - Apply queue", "View 2 - Needs review / dream-co",
                          "View 3 - Prefilter rejects")
VIEWS = (APPLY, REVIEW, REJECTS)
# Apply-queue bands by semantic score.
BANDS = [(80, "A. Strong match (Semantic 80-100)"), (65, "B. Solid match  (Semantic 65-79)"),
         (50, "C. Monitor      (Semantic 50-64)")]
LOWEST_BAND = "D. Low-score passes (Semantic <50)"
# Score buckets, lowest first.
SCORE_BUCKETS = ["gated_0", "1-34", "35-49", "50-64", "65-77_T2", "78+_T1"]


def active_stats(df: DataFrame) -> DataFrame:
    """dimension, value, n for band, track and source of active postings, in one pass."""
    base = df.where(F.col("status") == "active").select(
        score_band(F.coalesce("score", F.lit(0))).alias("band"),
        F.coalesce("track", F.lit("unscored")).alias("track"),
        F.coalesce("source", F.lit("unknown")).alias("source"))
    sets = base.groupingSets([["band"], ["track"], ["source"]], "band", "track", "source").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    return sets.select(
        F.when(F.col("g") == 3, "band").when(F.col("g") == 5, "track").otherwise("source")
        .alias("dimension"),
        F.coalesce("band", "track", "source").alias("value"), "n")


def stats_by(df: DataFrame, dimension: str) -> DataFrame:
    return active_stats(df).where(F.col("dimension") == dimension).select("value", "n") \
        .orderBy(F.col("n").desc(), "value")


def score_bucket(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    return (F.when(s == 0, "gated_0").when(s < 35, "1-34").when(s < 50, "35-49")
            .when(s < 65, "50-64").when(s < 78, "65-77_T2").otherwise("78+_T1"))


def score_distribution(df: DataFrame) -> DataFrame:
    """Count per bucket; every bucket is listed even when empty."""
    flags = [F.count_if(score_bucket(F.col("score")) == b).alias(b) for b in SCORE_BUCKETS]
    wide = df.agg(*flags)
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b).alias("bucket"),
                               F.col(f"`{b}`").alias("n"))
                      for i, b in enumerate(SCORE_BUCKETS)])
    return wide.select(F.inline(pairs))


def coverage_by_status(df: DataFrame) -> DataFrame:
    """Postings with and without a prefilter result per status, with a TOTAL row."""
    base = df.select(F.coalesce("status", F.lit("<none>")).alias("status"),
                     F.col("passed_prefilter").isNotNull().alias("has"))
    counts = base.rollup("status").agg(
        F.count_if("has").alias("with_pf"), F.count_if(~F.col("has")).alias("without_pf"),
        F.count(F.lit(1)).alias("total"))
    share = F.try_divide(F.col("with_pf") * F.lit(100.0), F.col("total"))
    return counts.select(F.coalesce("status", F.lit("TOTAL")).alias("status"), "with_pf",
                         "without_pf", "total", F.bround(share, 1).alias("coverage_pct"))


# ---------------------------------------------------------------------------
# Audit
# ---------------------------------------------------------------------------

def audit_view(tier: Column, watchlist_dream: Column, passed: Column,
               algo_score: Column) -> Column:
    t = F.lower(strip(text_or_empty(tier)))
    ok = F.coalesce(passed, F.coalesce(algo_score, F.lit(0)) >= 100)
    return (F.when(t == "needs_review", REVIEW).when(t == "disqualified", REJECTS)
            .when(F.coalesce(watchlist_dream, F.lit(False)), REVIEW)
            .when(ok, APPLY).otherwise(REJECTS))


def audit_subgroup(view: Column, semantic_score: Column, tier: Column, watchlist: Column,
                   reason: Column, level: str = "prefix") -> Column:
    """Sub-group inside a view; rejects by reason prefix or by the full reason."""
    band = F.coalesce(*[F.when(semantic_score >= cut, F.lit(label)) for cut, label in BANDS],
                      F.lit(LOWEST_BAND))
    review = (F.when(F.lower(strip(text_or_empty(tier))) == "needs_review", "Needs review")
              .when(F.coalesce(watchlist, F.lit(False)), "Watchlist - dream company")
              .otherwise("Other"))
    full = F.nullif(strip(text_or_empty(reason)), F.lit(""))
    if level == "full":
        rejects = F.coalesce(full, F.lit("unspecified"))
    else:
        head = F.nullif(strip(F.substring_index(full, ":", 1)), F.lit(""))
        rejects = F.coalesce(head, F.lit("unknown_prefilter_fail"))
    return F.when(view == APPLY, band).when(view == REVIEW, review).otherwise(rejects)


def with_audit(df: DataFrame, level: str = "prefix") -> DataFrame:
    viewed = df.withColumn("view", audit_view(F.col("tier"), F.col("watchlist_dream"),
                                              F.col("passed_prefilter"), F.col("algo_score")))
    return viewed.withColumn("sub_group", audit_subgroup(
        F.col("view"), F.col("semantic_score"), F.col("tier"), F.col("watchlist_dream"),
        F.col("prefilter_reason"), level))


def filter_views(df: DataFrame, numbers: str = "") -> DataFrame:
    """Keep the views named by '1,3'-style text; empty keeps all."""
    picked = [t.strip() for t in (numbers or "").split(",") if t.strip()]
    unknown = [t for t in picked if t not in ("1", "2", "3")]
    if unknown:
        raise ValueError(f"unknown view {unknown[0]!r} (expected 1, 2 or 3)")
    if not picked:
        return df
    return df.where(F.col("view").isin([VIEWS[int(t) - 1] for t in picked]))


def filter_min_semantic(df: DataFrame, n: int | None, max_rows: int | None = None) -> DataFrame:
    """Drop unscored rows and rows below n; ``max_rows`` caps an export on request."""
    out = df if n is None else df.where(F.col("semantic_score") >= n)
    return out if max_rows is None else out.limit(max_rows)


def audit_order(df: DataFrame) -> list[Column]:
    """View, then score (zero sorts like a missing score) and company; rejects by name."""
    reject = F.col("view") == REJECTS
    score = F.when(~reject, -F.coalesce(F.nullif("semantic_score", F.lit(0)), F.lit(-1)))
    title = F.when(reject, F.lower(text_or_empty(F.col("title"))))
    return [F.col("view").asc(), score.asc_nulls_last(),
            F.lower(text_or_empty(F.col("company"))).asc(), title.asc_nulls_first(),
            F.col("job_id").asc()]


def audit_sort(df: DataFrame) -> DataFrame:
    """Audit order. A full ordering of the export is a range-partitioned sort."""
    return df.orderBy(*audit_order(df))


def audit_summary(df: DataFrame) -> DataFrame:
    """view, sub_group, n; a view without rows is listed with 0."""
    counts = df.groupBy("view", "sub_group").agg(F.count(F.lit(1)).alias("n"))
    views = df.sparkSession.createDataFrame([(v,) for v in VIEWS], "view string")
    joined = views.join(counts, "view", "left")
    return joined.select("view", F.coalesce("sub_group", F.lit("")).alias("sub_group"),
                         F.coalesce("n", F.lit(0)).alias("n"))


def audit_export(df: DataFrame) -> DataFrame:
    """The 41 flat text columns of the audit file."""
    def text(name: str) -> Column:
        return text_or_empty(F.col(name).cast("string"))

    def flag(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false")

    def joined(name: str) -> Column:
        kept = F.filter(F.col(name), lambda v: v.isNotNull() & (strip(v) != ""))
        return text_or_empty(F.array_join(kept, "; "))

    def amount(name: str) -> Column:
        return text_or_empty(F.nullif(F.col(name), F.lit(0)).cast("string"))

    passed = F.coalesce(F.col("passed_prefilter"),
                        F.coalesce("algo_score", F.lit(0)) >= 100)
    rationale = F.translate(text("semantic_rationale"), "\r\n", "  ")
    out = with_audit(df, level="full")
    return out.select(
        "view", "sub_group", text("semantic_score").alias("semantic_score"),
        text("score").alias("final_score"), text("algo_score").alias("algo_score"),
        text("tier").alias("tier"), text("track").alias("track"),
        flag(passed).alias("passed_prefilter"),
        text("prefilter_reason").alias("prefilter_reason"), text("title").alias("title"),
        text("company").alias("company"), text("location").alias("location"),
        amount("salary_min").alias("salary_min"), amount("salary_max").alias("salary_max"),
        F.lit("").alias("salary_currency"),
        salary_pretty(F.col("salary_min"), F.col("salary_max")).alias("salary_pretty"),
        text("work_mode").alias("work_mode"), text("engagement_type").alias("engagement_type"),
        text("source").alias("source"),
        text_or_empty(iso_z(F.col("posted_at"))).alias("posted_at"),
        text("role_family_match").alias("role_family_match"),
        text("industry_match").alias("industry_match"),
        text("geography_match").alias("geography_match"),
        text("level_match").alias("level_match"),
        flag(F.col("watchlist_dream")).alias("watchlist_dream"),
        joined("life_fit_concerns").alias("life_fit_concerns"),
        joined("hard_disqualifiers").alias("hard_disqualifiers"),
        joined("soft_warnings").alias("soft_warnings"),
        joined("positive_signals").alias("positive_signals"),
        joined("role_types").alias("role_types"), joined("industries").alias("industries"),
        text("industry").alias("industry"), text("company_group").alias("company_group"),
        flag(F.col("is_dream_company")).alias("is_dream_company"),
        flag(F.col("is_hrc100")).alias("is_hrc100"),
        flag(F.col("is_crunch_co")).alias("is_crunch_co"),
        text("location_flag").alias("location_flag"),
        joined("gates_triggered").alias("gates_triggered"), text("url").alias("url"),
        "job_id", rationale.alias("semantic_rationale"))


def write_audit_csv(df: DataFrame, path: str) -> None:
    audit_export(df).write.mode("overwrite").option("header", True) \
        .option("quoteAll", False).option("escape", '"').csv(path)


# ---------------------------------------------------------------------------
# Runs
# ---------------------------------------------------------------------------

RUN_TTL_DAYS = 30


def run_errors(items: DataFrame) -> DataFrame:
    """Every error text with its run and item: the table behind the ledger's counts."""
    return items.where(F.col("error").isNotNull()).select(
        "source_name", "run_timestamp", "item_no", "error")


def run_summary(items: DataFrame) -> DataFrame:
    """Ledger row per (source_name, run_timestamp) from item outcomes.

    ``items``: source_name, run_timestamp, item_no, existed (NULL when the item was skipped
    or failed), error, duration_ms, fatal. One aggregate that combines before the shuffle;
    ``error_message`` is the first item's, ``run_errors`` has all of them.
    """
    failed = F.col("error").isNotNull()
    first = F.min(F.when(failed, F.struct("item_no", "error")))["error"]
    counts = items.groupBy("source_name", "run_timestamp").agg(
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if(~F.col("existed")).alias("jobs_new"),
        F.count_if("existed").alias("jobs_updated"),
        F.count("error").alias("n_errors"), F.max("duration_ms").alias("duration_ms"),
        F.bool_or(F.coalesce("fatal", F.lit(False))).alias("fatal"),
        first.alias("error_message"))
    status = F.when(F.col("fatal"), "error").when(F.col("n_errors") > 0, "partial") \
        .otherwise("ok")
    ttl = F.unix_timestamp("run_timestamp") + F.lit(RUN_TTL_DAYS * 86_400)
    return counts.select(
        "source_name", "run_timestamp", status.alias("status"), "jobs_found", "jobs_new",
        "jobs_updated", "duration_ms", ttl.alias("expires_at"), "n_errors", "error_message")


def latest_runs_per_source(runs: DataFrame, per_source: int = 3, overall: int | None = 20
                           ) -> DataFrame:
    """Newest runs of each source, then the newest overall (all of them for None).

    The rank limit is applied inside each task before the shuffle, so a source with most
    of the runs sends only ``per_source`` rows per task.
    """
    w = W.partitionBy("source_name").orderBy(F.col("run_timestamp").desc(),
                                             F.col("run_id").asc())
    ranked = runs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_source)
    if overall is None:
        return ranked.drop("_rn")
    return ranked.drop("_rn").orderBy(F.col("run_timestamp").desc(), "run_id").limit(overall)


def source_health_card(runs: DataFrame, prior: int = 3) -> DataFrame:
    """Latest status and counts of every source, with how many of its recent runs were ok."""
    recent = latest_runs_per_source(runs, per_source=prior, overall=None)
    order = F.struct(F.col("run_timestamp"), (-F.col("run_id")).alias("k"))
    return recent.groupBy("source_name").agg(
        F.max_by("status", order).alias("status"),
        F.max("run_timestamp").alias("run_timestamp"),
        F.max_by("jobs_found", order).alias("jobs_found"),
        F.count(F.lit(1)).alias("runs_shown"),
        F.count_if(F.col("status") == "ok").alias("ok_runs"))


def rescore_summary(results: DataFrame) -> DataFrame:
    """Counters of a rescore pass over its result rows (``outcome``, ``verdict_state``)."""
    def n(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    o = F.col("outcome")
    return results.agg(
        F.count(F.lit(1)).alias("total"), n(o == "updated", "updated"),
        n((o == "updated") & (F.col("verdict_state") == "scored"), "scored_rows"),
        n(o == "skipped", "skipped"), n(o == "api_failed", "api_failed_skipped"),
        n(o == "error", "errors"))
