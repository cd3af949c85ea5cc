"""Table maintenance: upsert, user actions, rescoring, expiry, preferences.

Every function returns the new state as a DataFrame; ``save_snapshot`` writes it next to
the old one and records the switch, so the path being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig
from rolesift.functions.normalize import iso_z, score_posted
from rolesift.operators.verdicts import score_combined

# Column names of the stored table.
USER_STATE = ("status", "user_notes")
VERDICT_CARRY = ("semantic_score", "semantic_rationale", "semantic_scored_at",
                 "semantic_model", "work_mode")
# Action name to the status it sets.
ACTIONS = {"save": "saved", "skip": "archived", "applied": "applied"}
RAW_TTL_DAYS = 90
BATCH_LIMIT = 200


# ---------------------------------------------------------------------------
# Snapshots
# ---------------------------------------------------------------------------

def current_snapshot(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, path) of the newest committed snapshot, None when there is none."""
    try:
        commits = spark.read.schema("version long, path string").json(f"{root}/_commits")
        row = commits.orderBy(F.col("version").desc()).first()
    except Exception as exc:  # the commit folder does not exist before the first save
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None
    return None if row is None else (row["version"], row["path"])


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    found = current_snapshot(spark, root)
    return None if found is None else spark.read.parquet(found[1])


def save_snapshot(df: DataFrame, root: str, partition_by: tuple[str, ...] = ("status",)) -> str:
    """Write a new snapshot and append its commit record; older snapshots stay readable."""
    spark = df.sparkSession
    found = current_snapshot(spark, root)
    version = 1 if found is None else found[0] + 1
    path = f"{root}/snapshot-{version:010d}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1) \
        .write.mode("append").json(f"{root}/_commits")
    return path


# ---------------------------------------------------------------------------
# Upsert
# ---------------------------------------------------------------------------

def newest_by_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the one with the greatest order value; combines before shuffling.

    Equal order values are settled by a hash of the row, so a repeated run picks the same one.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    rank = F.struct(order.alias("o"), F.xxhash64(F.to_json(row)).alias("h"))
    return df.groupBy(key).agg(F.max_by(row, rank).alias("_row")).select(key, "_row.*")


def upsert_postings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge incoming postings into the table by job_id.

    Incoming values win where present, stored values fill the rest, user state is never
    overwritten. ``change`` says 'new', 'updated' or 'kept'. Both sides are unique in
    job_id, so the full outer join has no hot key.
    """
    fresh = newest_by_key(incoming, "job_id", F.col("scraped_at"))
    columns = list(dict.fromkeys(existing.columns + incoming.columns))
    kinds = {f.name: f.dataType for f in incoming.schema.fields}
    kinds.update({f.name: f.dataType for f in existing.schema.fields})
    old = existing.select("job_id", *[F.col(c).alias(f"_old_{c}") for c in existing.columns
                                      if c != "job_id"], F.lit(True).alias("_had"))
    new = fresh.select("job_id", *[F.col(c).alias(f"_new_{c}") for c in incoming.columns
                                   if c != "job_id"], F.lit(True).alias("_got"))
    both = new.join(old, "job_id", "full_outer")

    def merged(c: str) -> Column:
        sides = [F.col(f"_{side}_{c}").cast(kinds[c]) for side, cols in
                 (("new", incoming.columns), ("old", existing.columns)) if c in cols]
        if c in USER_STATE:
            sides.reverse()
        return F.coalesce(*sides).alias(c)

    change = F.when(F.col("_had").isNull(), "new").when(F.col("_got").isNull(), "kept") \
        .otherwise("updated")
    return both.select("job_id", *[merged(c) for c in columns if c != "job_id"],
                       change.alias("change"))


def carry_verdicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Stored verdict fields copied onto re-ingested postings before scoring."""
    stored = existing.select("job_id", *[F.col(c).alias(f"_old_{c}") for c in VERDICT_CARRY])
    joined = incoming.join(stored, "job_id", "left")
    have = set(incoming.columns)
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in have else F.col(f"_old_{c}")
        for c in VERDICT_CARRY}).drop(*[f"_old_{c}" for c in VERDICT_CARRY])


# ---------------------------------------------------------------------------
# User actions
# ---------------------------------------------------------------------------

def distinct_ids(ids: DataFrame) -> DataFrame:
    """Trimmed, non-blank, distinct job ids."""
    return ids.select(F.trim("job_id").alias("job_id")) \
        .where(F.col("job_id") != "").distinct()


def check_batch(ids: DataFrame, limit: int = BATCH_LIMIT) -> DataFrame:
    """Interactive requests may name at most ``limit`` ids; larger ones are refused."""
    if ids.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} job ids in one request")
    return ids


def apply_action(postings: DataFrame, ids: DataFrame, action: str,
                 notes: str | None = None) -> DataFrame:
    """Table after the action on the listed ids; unknown ids change nothing."""
    status = ACTIONS[action]
    marked = postings.join(distinct_ids(ids).withColumn("_hit", F.lit(True)), "job_id", "left")
    hit = F.col("_hit").isNotNull()
    changes = {"status": F.when(hit, F.lit(status)).otherwise(F.col("status"))}
    if notes is not None:
        changes["user_notes"] = F.when(hit, F.lit(notes)).otherwise(F.col("user_notes"))
    return marked.withColumns(changes).drop("_hit")


def missing_ids(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return distinct_ids(ids).join(postings.select("job_id"), "job_id", "left_anti")


def existing_ids(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return distinct_ids(ids).join(postings.select("job_id"), "job_id", "left_semi")


def bulk_summary(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: requested, updated, missing."""
    known = postings.select("job_id", F.lit(True).alias("_known"))
    return distinct_ids(ids).join(known, "job_id", "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_known").alias("updated"),
        F.count_if(F.col("_known").isNull()).alias("missing"))


# ---------------------------------------------------------------------------
# Rescore
# ---------------------------------------------------------------------------

SCORE_COLUMNS = [
    "score", "algo_score", "track", "score_posted", "gates_triggered", "modifiers_applied",
    "passed_prefilter", "prefilter_reason", "hard_disqualifiers", "soft_warnings",
    "positive_signals", "is_dream_company", "is_hrc100", "is_crunch_co",
    "is_leadership_title", "tier", "location_flag", "industry", "industry_score",
    "semantic_score", "semantic_rationale", "semantic_scored_at", "semantic_model",
    "role_family_match", "industry_match", "geography_match", "level_match",
    "watchlist_dream", "life_fit_concerns", "work_mode", "industries", "role_types",
    "qol_score", "qol_breakdown", "company_group", "engagement_type",
]
#: Columns whose texts are searched while scoring.
SCORED_TEXTS = ("title", "company", "description", "location")
VERDICT_ONLY = ("semantic_score", "semantic_rationale", "semantic_scored_at",
                "semantic_model", "role_family_match", "industry_match", "geography_match",
                "level_match", "watchlist_dream", "life_fit_concerns")


def shard(df: DataFrame, index: int, of: int) -> DataFrame:
    """Slice ``index`` of ``of`` by hash of job_id, for resumable runs."""
    return df.where(F.pmod(F.xxhash64("job_id"), F.lit(of)) == index)


def rescore(postings: DataFrame, verdicts: DataFrame, cfg: ScoringConfig, as_of: Column,
            companies: DataFrame | None = None, fresh_hours: int | None = None,
            skip_verdicts: bool = False) -> DataFrame:
    """Recompute score columns; ``outcome`` is updated, skipped or api_failed.

    Rows refreshed within ``fresh_hours`` are skipped. Where a verdict was wanted but none
    is usable the stored row stays as it is. A missing new value never erases a stored one,
    and stored verdict columns change only when there is a verdict. Fresh rows go through the
    same branch with their texts taken out, so the table is read once and nothing is looked for
    in what will not be used.
    """
    have = set(postings.columns)
    kept = [c for c in SCORE_COLUMNS if c in have]
    base, fresh, texts = postings, None, []
    if fresh_hours is not None:
        cutoff = as_of - F.make_dt_interval(hours=F.lit(fresh_hours))
        base = base.withColumn("_fresh", F.coalesce(F.col("semantic_scored_at") > cutoff,
                                                    F.lit(False)))
        fresh, texts = F.col("_fresh"), [c for c in SCORED_TEXTS if c in have]
    base = base.withColumns({"_old": F.struct(*[F.col(c) for c in kept]),
                             "_texts": F.struct(F.lit(0).alias("_none"), *texts)})
    if texts:
        base = base.withColumns({c: F.when(~fresh, F.col(c)) for c in texts})
    todo = score_combined(base, verdicts, cfg, as_of, companies, skip_verdicts)
    todo = todo.withColumn("score_posted",
                           score_posted(F.col("score"), iso_z(F.col("posted_at"))))
    failed = F.col("verdict_state") == "missing"
    got = F.col("verdict_state") == "scored"

    def value(c: str) -> Column:
        old = F.col(f"_old.{c}") if c in have else None
        new = F.when(got, F.col(c)) if c in VERDICT_ONLY else F.col(c)
        value = F.when(~failed, new) if old is None else \
            F.when(failed, old).otherwise(F.coalesce(new, old))
        if fresh is None:
            return value
        return F.when(~fresh, value) if old is None else F.when(fresh, old).otherwise(value)

    rest = [F.col(f"_texts.{c}") if c in texts else F.col(c) for c in postings.columns
            if c not in SCORE_COLUMNS]
    outcome, state = F.when(failed, "api_failed").otherwise("updated"), F.col("verdict_state")
    if fresh is not None:
        outcome, state = (F.when(fresh, "skipped").otherwise(x) for x in (outcome, state))
    return todo.select(*rest, *[value(c).alias(c) for c in SCORE_COLUMNS],
                       outcome.alias("outcome"), state.alias("verdict_state"))


# ---------------------------------------------------------------------------
# Expiry and preferences
# ---------------------------------------------------------------------------

def expire_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    return runs.where(F.col("expires_at") > F.unix_timestamp(as_of))


def expire_raw(raw: DataFrame, as_of: Column, days: int = RAW_TTL_DAYS) -> DataFrame:
    """Archive rows younger than the limit; a test on partition columns only."""
    day = F.make_date("y", "m", "d")
    return raw.where(day > F.date_sub(F.to_date(as_of), days))


def prefs_put(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Whole-value overwrite per (user_id, config_key), newest update wins."""
    rows = existing.unionByName(updates)
    return rows.groupBy("user_id", "config_key").agg(
        F.max_by("value", F.struct("updated_at", "value")).alias("value"),
        F.max("updated_at").alias("updated_at"))


def prefs_map(prefs: DataFrame) -> DataFrame:
    """config_key -> value per user. A user has one row per settings key."""
    entries = F.collect_list(F.struct("config_key", "value"))
    return prefs.groupBy("user_id").agg(F.map_from_entries(F.array_sort(entries))
                                        .alias("prefs"))


def upsert_rows(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Idempotent overwrite by primary key: update rows, one per key, replace stored ones."""
    kept = existing.join(updates.select(key), key, "left_anti")
    single = newest_by_key(updates, key, F.lit(0)).select(*updates.columns)
    return kept.unionByName(single, allowMissingColumns=True)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Row with this primary key; the equality reaches the Parquet statistics."""
    return df.where(F.col(key) == F.lit(value))
