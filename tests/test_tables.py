from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig
from rolesift.operators import reports as R
from rolesift.operators import tables as T
from rolesift.plans.ingest import ingest
from rolesift.session import shared_folder
from tests.test_verdicts import AS_OF, verdict_rows

T0 = datetime(2026, 4, 16)
COLS = "job_id string, title string, status string, user_notes string, scraped_at timestamp"


def rows_of(df):
    return {r["job_id"]: r for r in df.collect()}


def test_upsert_keeps_user_state_and_is_idempotent(spark):
    old = spark.createDataFrame([("1", "Old", "applied", "hi", T0), ("2", "B", "active", None, T0)],
                                COLS)
    new = spark.createDataFrame(
        [("1", "New", "active", None, T0 + timedelta(1)), ("3", "C", "active", None, T0),
         ("3", "C2", "active", None, T0 + timedelta(1))], COLS)
    once = T.upsert_postings(old, new)
    got = rows_of(once)
    assert {k: (r["title"], r["status"], r["user_notes"], r["change"]) for k, r in got.items()} \
        == {"1": ("New", "applied", "hi", "updated"), "2": ("B", "active", None, "kept"),
            "3": ("C2", "active", None, "new")}
    twice = rows_of(T.upsert_postings(once.drop("change"), new).drop("change"))
    assert twice == rows_of(once.drop("change"))


def test_upsert_keeps_columns_the_feed_lacks(spark):
    old = spark.createDataFrame([("1", "A", 77)], "job_id string, title string, score int")
    new = spark.createDataFrame([("1", None, T0)],
                                "job_id string, title string, scraped_at timestamp")
    row = T.upsert_postings(old, new).first()
    assert (row["title"], row["score"], row["change"]) == ("A", 77, "updated")


def test_actions(spark):
    table = spark.createDataFrame([("1", "A", "active", None, T0), ("2", "B", "active", "n", T0)],
                                  COLS)
    ids = spark.createDataFrame([(" 1 ",), ("1",), ("",), ("9",)], "job_id string")
    got = rows_of(T.apply_action(table, ids, "skip", "bye"))
    assert (got["1"]["status"], got["1"]["user_notes"]) == ("archived", "bye")
    assert (got["2"]["status"], got["2"]["user_notes"]) == ("active", "n")
    assert tuple(T.bulk_summary(table, ids).first()) == (2, 1, 1)
    assert [r[0] for r in T.missing_ids(table, ids).collect()] == ["9"]
    with pytest.raises(KeyError):
        T.apply_action(table, ids, "delete")
    with pytest.raises(ValueError):
        T.check_batch(spark.range(5).selectExpr("string(id) AS job_id"), 4)


JOB = ("job_id string, title string, company string, company_normalized string, "
       "description string, location string, remote boolean, salary_min long, salary_max long, "
       "company_tier string, posted_at timestamp, work_mode string, score int, tier string, "
       "semantic_score int, semantic_scored_at timestamp")


def stored(spark):
    def row(j, title, at=None):
        return (j, title, "X", "x", "", "", None, None, None, None, T0, None, 40, "old", 40, at)
    return spark.createDataFrame([row("ok", "VP"), row("failed", "VP"),
                                  row("kill", "Data Analyst"),
                                  row("fresh", "VP", AS_OF - timedelta(hours=1))], JOB)


def test_rescore_leaves_failed_and_fresh_rows_alone(spark):
    v = verdict_rows(spark, ("ok", 81, AS_OF, "reachable", False))
    out = T.rescore(stored(spark), v, ScoringConfig(), F.lit(AS_OF), fresh_hours=24)
    got = {r["job_id"]: (r["outcome"], r["score"], r["tier"], r["semantic_score"])
           for r in out.collect()}
    assert got == {"ok": ("updated", 81, "T1", 81), "failed": ("api_failed", 40, "old", 40),
                   "kill": ("updated", 0, "DISQUALIFIED", 40), "fresh": ("skipped", 40, "old", 40)}
    summary = R.rescore_summary(out).first()
    assert tuple(summary) == (4, 2, 1, 1, 1, 0)


def test_ingest_merges_scores_and_keeps_user_state(spark):
    incoming = spark.createDataFrame(
        [("ok", "VP", "X", "x", "", "", None, None, None, None, T0, None, "active", None, T0),
         ("nov", "VP", "X", "x", "", "", None, None, None, None, T0, None, "active", None, T0)],
        "job_id string, title string, company string, company_normalized string, "
        "description string, location string, remote boolean, salary_min long, "
        "salary_max long, company_tier string, posted_at timestamp, work_mode string, "
        "status string, user_notes string, scraped_at timestamp")
    v = verdict_rows(spark, ("ok", 81, AS_OF, "reachable", False))
    existing = T.rescore(incoming.withColumn("status", F.lit("saved")), v, ScoringConfig(),
                         F.lit(AS_OF)).drop("outcome", "verdict_state") \
        .where("job_id = 'ok'").withColumn("score", F.lit(5))
    got = rows_of(ingest(existing, incoming, v, ScoringConfig(), F.lit(AS_OF)))
    assert (got["ok"]["status"], got["ok"]["score"], got["ok"]["change"]) == \
        ("saved", 81, "updated")
    assert (got["nov"]["tier"], got["nov"]["score"], got["nov"]["track"]) == \
        ("needs_review", 0, "unscored")


def test_snapshots_never_overwrite_what_is_read(spark):
    root = f"{shared_folder(spark)}/snap"
    assert T.read_snapshot(spark, root) is None
    first = spark.createDataFrame([("1", "active")], "job_id string, status string")
    one = T.save_snapshot(first, root)
    two = T.save_snapshot(T.read_snapshot(spark, root).union(
        spark.createDataFrame([("2", "saved")], first.schema)), root)
    assert one != two and T.current_snapshot(spark, root) == (2, two)
    assert T.read_snapshot(spark, root).count() == 2 and spark.read.parquet(one).count() == 1


def test_expiry_and_prefs(spark):
    raw = spark.createDataFrame([(2026, 1, 1), (2026, 4, 1)], "y int, m int, d int")
    assert T.expire_raw(raw, F.lit(AS_OF)).count() == 1
    runs = spark.createDataFrame([(int(AS_OF.timestamp()) + 9,), (0,)], "expires_at long")
    assert T.expire_runs(runs, F.lit(AS_OF)).count() == 1
    prefs = spark.createDataFrame([("u", "k", "1", 1), ("u", "j", "x", 1)],
                                  "user_id string, config_key string, value string, updated_at int")
    put = T.prefs_put(prefs, spark.createDataFrame([("u", "k", "2", 2)], prefs.schema))
    assert T.prefs_map(put).first()["prefs"] == {"k": "2", "j": "x"}


def test_run_ledger(spark):
    items = [("s", T0, i, None if i % 3 == 0 else i % 3 == 1,
              f"E: {i}" if i % 3 == 0 else None, 5, False) for i in range(9)]
    items += [("hot", T0, i, None, "ValueError: x", 1, i == 0) for i in range(5000)]
    df = spark.createDataFrame(items, "source_name string, run_timestamp timestamp, item_no long, "
                               "existed boolean, error string, duration_ms long, fatal boolean")
    got = {r["source_name"]: r for r in R.run_summary(df).collect()}
    s = got["s"]
    assert (s["status"], s["jobs_found"], s["jobs_new"], s["jobs_updated"]) == ("partial", 9, 3, 3)
    assert s["error_message"] == "E: 0" and s["n_errors"] == 3
    assert R.run_errors(df).where("source_name = 's'").count() == 3
    assert got["hot"]["status"] == "error"
    assert got["hot"]["n_errors"] == 5000 == R.run_errors(df).where("source_name = 'hot'").count()


def test_audit_rules(spark):
    df = spark.createDataFrame(
        [("1", "needs_review", True, True, 100, None, "passed"),
         ("2", "DISQUALIFIED", True, False, 0, None, "wrong_function:x y"),
         ("3", "skip", True, True, 100, 10, "passed"), ("4", "T1", False, True, 100, 80, "passed"),
         ("5", None, None, None, 100, 0, None), ("6", None, None, None, 0, None, " ")],
        "job_id string, tier string, watchlist_dream boolean, passed_prefilter boolean, "
        "algo_score int, semantic_score int, prefilter_reason string")
    got = {r["job_id"]: (r["view"][5], r["sub_group"]) for r in R.with_audit(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "2", "2": "3", "3": "2", "4": "1", "5": "1",
                                                 "6": "3"}
    assert got["2"][1] == "wrong_function" and got["6"][1] == "unknown_prefilter_fail"
    assert got["4"][1] == R.BANDS[0][1] and got["5"][1] == R.LOWEST_BAND
    with pytest.raises(ValueError):
        R.filter_views(df, "4")
