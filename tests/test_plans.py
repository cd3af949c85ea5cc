"""Plan properties that have to hold at any size."""

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog import bindings as B
from catalog.sqlgen import CFG
from rolesift.operators import browse as BR
from rolesift.operators.combine import cap_per_key
from rolesift.operators.prefilter import prefilter
from rolesift.operators.reports import active_stats

DIR = "/root/testdata/sf0.001"
PYTHON = {"strip_html_full", "verdict_parse", "verdict_salvage", "src_working_nomads",
          "src_weworkremotely", "src_bettingjobs", "src_hn_thread", "src_hitmarker",
          "src_wellfound", "src_wttj", "src_builtin", "src_fractional", "src_game_jobs_uk",
          "src_games_career", "src_games_jobs_direct", "src_gamesindustry", "src_ingamejob",
          "src_outscal", "src_remote_game_jobs", "src_work_with_indies", "pages_game_jobs_uk",
          "pages_games_career"}
ACTS = {"raw_archive_read", "raw_archive_write", "csv_sheet_scan", "src_sheet", "stream_ingest",
        "stream_dedup", "stream_run_windows", "stream_late_runs", "raw_runs_replayed",
        "raw_runs_expired", "rescore_resumed", "ingest_run", "ingest_rejected", "ingest_merged",
        "search_index", "search_index_short", "index_by_company", "index_by_source",
        "index_by_status", "index_by_track", "join_bucketed_left", "point_lookup_bucketed",
        "join_substrings", "join_substrings_titles"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# One of each family; `python -m catalog.check` looks at the plan of every query.
KEYS = sorted((set(list(QUERIES)[::9]) | {"browse", "score_combined", "dedup_postings",
                                         "join_phrases", "config_dict_scan", "src_hitmarker"})
              - ACTS)


@pytest.mark.parametrize("key", KEYS)
def test_no_cross_joins_and_python_only_where_declared(spark, key):
    text = plan(QUERIES[key](spark, DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("Python" in text) == (key in PYTHON)


def test_status_reaches_the_scan_and_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    B.postings(spark, DIR).withColumns({c: F.lit(None).cast("int") for c in (
        "score", "qol_score")}).write.parquet(path)
    df = BR.filter_status(spark.read.parquet(path)).select("job_id", "status")
    text = plan(df)
    assert "EqualTo(status,active)" in text and "description" not in text


def test_caps_limit_inside_each_task(spark):
    df = cap_per_key(B.postings(spark, DIR), "company_normalized", [F.col("posted_at").desc()], 5)
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2


def test_stats_take_one_pass(spark):
    text = plan(active_stats(scored(spark)))
    assert text.count("Expand") == 1


def scored(spark):
    return B.postings(spark, DIR).withColumns({"score": F.lit(1), "track": F.lit("t")})


def test_dedup_combines_before_both_shuffles(spark):
    df = B.postings(spark, DIR).withColumn("score", F.lit(1)).select(
        "job_id", "title", "company_normalized", "source", "score")
    assert plan(BR.dedup_postings(df)).count("partial_") >= 6


def test_large_company_tables_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(prefilter(B.postings(spark, DIR), CFG, B.companies(spark, DIR)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_texts_are_built_once(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        optimized = prefilter(B.postings(spark, DIR), CFG, B.companies(spark, DIR)) \
            ._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert optimized.count("AS text_lo#") == 1 and optimized.count("AS text_found#") == 1


def test_who_only_asks_what_passed_does_not_search_for_all_phrases(spark):
    passed = prefilter(B.postings(spark, DIR), CFG, B.companies(spark, DIR)).select(
        "job_id", "passed_prefilter")
    for df in (passed, QUERIES["sort_semantic"](spark, DIR)):
        optimized = df._jdf.queryExecution().optimizedPlan().toString()
        assert "AS text_lo#" in optimized and "AS text_found#" not in optimized


def test_rescore_of_stale_rows_reads_the_table_as_often_as_of_all_rows(spark):
    from catalog.browse_queries import before_rescore
    from catalog.sqlgen import SCORED_CFG
    from rolesift.operators.tables import rescore
    scans = [plan(rescore(before_rescore(spark, DIR), B.verdicts(spark, DIR), SCORED_CFG, B.as_of(),
                          B.companies(spark, DIR), fresh_hours=hours)).count("FileScan")
             for hours in (None, 24)]
    assert scans[0] == scans[1]


def test_track_filter_does_not_compute_the_track_again(spark):
    text = QUERIES["postings_by_track"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in text.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("TRACK_2_INTERIM" in line for line in filters)
