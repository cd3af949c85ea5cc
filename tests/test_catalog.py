"""Registered queries against their SQL twins; the whole list is `python -m catalog.check`."""

import pytest

import __spark_entry__ as entry
from catalog.check import compare, connect

DIR = "/root/testdata/sf0.001"
SAMPLE = ["prefilter", "weighted_score", "browse", "dedup_postings", "upsert_postings",
          "verdict_parse", "run_summary", "normalize_company", "html_listing_scan",
          "latest_runs_per_source", "src_lever", "rss_scan"]


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, key):
    result = compare(spark, connect(DIR), key, entry.queries()[key], entry.oracle_sql()[key], DIR)
    assert result.startswith("ok") and "EMPTY" not in result, result


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "job_id"
