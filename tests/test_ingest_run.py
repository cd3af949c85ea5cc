"""Ingest runs: every payload ends as a posting, a skip or a rejected row, and in the ledger."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from rolesift.plans.ingest_run import LEDGER, _counted, ingest_run, land, tag_payloads
from rolesift.sources import archive as A
from rolesift.sources.specs import EMPTY, MALFORMED, SPECS, SourceSpec

NOW = datetime(2026, 4, 20)


def as_of():
    return F.lit(NOW)

RAW = "source string, run_ts timestamp, payload string"
TWO = {n: SPECS[n] for n in ("remoteok", "himalayas")}


def job(i, **over):
    return json.dumps({"id": i, "title": f"Job {i}", "company": "Acme",
                       "url": f"https://example.com/{i}", **over})


def raw(spark, *rows):
    return spark.createDataFrame([(s, NOW, p) for s, p in rows], RAW)


@pytest.fixture
def nothing(spark):
    return tag_payloads(raw(spark), as_of(), TWO)[0].drop("kind", "reason", "run_ts", "payload")


def ledger(run):
    return {r["source_name"]: r.asDict() for r in run.ledger.collect()}


def test_new_postings_then_updates(spark, nothing):
    first = ingest_run(raw(spark, ("remoteok", job(1)), ("remoteok", job(2))), nothing, as_of(),
                       specs=TWO)
    row = ledger(first)["remoteok"]
    assert (row["status"], row["jobs_found"], row["jobs_new"], row["jobs_updated"]) == ("ok", 2, 2, 0)
    again = ingest_run(raw(spark, ("remoteok", job(1, title="Other")), ("remoteok", job(3))),
                       first.merged.drop("change"), as_of(), specs=TWO)
    row = ledger(again)["remoteok"]
    assert (row["jobs_new"], row["jobs_updated"]) == (1, 1)
    got = {r["job_id"]: (r["title"], r["change"]) for r in again.merged.collect()}
    assert got == {"remoteok:1": ("Other", "updated"), "remoteok:2": ("Job 2", "kept"),
                   "remoteok:3": ("Job 3", "new")}


def test_a_bad_item_does_not_stop_the_others(spark, nothing):
    run = ingest_run(raw(
        spark, ("remoteok", job(1)), ("remoteok", '{"id": 2, "title": "cut'), ("remoteok", job(3)),
        ("remoteok", None), ("remoteok", "[]"), ("remoteok", " "), ("remoteok", '"text"'),
        ("remoteok", job(4, title="")), ("remoteok", job(5, company=None, title=""))),
        nothing, as_of(), specs=TWO)
    row = ledger(run)["remoteok"]
    assert (row["status"], row["jobs_found"], row["jobs_new"], row["jobs_skipped"],
            row["n_errors"]) == ("partial", 9, 2, 2, 5)
    assert row["error_message"] == EMPTY
    rejected = sorted((r["reason"], r["payload"] or "") for r in run.rejected.collect())
    assert rejected == [(EMPTY, ""), (EMPTY, " "), (MALFORMED, '"text"'), (MALFORMED, "[]"),
                        (MALFORMED, '{"id": 2, "title": "cut')]
    assert sorted(r["reason"] for r in run.skipped.collect()) == [
        "incomplete: title", "incomplete: title, company"]


def test_every_payload_is_somewhere(spark, nothing):
    rows = [("remoteok", job(i)) for i in range(20)] * 2 + [
        ("himalayas", job(7)), (None, job(1)), ("elsewhere", job(2)), ("remoteok", "{")]
    run = ingest_run(raw(spark, *rows), nothing, as_of(), specs=TWO)
    kinds = [t.count() for t in (run.postings, run.skipped, run.rejected)]
    assert sum(kinds) == len(rows) == sum(r["jobs_found"] for r in run.ledger.collect())
    assert ledger(run)["unknown source"]["n_errors"] == 2
    # the second delivery of a new posting in one run is an update of it
    assert (ledger(run)["remoteok"]["jobs_new"], ledger(run)["remoteok"]["jobs_updated"]) == (20, 20)


def test_fetch_and_plan_failures_have_a_ledger_row(spark, nothing):
    broken = SourceSpec("broken", "id string", lambda p: {"native_id": p["no_such_field"]})
    run = ingest_run(raw(spark, ("remoteok", job(1))), nothing, as_of(),
                     specs={**TWO, "broken": broken}, fetch_errors={"down": "site is down"})
    rows = ledger(run)
    assert rows["down"]["status"] == "error" and rows["down"]["error_message"] == "site is down"
    assert rows["down"]["jobs_found"] == 0
    assert rows["broken"]["status"] == "error" and "AnalysisException" in rows["broken"]["error_message"]
    assert (rows["remoteok"]["status"], rows["himalayas"]["jobs_found"]) == ("ok", 0)
    assert run.ledger.columns == [p.strip().split(" ")[0] for p in LEDGER.split(",")]


def test_an_archive_is_read_once_by_source(spark, tmp_path):
    """Each branch prunes to its own directory."""
    A.write_raw(raw(spark, ("remoteok", job(1)), ("himalayas", job(2))), str(tmp_path))
    tagged, _ = tag_payloads(A.read_raw(spark, str(tmp_path)).select("source", "run_ts", "payload"),
                             as_of(), TWO)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(source") == 2
    assert {r["job_id"]: r["kind"] for r in tagged.collect()} == {
        "remoteok:1": "posting", "himalayas:2": "posting"}


def test_an_empty_run(spark, nothing):
    run = ingest_run(raw(spark), nothing, as_of(), specs=TWO)
    assert {r["source_name"]: (r["status"], r["jobs_found"]) for r in run.ledger.collect()} == {
        "remoteok": ("ok", 0), "himalayas": ("ok", 0)}
    assert run.merged.count() == run.rejected.count() == 0


def test_counts_come_from_what_was_stored(spark):
    items = spark.createDataFrame([("a", "posting", None), ("a", "rejected", "y"),
                                   ("a", "rejected", "x"), ("b", "skipped", "incomplete: title")],
                                  "source string, kind string, reason string")
    assert _counted(items) == {
        "a": {"source": "a", "posting": 1, "skipped": 0, "rejected": 2, "message": "x"},
        "b": {"source": "b", "posting": 0, "skipped": 1, "rejected": 0, "message": None}}


def test_rejected_rows_are_read_without_a_merge(spark, nothing, tmp_path, monkeypatch):
    rows = raw(spark, ("remoteok", job(1)), ("remoteok", "{"), ("elsewhere", job(2)),
               ("himalayas", None), ("remoteok", job(3, title="")))
    landed = land(rows, as_of(), str(tmp_path), TWO)
    run = ingest_run(rows, nothing, as_of(), specs=TWO)
    for kind in ("postings", "skipped", "rejected"):
        ours, theirs = getattr(landed, kind), getattr(run, kind)
        assert ours.schema == theirs.schema
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    assert [p.name for p in tmp_path.iterdir()] == ["items"]
    monkeypatch.delattr("catalog.ingest_queries._table_before")
    assert QUERIES["ingest_rejected"](spark, "/root/testdata/sf0.001").count() == 13
