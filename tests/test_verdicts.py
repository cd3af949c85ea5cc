import json
from datetime import datetime

from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig
from rolesift.operators import verdicts as V

CFG = ScoringConfig()
FULL = {"score": 72, "work_mode": "Remote-first", "rationale": " fine ",
        "role_family_match": "strong fit", "industry_match": "weak",
        "geography_match": "unreachable", "level_match": "over", "watchlist_dream": "yes",
        "life_fit_concerns": ["a", " ", 3, "b" * 200]}


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    return {r["i"]: r for r in V.parse(df).collect()}


def test_reply_forms(spark):
    body = json.dumps(FULL)
    cut = body[:body.index('"b')] + '"Progra'
    got = parsed(spark, [body, f"```json\n{body}\n```", f"Sure! {body} Done.", cut, "no json",
                         None, '{"work_mode": "remote"}', '{"score": "72"}', "[1]", '{"score": 1',
                         '{"score": 250.5}', '{"score": 2.5}', '{"score": -4}',
                         '{"score": 50, "life_fit_concerns": "one phrase"}', "{}"])
    assert sorted(got) == [0, 1, 2, 3, 9, 10, 11, 12, 13]
    for i in (0, 1, 2, 3):
        assert got[i]["semantic_score"] == 72
        assert got[i]["verdict_work_mode"] == "remote"
        assert got[i]["role_family_match"] == "strong"
        assert got[i]["industry_match"] == "unclear"
        assert got[i]["geography_match"] == "unreachable"
        assert got[i]["watchlist_dream"] is True
    assert got[0]["semantic_rationale"] == "fine"
    assert got[0]["life_fit_concerns"][0] == "a"
    assert set(got[0]["life_fit_concerns"][1]) == {"b"}
    assert len(got[0]["life_fit_concerns"][1]) > 120
    assert got[3]["life_fit_concerns"] == ["a", "Progra"]
    assert [got[i]["semantic_score"] for i in (9, 10, 11, 12)] == [1, 100, 2, 0]
    assert got[13]["life_fit_concerns"] == ["one phrase"]
    assert got[9]["level_match"] == "unclear" and got[9]["life_fit_concerns"] == []


JOB = ("job_id string, title string, company string, company_normalized string, "
       "description string, location string, remote boolean, salary_min long, salary_max long, "
       "company_tier string, posted_at timestamp, work_mode string")
AS_OF = datetime(2026, 4, 20)


def jobs(spark, *rows):
    return spark.createDataFrame(
        [(j, t, "X", c, "", "", None, None, None, None, AS_OF, "hybrid") for j, t, c in rows],
        JOB)


def verdict_rows(spark, *rows):
    return spark.createDataFrame(
        [(j, s, "r", at, "m", "remote", "strong", "strong", geo, "match", dream, ["x"])
         for j, s, at, geo, dream in rows],
        "job_id string, semantic_score int, semantic_rationale string, "
        "semantic_scored_at timestamp, semantic_model string, verdict_work_mode string, "
        "role_family_match string, industry_match string, geography_match string, "
        "level_match string, watchlist_dream boolean, life_fit_concerns array<string>")


def test_every_state_is_reachable(spark):
    df = jobs(spark, ("1", "VP", "roblox"), ("2", "VP", "roblox"), ("3", "VP", "acme"),
              ("4", "Data Analyst", "acme"), ("5", "VP", "acme"), ("6", "Producer", "roblox"))
    new, old = datetime(2026, 4, 18), datetime(2026, 4, 1)
    v = verdict_rows(spark, ("1", 20, new, "unreachable", True), ("2", 90, new, "reachable", True),
                     ("3", 60, old, "reachable", False), ("4", 99, new, "reachable", False),
                     ("6", 20, new, "unreachable", True))
    rows = V.score_combined(df, v, CFG, F.lit(AS_OF)).collect()
    got = {r["job_id"]: (r["tier"], r["score"], r["verdict_state"]) for r in rows}
    assert got == {"1": ("watchlist_dream", 20, "scored"), "2": ("T1", 90, "scored"),
                   "3": ("needs_review", 0, "missing"), "4": ("DISQUALIFIED", 0, "skipped"),
                   "5": ("needs_review", 0, "missing"), "6": ("skip", 20, "scored")}
    by_id = {r["job_id"]: r for r in rows}
    assert by_id["4"]["semantic_score"] is None and by_id["4"]["algo_score"] == 0
    assert by_id["2"]["work_mode"] == "remote" and by_id["3"]["work_mode"] == "hybrid"
    # Quality of life still follows the stored mode in the run that brings the verdict.
    assert "work_mode_hybrid" in by_id["2"]["qol_breakdown"]


def test_kill_switch_and_skip(spark):
    df = jobs(spark, ("1", "VP", "acme"))
    v = verdict_rows(spark, ("1", 90, AS_OF, "reachable", False))
    for cfg, skip in ((CFG.with_(verdicts_enabled=False), False), (CFG, True)):
        row = V.score_combined(df, v, cfg, F.lit(AS_OF), skip_verdicts=skip).collect()[0]
        assert (row["tier"], row["verdict_state"]) == ("needs_review", "skipped")


def test_requests_leave_out_fresh_and_failed(spark):
    from rolesift.operators.prefilter import prefilter
    df = prefilter(jobs(spark, ("1", "VP", "acme"), ("2", "Data Analyst", "a"),
                        ("3", "VP", "roblox")), CFG)
    v = verdict_rows(spark, ("1", 90, AS_OF, "reachable", False))
    got = V.requests(df, v, F.lit(AS_OF), CFG).collect()
    assert [r["job_id"] for r in got] == ["3"]
    assert "Company flags: dream-tier" in got[0]["message"]
    assert V.requests(df, v, F.lit(AS_OF), CFG, force=True).count() == 2


def test_request_text_is_whole_unless_limited(spark):
    from dataclasses import replace
    from rolesift.operators.prefilter import prefilter
    df = jobs(spark, ("1", "VP", "acme")).withColumn("description", F.repeat(F.lit("x"), F.lit(
        5000)))
    for limit, n in ((None, 5000), (3000, 3000)):
        cfg = replace(CFG, description_limit=limit)
        text = V.requests(prefilter(df, cfg), verdict_rows(spark), F.lit(AS_OF), cfg) \
            .first()["message"]
        assert "x" * n in text and "x" * (n + 1) not in text
        assert (V.TRUNCATION_NOTE in text) == (limit is not None)
