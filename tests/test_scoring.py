import pytest
from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig, config_from_dict, load_config
from rolesift.operators import classify, gates, weighted
from rolesift.operators.prefilter import prefilter

CFG = ScoringConfig()
JOB = ("job_id string, title string, company string, company_normalized string, "
       "description string, location string, remote boolean, salary_min long, "
       "salary_max long, company_tier string")


def job(spark, **over):
    base = dict(job_id="s:1", title="VP of Product", company="Acme", company_normalized="acme",
                description="", location="", remote=None, salary_min=None, salary_max=None,
                company_tier=None)
    rows = over.pop("rows", [over])
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], JOB)


def reasons(spark, titles):
    df = job(spark, rows=[{"job_id": str(i), "title": t} for i, t in enumerate(titles)])
    got = {r["job_id"]: r["prefilter_reason"] for r in prefilter(df, CFG).collect()}
    return [got[str(i)] for i in range(len(titles))]


def test_function_titles_and_their_exemptions(spark):
    titles = ["Director of Product - Ads Performance", "Senior Software Engineer",
              "Senior Engineering Manager", "VP, Software Engineer Programs",
              "CTO / Software Engineer", "Strategic Advisor, Software Engineer",
              "Associate Strategic Advisor, Software Engineer", "VP of Product",
              "Direct Data Analyst", "International Operations Director", ""]
    assert reasons(spark, titles) == [
        "priority_disqualifier:ads performance", "wrong_function:software engineer", "passed",
        "passed", "passed", "passed", "diluted_exception:strategic advisor", "passed",
        "wrong_function:data analyst", "sub_vp_seniority:intern", "passed"]


def test_seniority_can_ask_for_whole_words(spark):
    cfg = CFG.with_(word_boundary_seniority=True)
    df = job(spark, rows=[{"job_id": "1", "title": "International Director"},
                          {"job_id": "2", "title": "Marketing Intern"}])
    got = {r["job_id"]: r["passed_prefilter"] for r in prefilter(df, cfg).collect()}
    assert got == {"1": True, "2": False}


def test_warnings_track_and_company_lists(spark):
    df = job(spark, rows=[
        {"job_id": "1", "title": "Senior Manager, Strategy",
         "description": "fast-paced; travel up to 60%; pair programming; fully on-site"},
        {"job_id": "2", "title": "Interim CTO", "company_normalized": "spotify"},
        {"job_id": "3", "company_normalized": "riot games", "location": "New York, NY"}])
    got = {r["job_id"]: r for r in prefilter(df, CFG).collect()}
    assert got["1"]["soft_warnings"] == ["below_vp", "crunch_language", "high_travel",
                                         "rto_mandate", "hands_on_coding"]
    assert got["1"]["location_flag"] == "heavy_office"
    assert got["2"]["track"] == "TRACK_2_INTERIM" and got["2"]["industry"] == "music_tech"
    assert got["3"]["is_dream_company"] and not got["3"]["is_crunch_co"]
    assert got["3"]["location_flag"] == "nyc_metro"


def test_every_failed_row_has_a_reason(spark):
    rows = prefilter(job(spark, description="unpaid", title="Junior Data Analyst"), CFG).collect()
    assert rows[0]["hard_disqualifiers"] == [
        "wrong_function:data analyst", "sub_vp_seniority:junior", "unpaid_engagement:unpaid"]
    assert rows[0]["prefilter_reason"] == rows[0]["hard_disqualifiers"][0]


def test_seniority_gate_and_associates(values):
    cases = {"Associate Vice President": False, "Associate Director": False,
             "Associate Director of Strategy": False, "Associate 3D Design Director": True,
             "Associate Producer": True, "Junior Designer": True, "Director": False,
             "Associate, Strategy": True}
    got = values("t string", [(t,) for t in cases],
                 gates.seniority_gate(F.lower("t"), CFG))
    assert dict(zip(cases, got)) == cases


def test_function_gate_order(values):
    cases = {"Director of Engineering": False, "Associate Director of Engineering": True,
             "CTO": False, "Director": False, "Visual Design Director": True,
             "Design Director": False, "VP of Product, User Acquisition": True}
    got = values("t string", [(t,) for t in cases], gates.function_gate(F.lower("t"), CFG))
    assert dict(zip(cases, got)) == cases


def test_compensation_gate(values):
    rows = [(None, None), (100000, None), (100000, 180000), (None, 174999), (None, 175000)]
    assert values("a long, b long", rows,
                  gates.compensation_gate(F.col("a"), F.col("b"), CFG)) == [
        False, True, False, True, False]


def test_leadership_levels(values):
    cases = {"chief of staff": 10.0, "vp of product": 9.0, "principal engineer": 1.0,
             "principal, strategy": 7.0, "director": 6.0, "team lead ": 4.0, "senior x": 3.0,
             "analyst": 1.0}
    got = values("t string", [(t,) for t in cases], weighted.leadership_level(F.col("t")))
    assert dict(zip(cases, got)) == cases


def test_weighted_score_by_hand(spark):
    """One posting whose ten categories are worked out by hand."""
    df = job(spark, title="VP of Strategy", company="Acme", remote=True, salary_max=230000,
             description="corporate strategy with global scope")
    row = weighted.weighted_score(df, CFG).collect()[0]
    b = row["score_breakdown"]
    assert b["role_fit"] == round((2 + 0 + 0 + 9 + 10 + 10) / 6, 2)
    assert b["industry_alignment"] == 3.0 and b["geographic"] == 10.0
    assert b["compensation"] == 7.5 and b["passion_identity"] == 0.0
    assert b["work_life_quality"] == 7.0 and b["company_health"] == 7.0
    assert b["career_trajectory"] == (9 + 6 + 8 + 6) / 4 and b["cultural_alignment"] == 3.0
    w = CFG.weights
    raw = sum(v * w[k] for k, v in b.items() if k != "role_fit") + 31 / 6 * w["role_fit"]
    assert row["score"] == round(raw * 10)
    assert row["gates_triggered"] == [] and row["modifiers_applied"] == []


def test_gated_rows_score_zero(spark):
    rows = weighted.weighted_score(job(spark, rows=[
        {"job_id": "1", "title": "Senior Software Engineer", "remote": True},
        {"job_id": "2", "title": "Marketing Intern", "salary_max": 1000}]), CFG).collect()
    got = {r["job_id"]: r for r in rows}
    assert all(r["score"] == 0 and r["tier"] == "skip" and r["score_breakdown"] == {}
               for r in rows)
    assert got["1"]["gates_triggered"] == ["function"]
    assert got["2"]["gates_triggered"] == ["seniority", "compensation"]


def test_scores_stay_in_range(spark):
    from catalog import bindings as B
    d = "/root/testdata/sf0.001"
    low, high = weighted.weighted_score(B.postings(spark, d), CFG, B.companies(spark, d)).agg(
        F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 100


def test_tiers(values):
    cases = {78: "T1", 77: "T2", 65: "T2", 64: "T3", 50: "T3", 35: "watchlist", 34: "skip"}
    got = values("s int", [(s,) for s in cases], weighted.tier_from_score(F.col("s"), CFG))
    assert dict(zip(cases, got)) == cases


def test_engagement_labels(values):
    cases = [("Interim CTO", "", "interim_fractional"), ("Board Advisor", "", "advisor"),
             ("Payments Lead (Contract)", "", "contract"), ("VP", "we use a day rate", "contract"),
             ("VP", "", "fulltime"), ("", "", "unclear"), (None, None, "unclear"),
             ("VP (Contract)", "fractional cto", "contract")]
    got = values("t string, d string", [c[:2] for c in cases],
                 classify.engagement_type(F.col("t"), F.col("d")))
    assert got == [c[2] for c in cases]


def test_excluded_titles_do_not_fall_back_to_the_description(spark):
    cfg = CFG.with_(role_types={"engineering": {
        "title_keywords": ["engineer"], "title_excludes": ["vp"],
        "description_keywords": ["code"]}})
    df = job(spark, rows=[{"job_id": "1", "title": "VP Engineering", "description": "code"},
                          {"job_id": "2", "title": "Founder", "description": "code"},
                          {"job_id": "3", "title": "Engineer"}])
    got = {r["job_id"]: r["role_types"] for r in classify.classify(df, cfg).collect()}
    assert got == {"1": [], "2": ["engineering"], "3": ["engineering"]}


def test_quality_of_life(values):
    as_of = F.lit("2026-04-20 00:00:00").cast("timestamp")
    rows = [("remote", 180000, None, "2026-04-10 00:00:00", "RSU"),
            ("Hybrid", 0, 200000, "2026-04-06 00:00:00", ""), (None, None, None, None, None),
            ("onsite", 100000, 300000, "2026-05-01 00:00:00", "dental")]
    b = classify.qol_breakdown(F.col("m"), F.col("a"), F.col("b"),
                               F.col("p").try_cast("timestamp"), F.col("d"), as_of, CFG)
    got = values("m string, a long, b long, p string, d string", rows, b, classify.qol_score(b))
    assert [g[1] for g in got] == [80, 50, 0, 40]
    assert list(got[1][0]) == ["work_mode_hybrid", "salary_listed", "salary_above_floor"]


def test_config_accepts_both_shapes(tmp_path):
    flat = config_from_dict({"tiers": {"T1": 80}, "modifier_deltas": {"tcg_ccg": 4}})
    nested = config_from_dict({"tiers": {"T1": {"min_score": 80}},
                               "modifier_deltas": {"tcg_ccg": {"delta": 4}}})
    assert flat.tiers == nested.tiers == {"T1": 80, "T2": 65, "T3": 50, "watchlist": 35}
    assert flat.modifier_deltas["tcg_ccg"] == nested.modifier_deltas["tcg_ccg"] == 4
    path = tmp_path / "c.yaml"
    path.write_text('{"unpaid_phrases": ["Free Work"], "unknown": 1}')
    assert load_config(str(path)).unpaid_phrases == ["free work"]


@pytest.mark.parametrize("kind", ["function_titles", "positive_signals"])
def test_dictionaries_as_rows(spark, kind):
    rows = CFG.to_df(spark).where(F.col("kind") == kind).count()
    value = getattr(CFG, kind)
    assert rows == (len(value) if isinstance(value, list) else sum(map(len, value.values())))


def test_facet_labels_list_only_tiers_in_use(spark):
    companies = spark.createDataFrame([("S",), ("2",), (None,), (" s ",)], "tier string")
    rows = classify.facet_labels(spark, CFG, companies).where(
        "facet = 'company_groups' AND value LIKE 'tier%'").orderBy("ord").collect()
    assert [(r["value"], r["label"]) for r in rows] == [("tier_s", "Tier S"),
                                                        ("tier_2", "Tier 2")]


def test_shards_partition_the_table(spark):
    from rolesift.operators.tables import shard
    ids = spark.range(500).selectExpr("concat('s:', id) AS job_id")
    parts = [{r[0] for r in shard(ids, i, 4).collect()} for i in range(4)]
    assert sum(map(len, parts)) == 500 == len(set().union(*parts))


def test_classifiers_read_the_prefilters_text(spark):
    """Shared or read anew, also where parts of the text are missing."""
    rows = [(f"{n}", t, c, d) for n, (t, c, d) in enumerate(
        (t, c, d) for t in ("VP of Product", "", None, "Data Analyst") for c in ("Acme Games", "", None)
        for d in ("esports and live ops, fractional", "", None, "payments fintech"))]
    df = spark.createDataFrame(rows, "job_id string, title string, company string, description string") \
        .withColumns({"company_normalized": F.lower("company"), "company_tier": F.lit(None).cast("string"),
                      "location": F.lit("NYC")})
    alone = classify.classify(df, CFG)
    shared = classify.classify(prefilter(df, CFG, None, classify.text_phrases(CFG), "_f"), CFG, "_f")
    columns = ["job_id", "industries", "role_types", "company_group"]
    assert sorted(alone.select(columns).collect()) == sorted(shared.select(columns).collect())
    verdict = ["job_id", "prefilter_reason", "soft_warnings", "positive_signals", "industry", "track"]
    assert sorted(prefilter(df, CFG).select(verdict).collect()) \
        == sorted(shared.select(verdict).collect())
