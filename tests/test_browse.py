import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolesift.operators import browse as B

SCHEMA = ("job_id string, title string, company string, company_normalized string, "
          "company_group string, company_tier string, score int, qol_score int, track string, "
          "engagement_type string, work_mode string, industries array<string>, "
          "role_types array<string>, salary_min long, salary_max long, posted_at timestamp, "
          "semantic_score int, semantic_rationale string, status string, source string, "
          "location string, url string")
DAY = datetime(2026, 4, 16)


def table(spark, *rows):
    base = dict(job_id="a:1", title="VP", company="Acme", company_normalized="acme",
                company_group=None, company_tier=None, score=50, qol_score=None, track=None,
                engagement_type=None, work_mode=None, industries=None, role_types=None,
                salary_min=None, salary_max=None, posted_at=DAY, semantic_score=None,
                semantic_rationale=None, status="active", source="a", location=None, url="u")
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SCHEMA)


def duplicates(spark):
    return table(
        spark, dict(job_id="greenhouse:1", title="VP of Product", score=60, source="greenhouse"),
        dict(job_id="linkedin:1", title="  vp  OF product", score=72, source="linkedin"),
        dict(job_id="greenhouse:2", title="VP of Product", score=72, source="greenhouse"),
        dict(job_id="lever:9", title="Other", score=10, source="lever"))


def test_duplicates_collapse_to_the_best(spark):
    rows = B.browse(duplicates(spark)).collect()
    assert [r["job_id"] for r in rows] == ["greenhouse:2", "lever:9"]
    assert rows[0]["dupe_count"] == 3
    assert rows[0]["dupe_sources"] == ["greenhouse", "linkedin"]
    totals = B.page_totals(B.filter_status(duplicates(spark)), B.BrowseSpec()).first()
    assert (totals["raw_total"], totals["total"], totals["dupes_collapsed"]) == (4, 2, 2)
    assert totals["has_more"] is False and totals["next_offset"] is None


def test_rows_without_a_key_pass_through(spark):
    df = table(spark, dict(job_id="1", title=""), dict(job_id="2", title=""),
               dict(job_id="3", company_normalized=None))
    rows = B.dedup_postings(df).collect()
    assert len(rows) == 3 and all(r["dupe_count"] is None for r in rows)


def test_dedup_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [dict(job_id=f"{rng.choice('abc')}:{i}", score=rng.choice([None, 1, 5, 9]),
                 title="Hot" if i % 3 == 0 else f"T{rng.randint(0, 9)}",
                 company_normalized=rng.choice(["x", "y", ""])) for i in range(400)]
    for r in rows:
        r["source"] = r["job_id"][0]
    want, passed = {}, 0
    for r in sorted(rows, key=lambda r: r["job_id"]):
        if not r["company_normalized"]:
            passed += 1
            continue
        g = want.setdefault((r["company_normalized"], r["title"].lower()), [None, 0, []])
        if g[0] is None or (r["score"] or 0) > (g[0]["score"] or 0):
            g[0] = r
        g[1] += 1
        if r["source"] not in g[2]:
            g[2].append(r["source"])
    got = B.dedup_postings(table(spark, *rows).repartition(7)).collect()
    keyed = {r["job_id"]: (r["dupe_count"], r["dupe_sources"]) for r in got
             if r["dupe_count"] is not None}
    assert keyed == {g[0]["job_id"]: (g[1], g[2]) for g in want.values()}
    assert len(got) - len(keyed) == passed
    assert sum(n for n, _ in keyed.values()) + passed == len(rows)


def test_filters(spark):
    df = table(
        spark, dict(job_id="1", industries=["Gaming"], work_mode="Remote", salary_min=0,
                    salary_max=200000),
        dict(job_id="2", engagement_type="contract", location="Newark, NJ", salary_min=90000),
        dict(job_id="3", status="archived"))

    def ids(**spec):
        return [r["job_id"] for r in B.apply_filters(df, B.BrowseSpec(**spec))
                .orderBy("job_id").collect()]
    assert ids() == ["1", "2"]
    assert ids(industries=["gaming", "x"]) == ["1"]
    assert ids(engagement_types=["unclear"]) == ["1"]
    assert ids(min_salary=150000) == ["1"]
    assert ids(min_salary=50000) == ["1", "2"]
    assert ids(q=" NEWARK ") == ["2"]
    assert ids(work_modes=["remote"]) == ["1"] and ids(min_qol=1) == []


def test_company_sort_keeps_best_first_inside(spark):
    df = table(spark, dict(job_id="1", company="beta", score=10),
               dict(job_id="2", company="Alpha", score=20),
               dict(job_id="3", company=" alpha ", score=90), dict(job_id="4", company="Beta",
                                                                   score=50))
    def order(by):
        return [r["job_id"] for r in df.orderBy(*B.sort_columns(by)).collect()]
    assert order("company_asc") == ["3", "2", "4", "1"]
    assert order("company_desc") == ["4", "1", "3", "2"]


def test_missing_pay_sorts_first_ascending(spark):
    df = table(spark, dict(job_id="1", salary_min=100), dict(job_id="2"),
               dict(job_id="3", salary_min=0, salary_max=50))
    asc = [r["job_id"] for r in df.orderBy(*B.sort_columns("comp", "asc")).collect()]
    assert asc == ["2", "3", "1"]


@pytest.mark.parametrize("by", B.SORTS)
def test_pages_are_disjoint_and_complete(spark, by):
    df = table(spark, *[dict(job_id=f"{i:03d}", score=i % 7, qol_score=i % 5,
                             title=f"t{i}", company=f"c{i % 4}",
                             posted_at=DAY + timedelta(days=i % 9)) for i in range(50)])
    spec = B.BrowseSpec(sort_by=by, limit=20)
    pages = [[r["job_id"] for r in B.paginate_offset(df, spec.with_(offset=o)).collect()]
             for o in (0, 20, 40)]
    flat = [j for p in pages for j in p]
    assert len(flat) == 50 and len(set(flat)) == 50
    assert flat == [r["job_id"] for r in df.orderBy(*B.sort_columns(by)).collect()]


def test_cursor_walk_sees_every_row_once(spark):
    df = table(spark, *[dict(job_id=f"{i:03d}") for i in range(30)]).withColumn(
        "score_posted", F.concat(F.lpad((F.crc32("job_id") % 5).cast("string"), 4, "0"),
                                 F.lit("#")))
    seen, after = [], None
    while True:
        page = B.paginate_cursor(df, 7, after)
        rows = page.collect()
        if not rows:
            break
        seen += [r["job_id"] for r in rows]
        cursor = B.next_cursor(page).first()
        after = (cursor["score_posted"], cursor["job_id"])
        assert after == (rows[-1]["score_posted"], rows[-1]["job_id"])
    assert len(seen) == 30 == len(set(seen))


def test_params_are_clamped():
    spec = B.browse_params({"limit": "999", "offset": "-1", "min_score": "200", "min_qol": "x",
                            "sort_by": "semantic", "sort_dir": "up", "dedup": "No",
                            "industries": " a,, b "})
    assert (spec.limit, spec.offset, spec.min_score, spec.min_qol) == (200, 0, 100, 0)
    assert (spec.sort_by, spec.sort_dir, spec.dedup) == ("score", "desc", False)
    assert spec.industries == ["a", "b"]
    assert B.browse_params(None) == B.BrowseSpec()


def test_salted_join_is_a_left_join(spark):
    from rolesift.operators.combine import salted_left_join
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = {tuple(r) for r in salted_left_join(big, dim, "k", 8).select("id", "k", "v").collect()}
    want = {tuple(r) for r in big.join(dim, "k", "left").select("id", "k", "v").collect()}
    assert got == want and len(got) == 1000
