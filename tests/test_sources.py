import json
import random
import re
import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolesift.functions import thread as TH
from rolesift.operators.companies import company_rows
from rolesift.plans.ingest import normalize_archive
from rolesift.session import shared_folder
from rolesift.sources import archive as A
from rolesift.sources import html_cards
from rolesift.sources.html_cards import (LINK, Pick, anchor_cards, cut_cards, extract_cards,
                                         html_fields)
from rolesift.sources.specs import SPECS, normalize_posting, normalize_source, sheet_jobs
from rolesift.sources.thread import thread_jobs

NOW = datetime(2026, 4, 20)


def normalized(spark, name, *payloads):
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
    return normalize_source(df, SPECS[name], F.lit(NOW)).collect()


def card(spark, name, href, html):
    df = spark.createDataFrame([(href, "https://x" + href, html)],
                               "href string, url string, card_html string")
    return normalize_source(df, SPECS[name], F.lit(NOW)).collect()


META = {"name": "Acme", "ats_slug": "acme", "tier": "1", "industry": "x"}


def test_remoteok(spark):
    rows = normalized(spark, "remoteok", {"legal": "notice"},
                      {"id": 7, "position": "Dev", "company": "Acme, Inc.", "epoch": 1776340800,
                       "date": "2020-01-01", "salary_min": 0, "salary_max": 90000})
    assert len(rows) == 1
    r = rows[0]
    assert (r["job_id"], r["company_normalized"], r["location"], r["remote"]) == \
        ("remoteok:7", "acme", "Remote", True)
    assert (r["salary_min"], r["salary_max"]) == (None, 90000)
    assert r["posted_at"] == datetime(2026, 4, 16, 12)
    assert (r["status"], r["track"], r["score"]) == ("active", "unscored", 0)
    assert r["score_posted"] == "0000#2026-04-16T12:00:00Z"


def test_lever_milliseconds_and_workplace(spark):
    base = {"id": "a", "text": " VP ", "createdAt": 1776340800000, "_company_meta": META}
    rows = normalized(spark, "lever", {**base, "workplaceType": "remote"},
                      {**base, "id": "b", "workplaceType": "onsite"},
                      {**base, "id": "c", "workplaceType": "hybrid"}, {**base, "text": " "})
    assert [r["remote"] for r in rows] == [True, False, None]
    assert rows[0]["job_id"] == "lever:acme:a" and rows[0]["company_tier"] == "1"
    assert rows[0]["posted_at"] == datetime(2026, 4, 16, 12)


def test_ashby_keeps_unknown_remote_apart_from_false(spark):
    rows = normalized(spark, "ashby", *[
        {"id": i, "title": "VP", "isRemote": v, "_company_meta": META}
        for i, v in enumerate([True, False, None])])
    assert [r["remote"] for r in rows] == [True, False, None]
    assert all(r["posted_at"] == NOW for r in rows)


def test_greenhouse_location_shapes(spark):
    rows = normalized(spark, "greenhouse",
                      {"id": 1, "title": "VP", "location": {"name": "NYC"}, "_company_meta": META,
                       "content": "<p>A&amp;B</p>"},
                      {"id": 2, "title": "VP", "location": "Plain", "_company_meta": META})
    assert [r["location"] for r in rows] == ["NYC", "Plain"]
    assert rows[0]["description"] == "A&B"


def test_workday_ids_and_relative_dates(spark):
    wd = {"base_url": "https://wd", "tenant": "acme", "site": "jobs"}
    rows = normalized(spark, "workday",
                      {"title": "VP", "externalPath": "/job/x_R1", "bulletFields": ["R1"],
                       "postedOn": "Posted 5 Days Ago", "_workday": wd, "_company_meta": META},
                      {"title": "VP", "externalPath": "/job/x_R2", "bulletFields": [],
                       "_workday": wd, "_company_meta": META}, {"title": "VP"})
    assert [r["job_id"] for r in rows] == ["workday:acme:R1", "workday:acme:x_R2"]
    assert rows[0]["posted_at"] == datetime(2026, 4, 15)
    assert rows[0]["url"] == "https://wd/jobs/job/x_R1"


def test_one_bad_payload_does_not_stop_a_source(spark):
    df = spark.createDataFrame([("remoteok", "{broken"), ("remoteok", json.dumps(
        {"id": 1, "title": "VP", "company": "A"})), ("lever", "[]")],
        "source string, payload string")
    rows, failed = normalize_archive(df, F.lit(NOW))
    assert [r["job_id"] for r in rows.collect()] == ["remoteok:1"] and failed == {}


def test_cards_of_listing_sites(spark):
    r = card(spark, "hitmarker", "/jobs/vp-1/",
             "<a><img alt='Acme Logo'><p class='font-bold'>VP</p><div><span>Austin, TX</span>"
             "</div></a>")[0]
    assert (r["native_id"], r["title"], r["company"], r["location"]) == \
        ("vp-1", "VP", "Acme", "Austin, TX")
    r = card(spark, "games_career", "/Joboffer/42/x",
             "<div><span itemprop=title>VP</span><div itemprop=hiringOrganization>"
             "<b itemprop=name>Acme</b> AG</div><div itemprop=jobLocation>Remote</div>"
             "<time itemprop=datePosted datetime='2026-04-01'></time></div>")[0]
    assert (r["native_id"], r["company"], r["location"], r["remote"]) == \
        ("42", "Acme", "Remote", True)
    assert r["posted_at"] == datetime(2026, 4, 1)
    r = card(spark, "remote_game_jobs", "/jobs/vp",
             "<div class='job-box'><a href='/jobs/vp' title='Acme is hiring VP (Remote Job)'></a>"
             "</div>")[0]
    assert (r["company"], r["title"], r["location"]) == ("Acme", "VP", "Remote")
    assert card(spark, "outscal", "/job/x", "<a><p class='font-medium'>Acme</p></a>") == []


def test_picks(spark):
    df = spark.createDataFrame([("<div><i class='pin'></i><b>x</b><p>a<br>b <i>c</i></p>"
                                 "<p class='z'>d</p></div>",), (None,)], "html string")
    got = html_fields(df, {
        "next": Pick(cls="pin", next_sibling=True), "all": Pick(tags=("p",), many=True),
        "bare": Pick(tags=("p",), bare=True, many=True),
        "up": Pick(tags=("b",), up="div", sep="|"), "none": Pick(tags=("h1",))}).collect()
    assert tuple(got[0])[1:] == ("x", ["a b c", "d"], ["a b c"], "x|a|b|c|d", None)
    assert tuple(got[1])[1:] == (None, [], [], None, None)


def test_cards_are_cut_once_per_link(spark):
    page = ("<div class='job-box'><div>n</div><a href='/jobs/1'>A</a></div>"
            "<div class='job-box'><a href='/jobs/2'>B</a></div>")
    df = spark.createDataFrame([(1, page), (2, page)], "page_id long, html string")
    box = Pick(tags=("div",), cls=r"\bjob-box\b")
    got = extract_cards(df, "/jobs/", "https://x", box).orderBy("href").collect()
    assert [(r["href"], r["url"], r["page_id"]) for r in got] == [
        ("/jobs/1", "https://x/jobs/1", 1), ("/jobs/2", "https://x/jobs/2", 1)]
    assert "<div>n</div>" in got[0]["card_html"] and "/jobs/2" not in got[0]["card_html"]
    plain = extract_cards(df, "/jobs/", "https://x", LINK)
    assert plain.count() == 2


PICKS = {"title": Pick(tags=("h3",)), "all": Pick(tags=("p", "b"), many=True),
         "link": Pick(tags=("a",), take="href"), "leaf": Pick(tags=("div", "p"), leaf=True, many=True),
         "kin": Pick(tags=("b",), next_sibling=True, many=True), "up": Pick(
             tags=("b",), up="div", many=True), "in": Pick(tags=("b",), many=True, inside=Pick(
                 tags=("p",)))}


def random_html(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "p", "b", "h3", "a", "br", "section"])
        if tag == "br":
            out.append("<br>")
        elif depth > 4 or rng.random() < 0.3:
            out.append(rng.choice(["text", " x &amp; y ", "1 < 2", ""]))
        else:
            cls = " class='box'" if tag == "section" else " href='/j/1'" if tag == "a" else ""
            out.append(f"<{tag}{cls}>{random_html(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_fields_of_a_card_are_those_of_the_card_alone(spark):
    rng = random.Random(3)
    pages = [(i, random_html(rng)) for i in range(200)] + [
        (900, None), (901, ""), (902, "<section class='box'><b>open <section class='box'><p>deep")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    cut = df.select("page_id", F.posexplode(cut_cards(
        Pick(tags=("section",), cls="box"), LINK, PICKS)("html")).alias("pos", "c"))
    rows = cut.select("page_id", "pos", "c.html", "c.f.*").collect()
    alone = {(r["page_id"], r["pos"]): r for r in html_fields(
        cut.select("page_id", "pos", F.col("c.html").alias("html")), PICKS).collect()}
    assert len(rows) > 100
    for r in rows:
        assert [r[n] for n in PICKS] == [alone[r["page_id"], r["pos"]][n] for n in PICKS]


@pytest.mark.parametrize("close", ["</i></div>", "", "</b>"])
def test_deep_and_unclosed_pages_are_read_in_one_pass(close):
    """5,000 and 20,000 levels: the time grows with the page, not with its square."""
    seconds = []
    for levels in (5_000, 20_000):
        page = "".join(f"<div class='c'><i>t{k}<p>x" for k in range(levels)) + close * levels
        start = time.process_time()
        tree = html_cards._Tree(page)
        scopes = [html_cards._Scope(tree, tree.nodes[k]) for k in tree.hits(CARD)]
        got = [(s.read(PICKS["title"]), s.read(FIRST)) for s in scopes]
        seconds.append(time.process_time() - start)
        assert len(got) == levels and got[0] == (None, "c")
    assert seconds[1] < 12 * seconds[0] + 1


CARD, FIRST = Pick(tags=("div",), cls="c"), Pick(tags=("div",), take="class")


def test_unclosed_anchors_do_not_rescan_the_page(spark):
    html = "<a href='/1'>one</a> <a name='x'>no</a><a href='/2'>two <a href='/3'>in</a>" \
        "<a href='/4'>open" + "<a href='/5'>x" * 20_000
    df = spark.createDataFrame([(1, html), (2, "</a>"), (3, None), (4, "")],
                               "page_id long, html string")
    start = time.time()
    got = [(r["page_id"], r["pos"], r["href"]) for r in anchor_cards(df).collect()]
    assert got == [(1, 0, "/1"), (1, 1, "/2")] and time.time() - start < 30


def test_lists_feeds_and_archive(spark):
    df = spark.createDataFrame([('{"jobs": [{"a": 1}, 2, "x", {"a": 3}]}',), ('[{"a": 4}]',),
                                ('{"jobs": 5}',), ("{oops",)], "body string")
    got = [json.loads(r["payload"])["a"] for r in A.explode_payload(df).collect()]
    assert sorted(got) == [1, 3, 4]
    feed = ("<rss><channel><item><title>A: B</title></item><item><title>C: D</title></item>"
            "</channel></rss>")
    feeds = spark.createDataFrame([(feed,), ("<rss><channel><item>",)], "body string")
    assert sorted(r["title"] for r in A.read_rss(feeds).collect()) == ["A: B", "C: D"]
    root = f"{shared_folder(spark)}/raw"
    raw = spark.createDataFrame([("lever", NOW, "{}"), ("ashby", NOW, "{}")],
                                "source string, run_ts timestamp, payload string")
    A.write_raw(raw, root)
    A.write_raw(raw.limit(1), root)
    back = A.read_raw(spark, root, ["lever"], F.lit(NOW))
    assert back.count() in (2, 1) and {r["source"] for r in back.collect()} == {"lever"}
    assert A.read_raw(spark, root).count() == 3


def test_sheets_with_other_headers(spark, tmp_path):
    path = f"{shared_folder(spark)}/sheet.csv"
    with open(path, "w", encoding="utf-8") as fh:
        fh.write('﻿Employer,Job Title,City,Link\nAcme,"VP, Ops",NYC,https://x/jobs/77/\n'
                 "Acme,,NYC,\nBeta,CTO,,\n")
    rows = normalize_posting(sheet_jobs(A.read_sheet(spark, path)), "asgc_sheet",
                             F.lit(NOW)).collect()
    assert [(re.sub("row-[0-9A-Fa-f]+$", "row-#", r["job_id"]), r["title"], r["remote"])
            for r in rows] == [("asgc_sheet:77", "VP, Ops", None),
                               ("asgc_sheet:row-#", "CTO", None)]


def test_company_records(spark):
    rows = company_rows(spark, [{"name": "Acme", "tier": 1}, {"name": None}, {"name": "ACME"}])
    assert [(r["company_name_normalized"], r["company_name"]) for r in rows.collect()] == [
        ("acme", "ACME")]


def test_thread_posts(spark):
    texts = {
        1: "Acme | Senior Engineer | Austin, TX | REMOTE | $180k-$220k. We raised $10m - $20m.",
        2: "Head of Engineering | Remote | https://fetlife.com/jobs/head",
        3: "CVector | Backend Developer | NYC",
        4: "Head of Platform | Chicago | Full-Time",
        5: "We are hiring | now", 6: "Just a comment", 7: "",
        8: "Staff Engineer | Chicago | Beta Labs | Onsite",
    }
    df = spark.createDataFrame([(k, f"<p>{v}</p>", "2026-04-01T00:00:00Z")
                                for k, v in texts.items()],
                               "comment_id long, text string, created_at string")
    got = {int(r["native_id"]): r for r in thread_jobs(df).collect()}
    assert sorted(got) == [1, 2, 3, 8]
    assert (got[1]["company"], got[1]["title"], got[1]["remote"]) == \
        ("Acme", "Senior Engineer", True)
    assert (got[1]["salary_min"], got[1]["salary_max"]) == (180000, 220000)
    assert (got[2]["company"], got[2]["title"]) == ("Fetlife", "Head of Engineering")
    assert (got[3]["company"], got[3]["title"]) == ("CVector", "Backend Developer")
    assert (got[8]["company"], got[8]["title"]) == ("Beta Labs", "Staff Engineer")


def test_segment_tests(values):
    rows = [("Senior Engineer",), ("https://x.io/engineer",), ("Mountain View, CA",),
            ("Now hiring engineers",), ("Acme",), ("Chicago",), ("$150k",), ("(Remote)",)]
    got = values("t string", rows, TH.is_title(F.col("t")), TH.is_place(F.col("t")),
                 TH.is_company(F.col("t")))
    assert got == [(True, False, False), (False, False, False), (False, True, False),
                   (False, False, True),
                   (False, False, True), (False, False, False), (False, False, False),
                   (False, True, False)]


def test_cards_of_a_large_batch_are_not_held_together(spark):
    pages = pd.Series([f"<a href='/jobs/{i}'>x</a>" for i in range(500)] + [None])
    cut = cut_cards(LINK, LINK, keep_html=False).func(iter([pages, pages[:0]]))
    parts = [next(cut)]
    assert len(parts[0]) < 100
    parts.extend(cut)
    links = [[c["href"] for c in cards] for part in parts for cards in part]
    assert links == [[f"/jobs/{i}"] for i in range(500)] + [[]]


ODD = ["<!-- note -->", "<!DOCTYPE html>", "<!-- a > b -->", "<br/>", "<p/>", "<IMG Alt='A&amp;b' x>",
       "<a href=/j>", "<div class = 'c'>", "<i a='1'b='2'>", "<b x='>'>", "</ p >", "</p x>", "</>", "&lt;",
       "&am", "a<b", "<script>if (a<b) '</p>'</script>", "<title>x<b></title>", "<?php x ?>", "<",
       "<span", "<a href='x", "\r\n", "\x1f", "<p\x00>", "<em\n title=\"q\" />"]


def test_plain_pages_are_read_as_the_library_reads_them(monkeypatch):
    """Marks cut from plain pages against the standard parser, odd markup included."""
    def seen(page):
        tree = html_cards._Tree(page)
        return ([(m.tag, m.attrs) for m in tree.marks], tree.parent, tree.start, tree.end, tree.last,
                tree.piece, tree.last_piece, tree.pieces)

    rng, pages, plain = random.Random(5), [], []
    for n in range(1500):
        cut = random_html(rng).replace("1 < 2", "1 &lt; 2")
        for _ in range(n % 3):
            at = rng.randrange(len(cut) + 1)
            cut = cut[:at] + rng.choice(ODD) + cut[at:]
        pages.append(cut)
    fast = html_cards._Tree._plain
    monkeypatch.setattr(html_cards._Tree, "_plain",
                        lambda tree, page: plain.append(fast(tree, page)) or plain[-1])
    got = [seen(page) for page in pages]
    assert sum(plain) > 500 and not all(plain)
    monkeypatch.setattr(html_cards._Tree, "_plain", lambda tree, page: False)
    for page, value in zip(pages, got):
        assert seen(page) == value, page


def test_a_plain_page_costs_no_parser(monkeypatch):
    monkeypatch.setattr(html_cards, "_Parser", None)
    tree = html_cards._Tree("<html><div class='c'><p>a &amp; b<br></div></html>")
    assert tree.pieces == ["a & b"] and tree.hits(CARD) == [1]


def test_repeated_links_keep_the_place_of_their_first_card(spark):
    page = "<div class='c'><a href='/1'></a><p>x</p></div>" \
        "<div class='c'>none</div><div class='c'><a href='/1'></a><p>y</p></div>" \
        "<div class='c'><a href='/2'></a></div>"
    df = spark.createDataFrame([(7, page), (8, page), (9, None)], "page_id long, html string")
    got = html_cards.card_fields(df, CARD, "/", "https://x.io", {"p": Pick(tags=("p",))}).collect()
    assert sorted((r["page_id"], r["pos"], r["href"], r["p"]) for r in got) == [
        (7, 0, "/1", "x"), (7, 3, "/2", None)]


def test_cards_of_one_shape_make_one_tree(monkeypatch):
    made, tree = [], html_cards._Tree
    monkeypatch.setattr(html_cards, "_Tree", lambda *args: made.append(1) or tree(*args))
    body = ("<div><a data-id='job-card-title'>{0}</a><img data-id='company-img' alt='Acme {0}'><div "
            "class='bounded-attribute-section'><div><div><i class='fa-location-dot'></i></div><span>"
            "{0} &amp; b</span></div></div></div>")
    cards = [body.format(i) for i in range(50)]
    odd = ["", "a < b", "<p>x", "</p>", "<b class='company'>c", body.format(" "), "t<br/>u",
           "<script>a<b</script><h2>h</h2>", "<i class='fa-location-dot'></i>"]
    for limit in (None, 3):
        if limit:
            for name in ("KNOWN_MARKS", "KNOWN_SHAPES", "SHAPE_LENGTH"):
                monkeypatch.setattr(html_cards, name, limit)
        for spec in (s for s in SPECS.values() if s.picks):
            reader = html_cards._Reader(spec.picks)
            for card in [*cards, *odd, *cards]:
                scope = html_cards._Scope(tree(card))
                assert reader.read(card) == [scope.read(p) for p in spec.picks.values()]
    made.clear()
    reader = html_cards._Reader(SPECS["builtinnyc"].picks)
    monkeypatch.undo()
    monkeypatch.setattr(html_cards, "_Tree", lambda *args: made.append(1) or tree(*args))
    for i, card in enumerate(cards):
        assert reader.read(card)[6] == [f"{i} & b"]
    assert len(made) == 1                       # one for each card before
