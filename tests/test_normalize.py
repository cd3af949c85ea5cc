from datetime import datetime

from pyspark.sql import functions as F

from rolesift.functions import normalize as N
from rolesift.functions.html_text import fold_nfkd, strip_html_basic, strip_html_full



def as_of():
    return F.lit("2026-04-20 12:00:00").cast("timestamp")


def test_company_names(values):
    cases = {
        "Example": "example", "Example Corporation": "example", "Example, Inc.": "example",
        "L'Oréal SA": "l'oreal", "  Epic   Games  ": "epic games",
        "Example Studio (ES)": "example studio", "Foo (Bar) Inc.": "foo",
        "Foo Inc (Bar)": "foo", "Pty Pty Ltd": "pty", "Zoom Holdings Limited": "zoom",
        "Costco": "costco", "": "", "Cisco": "cisco", "A B Co": "a b", "Škoda AG": "skoda",
    }
    got = values("n string", [(n,) for n in cases], N.normalize_company(F.col("n")))
    assert dict(zip(cases, got)) == cases
    assert values("n string", [(None,)], N.normalize_company(F.col("n"))) == [""]


def test_accent_tables_line_up():
    assert len(N.ACCENTED) == len(N.UNACCENTED)


def test_salary_ranges(values):
    cases = {
        "$180k - $220k": (180000, 220000), "180k-220k": (180000, 220000),
        "$180,000 to $220,000": (180000, 220000), "competitive": (None, None),
        "1999-2024": (None, None),
        "$220k – $180k": (180000, 220000), "$180-220k": (None, 220000),
        "180000-220000": (180000, None), "10-20": (None, None),
    }
    got = values("t string", [(t,) for t in cases], N.parse_salary_range(F.col("t")))
    assert {t: tuple(g) for t, g in zip(cases, got)} == cases


def test_salary_lists(values):
    cases = {
        "$250,000 - $310,000": (250000, 310000), "$250K - $310K": (250000, 310000),
        "$45/hour - $60/hour": (None, None), "one $300,000 figure": (None, None),
        "USD 250000-310000": (250000, 310000), "$0.2M to $1.1M": (200000, 1100000),
    }
    got = values("t string", [(t,) for t in cases], N.parse_salary_list(F.col("t")))
    assert {t: tuple(g) for t, g in zip(cases, got)} == cases


def test_timestamps(values):
    cases = {
        "2026-04-16T12:00:00Z": "2026-04-16T12:00:00Z",
        "2026-04-16T12:00:00+02:00": "2026-04-16T10:00:00Z", "2026-04-16": "2026-04-16T00:00:00Z",
        "1776340800": "2026-04-16T12:00:00Z", "1776340800000": "2026-04-16T12:00:00Z",
        "not a date": None, "": None, "99999999999999999999": None,
        "Wed, 15 Apr 2026 10:00:00 +0000": None, "2026-04-16T12:00:00.123456Z":
        "2026-04-16T12:00:00Z",
    }
    got = values("t string", [(t,) for t in cases],
                 N.iso_z(N.canonical_timestamp(F.col("t"))))
    assert dict(zip(cases, got)) == cases


def test_other_dates(values):
    got = values("t string", [("Posted Today",), ("Posted Yesterday",), ("Posted 5 Days Ago",),
                              ("Posted 30+ Days Ago",), ("soon",)],
                 N.parse_relative_posted(F.col("t"), as_of()))
    assert got == [datetime(2026, 4, 20, 12), datetime(2026, 4, 19, 12),
                   datetime(2026, 4, 15, 12), datetime(2026, 3, 21, 12), None]
    assert values("t string", [("15 Apr 2026,",), ("15 April 2026",), ("x",)],
                  N.parse_month_date(F.col("t"))) == [datetime(2026, 4, 15)] * 2 + [None]
    assert values("t string", [("Wed, 15 Apr 2026 10:00:00 +0200",)],
                  N.parse_rfc822(F.col("t"))) == [datetime(2026, 4, 15, 8)]


def test_hosts_and_slugs(values):
    texts = ["https://fetlife.com/jobs/x", "at https://careers.acme.com", "no link",
             "https://boards.greenhouse.io/acme", "http://x.io"]
    assert values("t string", [(t,) for t in texts], N.company_from_host(F.col("t"))) == \
        ["Fetlife", "Acme", None, None, None]
    assert values("n string, c string", [("Riot Games", "riot"), ("Meow Wolf, Inc.", None)],
                  N.slug_candidates(F.col("n"), F.col("c"))) == [
        ["riot"], ["meow-wolf", "meowwolf", "meow"]]


def test_snippets(values):
    words = "word " * 60
    spaced = "a " + "b" * 300
    got = values("t string", [(words,), ("short",), ("x" * 300,), (spaced,), (None,)],
                 N.rationale_snippet(F.col("t")))
    assert got[0] == words[:words.rfind(" ", 0, 220)].rstrip() + "…"
    assert got[1:] == ["short", "x" * 220 + "…", spaced[:220] + "…", ""]


def test_salary_rendering(values):
    rows = [(180000, 220000), (0, 90000), (500, None), (None, None), (1500, 2500)]
    assert values("a long, b long", rows, N.salary_pretty(F.col("a"), F.col("b"))) == [
        "$180k – $220k USD", "$90k USD", "$500 USD", "", "$2k – $2k USD"]


def test_html(values):
    page = "<p>A&amp;B&nbsp;<b>C</b> &eacute; &#8203;</p>"
    assert values("h string", [(page,)], strip_html_basic(F.col("h"))) == ["A&B C &eacute;"]
    assert values("h string", [("<p>1 &lt; 2 &eacute; &#233;</p>",), (None,)],
                  strip_html_full(F.col("h"))) == ["1 < 2 é é", ""]
    assert values("h string", [("ﬁn Ａ é",)], fold_nfkd(F.col("h"))) == ["fin A e"]


def test_html_entities_without_semicolon(values):
    page = "<h1>A&amp;&amp</h1>&lt;b&copy; &#233; &amp;lt; &notit; &nosuch;"
    assert values("h string", [(page,), (None,)], strip_html_full(
        F.col("h"), closed_only=True)) == ["A&&amp <b© é &lt; &notit; &nosuch;", ""]
    assert values("h string", [("A &amp",)], strip_html_full(F.col("h"))) == ["A &"]
