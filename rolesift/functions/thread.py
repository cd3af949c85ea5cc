"""Pipe-separated hiring posts: which segment is the title, the company, the place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.normalize import company_from_host
from rolesift.functions.text import any_of, any_pattern, strip

# Words that mark a segment as a role.
ROLE_WORDS = [
    "engineer", "developer", "programmer", "swe", "sre", "devops", "architect", "designer",
    "ux", "ui ", "manager", "director", "head of", " vp ", "vice president", "lead",
    "principal", "staff", "senior", "junior", "intern", "founder", "co-founder", "cofounder",
    "officer", "chief", "ceo", "cto", "cfo", "coo", "cmo", "scientist", "researcher",
    "analyst", "consultant", "specialist", "product", "marketing", "sales", "operations",
    "ops ", "machine learning", "writer", "editor", "support", "success", "advocate",
    "founding", "first ",
]
# Fixed value: whole words strong enough to put the title first.
STRONG_ROLE = (
    r"\b(?:"
    r"engineer|engineers|developer|developers|architect|architects"
    r"|manager|managers|director|directors"
    r"|head\s+of|vp\s+of|vp|vice\s+president"
    r"|lead|leads|principal|staff|senior|junior"
    r"|founder|founders|co[\-\s]?founder|cofounder|founding"
    r"|officer|chief|ceo|cto|cfo|coo|cmo"
    r"|scientist|scientists|researcher|researchers"
    r")\b")
# Place and remote words.
PLACE_WORDS = [
    "remote", "onsite", "on-site", "hybrid", "anywhere", "us only", "us-only", "europe",
    "emea", "apac", "americas", "north america", "worldwide", "global", "us/eu", "us / eu",
]
# First segments that are not titles.
BOILERPLATE = [
    "posted job description", "job description", "we are hiring", "we're hiring",
    "now hiring", "open positions", "open roles", "multiple roles",
]
# Whole segments that are not companies.
NOT_COMPANIES = [
    "nyc", "ny", "new york", "new york city", "new york, ny", "sf", "san francisco",
    "san francisco, ca", "bay area", "la", "los angeles", "seattle", "boston", "chicago",
    "austin", "denver", "philadelphia", "portland", "atlanta", "nashville", "dallas",
    "houston", "pittsburgh", "baltimore", "minneapolis", "washington dc", "washington, dc",
    "dc", "miami", "detroit", "cleveland", "san diego", "phoenix", "brooklyn", "manhattan",
    "oakland", "palo alto", "mountain view", "new jersey", "nj", "london", "paris", "berlin",
    "cologne", "munich", "hamburg", "amsterdam", "dublin", "stockholm", "copenhagen",
    "helsinki", "madrid", "barcelona", "zurich", "geneva", "vienna", "tokyo", "singapore",
    "hong kong", "sydney", "melbourne", "toronto", "vancouver", "montreal",
    "cologne, germany", "london, uk", "berlin, germany", "full-time", "full time",
    "fulltime", "part-time", "part time", "parttime", "contract", "contractor",
    "contract-to-hire", "intern", "internship", "freelance", "freelancer", "w2", "1099",
    "c2c", "visa", "visa sponsorship", "no visa", "permanent", "perm", "temp", "temporary",
    "usa", "uk", "eu", "emea", "us based", "us-based",
]
# Tokens that mark a location segment, matched inside words too.
LOCATION_TOKENS = ["remote", "ny", "sf", "us", "uk", "eu", "europe", "onsite", "hybrid"]
URL_ANYWHERE = r"https?://"


def head_of(text: Column) -> Column:
    """First sentence when it has pipes, else the first line."""
    sentence = F.substring_index(text, ". ", 1)
    return F.when(F.contains(sentence, F.lit("|")), sentence) \
        .otherwise(F.substring_index(text, "\n", 1))


def segments(text: Column) -> Column:
    """Non-empty, trimmed segments of the head."""
    return F.filter(F.transform(F.split(head_of(text), r"\|"), strip), lambda s: s != "")


def is_place(seg: Column) -> Column:
    s = F.lower(strip(seg))
    return (s == "") | seg.rlike(r",\s*[A-Z]{2}\b") | any_of(s, PLACE_WORDS) \
        | (F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")")))


def is_title(seg: Column) -> Column:
    """Has a role word and is neither a URL nor boilerplate nor overlong."""
    s = F.lower(strip(seg))
    return (s != "") & (F.length(s) <= 200) & ~any_pattern(seg, [URL_ANYWHERE]) \
        & ~any_of(s, BOILERPLATE) & any_of(s, ROLE_WORDS)


def is_strong_title(seg: Column) -> Column:
    return is_title(seg) & any_pattern(seg, [STRONG_ROLE])


def is_company(seg: Column) -> Column:
    s = strip(seg)
    pay = F.contains(s, F.lit("$")) & s.rlike(r"\d")
    return (s != "") & (F.length(s) <= 80) & ~any_pattern(s, [URL_ANYWHERE]) & ~is_place(s) \
        & ~is_title(s) & ~pay & ~F.lower(s).isin(NOT_COMPANIES)


def assign(text: Column, parts: Column) -> Column:
    """struct(title, company, location); title or company is NULL when the post is skipped.

    A strong title in front is swapped with the employer from the first URL's host, or
    with the first company-like segment. Otherwise the first segment is the company and
    the first title-like segment after it is the title.
    """
    first = F.get(parts, 0)
    rest = F.slice(parts, 2, F.size(parts))
    title_first = (F.size(parts) >= 2) & is_strong_title(first)
    employer = F.coalesce(company_from_host(text), F.get(F.filter(rest, is_company), 0))
    title = F.when(title_first, first).otherwise(F.get(F.filter(rest, is_title), 0))
    company = F.when(title_first, employer).otherwise(first)
    ok = (F.length(company) <= 80) & (F.length(title) <= 200) & (company != "")
    place = F.get(F.filter(F.slice(parts, 3, F.size(parts)),
                           lambda s: any_of(F.lower(s), LOCATION_TOKENS)), 0)
    return F.struct(F.when(ok, title).alias("title"), F.when(ok, company).alias("company"),
                    place.alias("location"))
