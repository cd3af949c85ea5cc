"""Source specs: how each feed's payload becomes a posting.

A spec is data: the payload schema, the expressions for the intermediate fields and which
fields must be filled. ``normalize_source`` runs any spec.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import normalize as N
from rolesift.functions.html_text import strip_html_basic, strip_html_full
from rolesift.functions.text import any_of, computed_once, filled, strip
from rolesift.sources.html_cards import Pick, html_fields

RAW_FIELDS = {"native_id": "string", "title": "string", "company": "string", "url": "string",
              "location": "string", "description": "string", "posted_at": "string",
              "salary_min": "bigint", "salary_max": "bigint", "remote": "boolean",
              "company_tier": "string"}
META = "struct<name: string, ats_slug: string, tier: string, industry: string>"


@dataclass(frozen=True)
class SourceSpec:
    name: str
    schema: str                                   # DDL of the JSON payload, '' for cards
    fields: Callable[[Column], dict[str, Column]]
    required: tuple[str, ...] = ("native_id", "title", "company")
    picks: dict[str, Pick] = field(default_factory=dict)
    parse_posted: Callable[[Column, Column], Column] | None = None


def _text(c: Column) -> Column:
    """Value as it is, NULL when empty."""
    return F.nullif(c, F.lit(""))


def _or(*cols: Column) -> Column:
    return F.coalesce(*[_text(c) for c in cols])


def _pay(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c.try_cast("double").cast("long"), F.lit(0)) for c in cols])


def _flag(c: Column) -> Column:
    return F.lower(c).try_cast("boolean")


def _row(values: dict[str, Column]) -> list[Column]:
    return [F.coalesce(values[n], F.lit(None)).cast(k).alias(n) if n in values
            else F.lit(None).cast(k).alias(n) for n, k in RAW_FIELDS.items()]


def raw_jobs(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Intermediate rows of one source; incomplete payloads are left out."""
    if spec.schema:
        meta_in = "company_meta" in df.columns
        ddl = spec.schema + f", _company_meta {META}"
        parsed = df.withColumn("p", computed_once(F.from_json("payload", ddl)))
        meta = F.coalesce(F.col("company_meta"), F.col("p._company_meta")) if meta_in \
            else F.col("p._company_meta")
        source = parsed.withColumn("_meta", meta)
        values = spec.fields(F.col("p"))
    else:  # rows of ``card_fields`` have the fields already
        read = set(spec.picks) <= set(df.columns)
        source = df if read else html_fields(df, spec.picks, "card_html")
        values = spec.fields(F.lit(None))
    out = source.select(*_row(values))
    for name in spec.required:
        out = out.where(F.coalesce(F.col(name), F.lit("")) != "")
    return out


#: Why a payload is no posting. The first two are failures of the item, the last is a skip.
EMPTY, MALFORMED, INCOMPLETE = "empty payload", "malformed payload", "incomplete: "


def tagged_jobs(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Intermediate rows of every payload of a JSON source, none left out.

    ``reason`` says why a payload is no posting: it is null or blank, it does not parse as one
    JSON object of the spec's schema, or required fields are empty, which names them. It is
    null for good rows. The columns of ``df`` are kept; ``company_meta`` is used where present.
    """
    ddl = spec.schema + f", _company_meta {META}, _malformed string"
    options = {"columnNameOfCorruptRecord": "_malformed"}
    # Anything but an object, an unfinished one included, is no record of the source.
    body = F.when(F.startswith(F.ltrim("payload"), F.lit("{")), F.col("payload"))
    parsed = df.withColumn("_p", computed_once(F.from_json(body, ddl, options)))
    meta = F.col("_p._company_meta")
    if "company_meta" in df.columns:
        meta = F.coalesce(F.col("company_meta"), meta)
    rows = parsed.withColumn("_meta", meta).select(
        *df.columns, F.col("_p").isNull().alias("_none"), F.col("_p._malformed").alias("_bad"),
        *_row(spec.fields(F.col("_p"))))
    lacks = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in spec.required]))
    blank = F.trim(F.coalesce("payload", F.lit(""))) == ""
    reason = F.when(blank, EMPTY).when(F.col("_none") | F.col("_bad").isNotNull(), MALFORMED) \
        .when(F.size(lacks) > 0, F.concat(F.lit(INCOMPLETE), F.array_join(lacks, ", ")))
    return rows.withColumn("reason", reason).drop("_none", "_bad")


def normalize_posting(raw: DataFrame, source: str | Column, as_of: Column,
                      parse_posted: Callable[[Column, Column], Column] | None = None,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """Intermediate rows to posting rows: keys, dates, defaults; ``keep`` passes through."""
    src = F.lit(source) if isinstance(source, str) else source
    posted = F.col("posted_at")
    when = parse_posted(posted, as_of) if parse_posted else N.canonical_timestamp(posted)
    posted_at = F.coalesce(when, as_of)
    return raw.select(
        N.job_id(src, F.col("native_id")).alias("job_id"), src.alias("source"), "native_id",
        "title", "company", N.normalize_company(F.col("company")).alias("company_normalized"),
        F.coalesce("url", F.lit("")).alias("url"), _text(F.col("location")).alias("location"),
        _text(F.col("description")).alias("description"), "remote", "salary_min",
        "salary_max", posted_at.alias("posted_at"), as_of.alias("scraped_at"),
        F.lit("active").alias("status"), F.lit("unscored").alias("track"),
        F.lit(0).alias("score"),
        N.score_posted(F.lit(0), N.iso_z(posted_at)).alias("score_posted"), "company_tier",
        *keep)


def normalize_source(df: DataFrame, spec: SourceSpec, as_of: Column) -> DataFrame:
    return normalize_posting(raw_jobs(df, spec), spec.name, as_of, spec.parse_posted)


# ---------------------------------------------------------------------------
# JSON feeds
# ---------------------------------------------------------------------------

def _remoteok(p: Column) -> dict[str, Column]:
    return {
        "native_id": p["id"], "title": _or(p["position"], p["title"]),
        "company": p["company"], "url": _or(p["url"], p["apply_url"]),
        "location": F.coalesce(_text(p["location"]), F.lit("Remote")),
        "description": p["description"], "posted_at": _or(p["epoch"], p["date"]),
        "salary_min": _pay(p["salary_min"]), "salary_max": _pay(p["salary_max"]),
        "remote": F.lit(True)}


def _himalayas(p: Column) -> dict[str, Column]:
    regions = F.array_join(F.from_json(p["locationRestrictions"], "array<string>"), ", ")
    place = F.when(F.startswith(p["locationRestrictions"], F.lit("[")), regions) \
        .otherwise(p["locationRestrictions"])
    return {
        "native_id": _or(p["guid"], p["id"], p["slug"]), "title": p["title"],
        "company": _or(p["companyName"], p["company_name"], p["company"]),
        "url": _or(p["applicationLink"], p["url"], p["link"]),
        "location": F.coalesce(_text(place), _text(p["location"]), F.lit("Remote")),
        "description": _or(p["description"], p["excerpt"]),
        "posted_at": _or(p["pubDate"], p["postedAt"], p["published"]),
        "salary_min": _pay(p["minSalary"], p["salary_min"]),
        "salary_max": _pay(p["maxSalary"], p["salary_max"]), "remote": F.lit(True)}


def _working_nomads(p: Column) -> dict[str, Column]:
    return {
        "native_id": F.coalesce(filled(p["id"]), _text(N.url_slug(p["url"]))),
        "title": strip(p["title"]),
        "company": F.coalesce(filled(p["company_name"]), filled(p["company"])),
        "url": strip(p["url"]), "location": F.coalesce(filled(p["location"]), F.lit("Remote")),
        "description": strip_html_full(p["description"]), "posted_at": strip(p["pub_date"]),
        "remote": F.lit(True)}


def _weworkremotely(p: Column) -> dict[str, Column]:
    link = F.coalesce(filled(p["link"]), filled(p["guid"]))
    both = N.split_company_title(strip(p["title"]))
    return {
        "native_id": F.coalesce(_text(F.regexp_extract(link, r"([^/]*)$", 1)), link),
        "title": both["title"],
        "company": both["company"], "url": link,
        "location": F.coalesce(filled(p["region"]), F.lit("Remote")),
        "description": strip_html_full(p["description"]), "posted_at": strip(p["pubDate"]),
        "remote": F.lit(True)}


def _ats(p: Column, title: Column, native: Column) -> dict[str, Column]:
    meta = F.col("_meta")
    return {"native_id": F.when(_text(native).isNotNull(), F.concat(
                F.coalesce(meta["ats_slug"], F.lit("unknown")), F.lit(":"), native)),
            "title": strip(title), "company": meta["name"], "company_tier": meta["tier"]}


def _greenhouse(p: Column) -> dict[str, Column]:
    place = F.when(F.startswith(p["location"], F.lit("{")),
                   F.get_json_object(p["location"], "$.name")).otherwise(p["location"])
    return {**_ats(p, p["title"], p["id"]), "url": p["absolute_url"],
            "location": place, "description": strip_html_basic(p["content"]),
            "posted_at": p["updated_at"]}


def _lever(p: Column) -> dict[str, Column]:
    return {**_ats(p, p["text"], p["id"]), "url": p["hostedUrl"],
            "location": p["categories"]["location"],
            "description": strip(_or(p["descriptionPlain"], p["description"])),
            "posted_at": p["createdAt"],
            "remote": F.when(F.lower(p["workplaceType"]) == "remote", True)
            .when(F.lower(p["workplaceType"]) == "onsite", False)}


def _ashby(p: Column) -> dict[str, Column]:
    return {**_ats(p, p["title"], p["id"]), "url": p["applyUrl"],
            "location": _or(p["location"], p["locationName"]),
            "description": strip(p["descriptionPlain"]), "posted_at": p["publishedAt"],
            "remote": _flag(p["isRemote"])}


def _smartrecruiters(p: Column) -> dict[str, Column]:
    loc, sections = p["location"], p["jobAd"]["sections"]
    place = F.concat_ws(", ", *[_text(loc[k]) for k in ("city", "region", "country")])
    text = N.join_sections(*[sections[k]["text"] for k in (
        "companyDescription", "jobDescription", "qualifications", "additionalInformation")])
    return {**_ats(p, p["name"], p["id"]),
            "company": _or(F.col("_meta.name"), p["company"]["name"]),
            "url": _or(p["postingUrl"], p["applyUrl"]),
            "location": _or(loc["fullLocation"], place),
            "description": strip_html_basic(text), "posted_at": p["releasedDate"],
            "remote": _flag(loc["remote"])}


def _workday(p: Column) -> dict[str, Column]:
    wd, path = p["_workday"], p["externalPath"]
    req = F.coalesce(filled(F.get(p["bulletFields"], 0)),
                     _text(F.regexp_extract(path, r"([^/]*)$", 1)), path)
    return {"native_id": F.when(_text(path).isNotNull(), F.concat(
                F.coalesce(_text(wd["tenant"]), F.lit("unknown")), F.lit(":"), req)),
            "title": strip(p["title"]), "company": F.col("_meta.name"),
            "company_tier": F.col("_meta.tier"),
            "url": F.when(_text(wd["base_url"]).isNotNull() & _text(wd["site"]).isNotNull(),
                          F.concat(wd["base_url"], F.lit("/"), wd["site"], path)),
            "location": strip(p["locationsText"]), "posted_at": p["postedOn"]}


def _linkedin(p: Column) -> dict[str, Column]:
    link = _or(p["jobUrl"], p["url"], p["applyUrl"])
    pay = N.parse_salary_list(p["salary"])
    kind = F.lower(_or(p["workplaceType"], p["workType"]))
    return {
        "native_id": _or(p["id"], p["jobId"], p["trackingUrn"],
                         N.url_id(link, r"/jobs/(?:view|search)/(\d+)")),
        "title": strip(p["title"]), "company": strip(_or(p["companyName"], p["company"])),
        "url": link, "location": p["location"],
        "description": _or(p["description"], p["descriptionText"], p["descriptionHtml"]),
        "posted_at": _or(p["postedTime"], p["postedAt"], p["publishedAt"], p["postedDate"]),
        "salary_min": pay["lo"], "salary_max": pay["hi"],
        "remote": F.when(kind == "remote", True)
        .when(kind.isin("on-site", "onsite", "on_site"), False)
        .when(any_of(F.lower(p["location"]), ["remote"]), True)}


def _bettingjobs(p: Column) -> dict[str, Column]:
    uid, slug = _or(p["uuid"], p["id"]), filled(p["URL"])
    place = filled(p["location_label"])
    remote = any_of(F.lower(place), ["remote"]) \
        | F.coalesce(F.startswith(F.lower(p["location_state_code"]), F.lit("remote")),
                     F.lit(False))
    return {
        "native_id": uid, "title": strip(p["job_title"]),
        "company": F.coalesce(filled(p["company_name"]), F.lit("BettingJobs")),
        "url": F.concat(F.lit("https://www.bettingjobs.com/jobs/"), F.coalesce(slug, uid),
                        F.lit("/")),
        "location": place,
        "description": strip_html_full(_or(p["job_description"], p["job_body"],
                                           p["short_description"])),
        "posted_at": _or(p["created_at"], p["activates_at"]),
        "salary_min": N.coerce_pay(p["pay_min_norm"], p["pay_min"]),
        "salary_max": N.coerce_pay(p["pay_max_norm"], p["pay_max"]),
        "remote": F.when(remote, True).when(any_of(F.lower(place), ["onsite", "on-site"]),
                                            False)}


# Header aliases of curated sheets, first filled one wins.
SHEET_HEADERS = {
    "company": ["company", "employer", "organization", "org"],
    "title": ["role", "title", "position", "job", "job title"],
    "location": ["location", "region", "city", "geo", "where"],
    "posted_at": ["posted", "date", "posted date", "added", "date added"],
    "url": ["url", "link", "apply url", "apply link", "job url", "posting"],
    "description": ["notes", "description", "details", "comments"],
}


def sheet_jobs(rows: DataFrame) -> DataFrame:
    """Intermediate rows of a curated sheet, whatever its headers are called."""
    have = {c.strip().lower(): c for c in rows.columns}

    def pick(name: str) -> Column:
        cols = [filled(F.col(f"`{have[h]}`").cast("string")) for h in SHEET_HEADERS[name]
                if h in have]
        return F.coalesce(*cols, F.lit(None).cast("string"))

    url = pick("url")
    native = F.coalesce(_text(N.url_slug(url)), url,
                        F.concat(F.lit("row-"), F.col("row_ref").cast("string")))
    values = {n: pick(n) for n in SHEET_HEADERS} | {"native_id": native}
    out = rows.select(*[values[n].alias(n) if n in values else F.lit(None).cast(k).alias(n)
                        for n, k in RAW_FIELDS.items()])
    return out.where(F.col("company").isNotNull() & F.col("title").isNotNull())


# ---------------------------------------------------------------------------
# Listing cards
# ---------------------------------------------------------------------------

HEADING = Pick(tags=("h2", "h3", "h4"))
LEAVES = Pick(tags=("p", "span", "div"), leaf=True, many=True)
STATE_TAIL = r",\s*[A-Z]{2}\b"
COUNTRY_TAIL = r",\s*[A-Z][a-z]+"


def _first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), 0)


def _leaf_candidates(title: Column, *used: Column) -> Column:
    """Leaf texts that are short, filled and not already used."""
    def keep(t: Column) -> Column:
        ok = (t != "") & (F.length(t) <= 80) & (t != F.coalesce(title, F.lit("")))
        for u in used:
            ok = ok & (t != F.coalesce(u, F.lit("")))
        return ok
    return F.filter(F.col("leaves"), keep)


def _place_like(countries: bool = False, words: tuple[str, ...] = ("remote",)):
    tail = f"{STATE_TAIL}|{COUNTRY_TAIL}" if countries else STATE_TAIL

    def test(t: Column) -> Column:
        hit = t.rlike(tail)
        for w in words:
            hit = hit | F.contains(F.lower(t), F.lit(w))
        return hit
    return test


def _without_logo(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\s+logo$", "")


def _slug() -> Column:
    return N.url_slug(F.col("href"))


def _hitmarker(_: Column) -> dict[str, Column]:
    title = F.coalesce("bold", "heading")
    alt = _without_logo(F.when(F.length("logo") < 80, F.col("logo")))
    place = _place_like(countries=True)
    cands = _leaf_candidates(title)
    location = _first_where(cands, place)
    other = _first_where(F.filter(cands, lambda t: ~place(t)), lambda t: F.lit(True))
    return {"native_id": _slug(), "title": title, "company": _or(alt, other), "url": F.col("url"),
            "location": location, "remote": N.remote_flag(text=location)}


def _by_leaves(company_first: Column | None, title: Column) -> tuple[Column, Column]:
    """(company, location): company from a preferred value or the first leaf that does not
    look like a place; location is the first other leaf that does."""
    place = _place_like()
    leaf = _first_where(_leaf_candidates(title), lambda t: ~place(t))
    company = _or(company_first, leaf) if company_first is not None else _text(leaf)
    return company, _first_where(_leaf_candidates(title, company), place)


def _only_remote(location: Column) -> Column:
    return F.when(any_of(F.lower(location), ["remote"]), True)


def _wellfound(_: Column) -> dict[str, Column]:
    slug = _text(F.regexp_extract("href", r"/company/([^/]+)/", 1))
    company, location = _by_leaves(N.slug_to_name(slug), F.col("heading"))
    return {"native_id": N.url_id(F.col("href"), r"/(?:company/[^/]+/)?jobs/(\d+)"),
            "title": F.col("heading"), "company": company, "url": F.col("url"),
            "location": location, "remote": _only_remote(location)}


def _wttj(_: Column) -> dict[str, Column]:
    pattern = r"/(?:en/)?companies/([^/]+)/jobs/([^/?]+)"
    cslug = _text(F.regexp_extract("href", pattern, 1))
    jslug = _text(F.regexp_extract("href", pattern, 2))
    leaf, location = _by_leaves(None, F.col("heading"))
    return {"native_id": F.concat_ws(":", cslug, _or(jslug, _slug())),
            "title": F.col("heading"), "company": _or(leaf, N.slug_to_name(cslug)),
            "url": F.col("url"), "location": location, "remote": _only_remote(location)}


def _builtin(_: Column) -> dict[str, Column]:
    location = _or(F.array_join(F.filter("places", lambda t: t != ""), ", "),
                   F.col("place_cls"), F.col("place_prop"))
    return {"native_id": _slug(), "title": _or(F.col("job_title"), F.col("heading")),
            "company": _or(F.col("co_title"), _without_logo(F.col("co_img")),
                           F.col("co_cls"), F.col("co_prop")),
            "url": F.col("url"), "location": location,
            "remote": N.remote_flag(text=location, no=("in-office", "in office", "onsite"))}


def _fractional(_: Column) -> dict[str, Column]:
    joined = F.array_join(F.filter("names", lambda t: t != ""), " ")
    at = F.instr(joined, " - ")
    named = F.when(at > 0, strip(F.substring(joined, F.lit(1), at - 1)))
    title = _or(F.when(at > 0, strip(F.substr(joined, at + 3))).otherwise(joined),
                F.col("heading"))
    parts = F.filter(F.transform(F.split("info", r"\|"), lambda t: F.trim(t)),
                     lambda t: t != "")
    place = _place_like(words=("remote", "anywhere"))
    need_leaves = (_text(title).isNull()) | (_text(named).isNull())
    cands = _leaf_candidates(title)
    stated = F.try_element_at(parts, F.lit(-1))
    location = F.coalesce(stated, F.when(need_leaves, _first_where(cands, place)))
    company = F.coalesce(_text(named), _first_where(
        cands, lambda t: ~place(t) | stated.isNotNull()))
    return {"native_id": _slug(), "title": title, "company": company, "url": F.col("url"),
            "location": location,
            "remote": N.remote_flag(text=location, yes=("remote", "anywhere"))}


MODES = ("Remote", "Hybrid", "Onsite")


def _game_jobs_uk(_: Column) -> dict[str, Column]:
    location = _first_where(F.col("spans"), lambda t: (t != "") & (F.length(t) <= 60) & (
        F.contains(t, F.lit(" - ")) | F.contains(t, F.lit("United Kingdom"))
        | F.contains(t, F.lit("Remote"))))
    mode = _first_where(F.col("all_spans"), lambda t: t.isin(*MODES))
    return {"native_id": N.url_id(F.col("href"), r"(\d+)"), "title": F.col("h4"),
            "company": F.col("h3"), "url": F.col("url"), "location": location,
            "posted_at": F.col("day"),
            "remote": F.when(mode == "Remote", True).when(mode == "Onsite", False)
            .when(any_of(F.lower(location), ["remote"]), True)}


def _games_career(_: Column) -> dict[str, Column]:
    city, country = _text(F.col("city")), _text(F.col("country"))
    location = F.coalesce(_text(F.concat_ws(", ", city, country)), _text(F.col("place")))
    return {"native_id": N.url_id(F.col("href"), r"/Joboffer/(\d+)"),
            "title": _or(F.col("prop_title"), F.col("heading")),
            "company": _or(F.col("co_name"), F.col("co")), "url": F.col("url"),
            "location": location,
            "posted_at": F.concat(_text(F.col("day")), F.lit("T00:00:00Z")),
            "remote": _only_remote(location)}


def _games_jobs_direct(_: Column) -> dict[str, Column]:
    from_path = N.slug_to_name(F.regexp_extract("href", r"^/job/([^/]+)/[^/]+/[^/]+", 1))
    posted_by = F.regexp_replace("posted_by", r"(?i)^Posted by\s+", "")
    hay = F.concat_ws(" ", _text(F.col("place")), _text(F.col("text")))
    return {"native_id": _slug(), "title": _or(F.col("job_title"), F.col("heading")),
            "company": _or(posted_by, from_path), "url": F.col("url"),
            "location": F.col("place"), "description": F.col("text"),
            "remote": N.remote_flag(text=hay, yes=("remote", "anywhere", "worldwide"))}


def _gamesindustry(_: Column) -> dict[str, Column]:
    return {"native_id": _slug(), "title": _or(F.col("heading"), F.col("link_title")),
            "company": _or(F.col("co_cls"), F.col("co_prop"), F.col("picture"),
                           F.col("img_title"), F.col("img_alt")),
            "url": F.col("url"), "location": F.col("place"), "posted_at": F.col("day"),
            "remote": N.remote_flag(text=F.col("place"), no=("onsite", "on-site", "office"))}


def _ingamejob(_: Column) -> dict[str, Column]:
    return {"native_id": N.url_id(F.col("href"), r"(?i)/job/([a-z0-9\-_]+)"),
            "title": F.col("h5"), "company": F.col("building"), "url": F.col("url"),
            "location": F.col("place"), "description": F.col("contract"),
            "remote": N.remote_flag(text=F.col("place"),
                                    yes=("remote", "worldwide", "anywhere"),
                                    no=("office", "onsite", "on-site"))}


def _outscal(_: Column) -> dict[str, Column]:
    company = _first_where(F.col("medium"), lambda t: t != "")
    location = _first_where(F.array_except("clamped", "medium_clamped"), lambda t: t != "")
    return {"native_id": _slug(), "title": _or(F.col("h3"), F.col("alt")), "company": company,
            "url": F.col("url"), "location": location,
            "remote": N.remote_flag(text=location, yes=("remote", "anywhere"),
                                    no=("onsite", "on-site", "in-office"))}


def _remote_game_jobs(_: Column) -> dict[str, Column]:
    pattern = r"(?i)^(.+?)\s+is hiring\s+(.+?)\s*\(Remote Job\)\s*$"
    tip = F.col("tip")
    return {"native_id": _slug(),
            "title": F.coalesce(_text(F.col("strong")), F.when(
                tip.rlike(pattern), F.regexp_extract(tip, pattern, 2))
                .when(~tip.rlike(r"(?i)is hiring\s*\(Remote Job\)"), tip)),
            "company": _or(F.col("small"),
                           F.regexp_extract(tip, r"(?i)^(.+?)\s+is hiring\s+", 1)),
            "url": F.col("url"), "location": F.lit("Remote"),
            "description": F.array_join(F.filter("tags", lambda t: t != ""), ", "),
            "remote": F.lit(True)}


def _work_with_indies(_: Column) -> dict[str, Column]:
    location = F.when(F.size("bolds") >= 2, F.element_at("bolds", -1))
    return {"native_id": _slug(), "title": F.coalesce("title_28", "title_14"),
            "company": _or(F.col("logo"), F.col("card_text")), "url": F.col("url"),
            "location": location,
            "remote": N.remote_flag(text=location, yes=("anywhere", "remote", "worldwide"),
                                    no=("onsite", "on-site", "office"))}


def _prop(name: str, inside: Pick | None = None) -> Pick:
    return Pick(attrs={"itemprop": f"^{name}$"}, inside=inside)


def _build_specs() -> dict[str, SourceSpec]:
    s = "string"
    json_specs = [
        SourceSpec("remoteok", f"id {s}, position {s}, title {s}, company {s}, url {s}, "
                   f"apply_url {s}, location {s}, description {s}, epoch {s}, date {s}, "
                   f"salary_min {s}, salary_max {s}", _remoteok),
        SourceSpec("himalayas", f"guid {s}, id {s}, slug {s}, title {s}, companyName {s}, "
                   f"company_name {s}, company {s}, applicationLink {s}, url {s}, link {s}, "
                   f"locationRestrictions {s}, location {s}, description {s}, excerpt {s}, "
                   f"pubDate {s}, postedAt {s}, published {s}, minSalary {s}, salary_min {s}, "
                   f"maxSalary {s}, salary_max {s}", _himalayas,
                   ("native_id", "title", "company", "url")),
        SourceSpec("working_nomads", f"id {s}, title {s}, company_name {s}, company {s}, "
                   f"url {s}, location {s}, description {s}, pub_date {s}", _working_nomads),
        SourceSpec("weworkremotely", f"title {s}, link {s}, guid {s}, description {s}, "
                   f"region {s}, pubDate {s}", _weworkremotely,
                   parse_posted=lambda c, now: N.parse_rfc822(c)),
        SourceSpec("greenhouse", f"id {s}, title {s}, location {s}, content {s}, "
                   f"updated_at {s}, absolute_url {s}", _greenhouse, ("native_id", "title")),
        SourceSpec("lever", f"id {s}, text {s}, categories struct<location: {s}, team: {s}>, "
                   f"descriptionPlain {s}, description {s}, hostedUrl {s}, createdAt {s}, "
                   f"workplaceType {s}", _lever, ("native_id", "title")),
        SourceSpec("ashby", f"id {s}, title {s}, location {s}, locationName {s}, "
                   f"isRemote {s}, descriptionPlain {s}, applyUrl {s}, publishedAt {s}",
                   _ashby, ("native_id", "title")),
        SourceSpec("smartrecruiters", f"id {s}, name {s}, company struct<name: {s}>, "
                   f"location struct<city: {s}, region: {s}, country: {s}, remote: {s}, "
                   f"fullLocation: {s}>, postingUrl {s}, applyUrl {s}, releasedDate {s}, "
                   "jobAd struct<sections: struct<companyDescription: struct<text: string>, "
                   "jobDescription: struct<text: string>, qualifications: "
                   "struct<text: string>, additionalInformation: struct<text: string>>>",
                   _smartrecruiters),
        SourceSpec("workday", f"title {s}, externalPath {s}, locationsText {s}, postedOn {s}, "
                   f"bulletFields array<{s}>, _workday struct<base_url: {s}, tenant: {s}, "
                   f"site: {s}>", _workday, ("native_id", "title"),
                   parse_posted=N.parse_relative_posted),
        SourceSpec("apify_linkedin", f"id {s}, jobId {s}, trackingUrn {s}, title {s}, "
                   f"companyName {s}, company {s}, jobUrl {s}, url {s}, applyUrl {s}, "
                   f"location {s}, description {s}, descriptionText {s}, "
                   f"descriptionHtml {s}, postedTime {s}, postedAt {s}, publishedAt {s}, "
                   f"postedDate {s}, salary {s}, workplaceType {s}, workType {s}", _linkedin),
        SourceSpec("bettingjobs", f"uuid {s}, id {s}, job_title {s}, company_name {s}, "
                   f"URL {s}, job_description {s}, job_body {s}, short_description {s}, "
                   f"location_label {s}, location_state_code {s}, pay_min_norm {s}, "
                   f"pay_min {s}, pay_max_norm {s}, pay_max {s}, created_at {s}, "
                   f"activates_at {s}", _bettingjobs),
    ]
    heading5 = Pick(tags=("h2", "h3", "h4", "h5"))
    anchor_title = Pick(tags=("a",), attrs={"title": "."}, take="title")
    org, place = _prop("hiringOrganization"), _prop("jobLocation")
    section = Pick(cls="bounded-attribute-section")
    card_specs = [
        SourceSpec("hitmarker", "", _hitmarker, picks={
            "bold": Pick(cls=r"\bfont-bold\b"), "heading": HEADING, "leaves": LEAVES,
            "logo": Pick(tags=("img",), attrs={"alt": "."}, take="alt")}),
        SourceSpec("wellfound", "", _wellfound, picks={"heading": heading5,
                                                       "leaves": LEAVES}),
        SourceSpec("welcometothejungle", "", _wttj, picks={"heading": heading5,
                                                           "leaves": LEAVES}),
        SourceSpec("builtinnyc", "", _builtin, picks={
            "job_title": Pick(attrs={"data-id": "^job-card-title$"}), "heading": HEADING,
            "co_title": Pick(attrs={"data-id": "^company-title$"}),
            "co_img": Pick(tags=("img",), attrs={"data-id": "^company-img$"}, take="alt"),
            "co_cls": Pick(cls="(?i)company"), "co_prop": org,
            "places": Pick(tags=("i",), cls="fa-(house-building|location-dot)", up="div",
                           next_sibling=True, many=True, inside=section),
            "place_cls": Pick(cls="(?i)location"), "place_prop": place}),
        SourceSpec("fractional_jobs", "", _fractional, picks={
            "names": Pick(tags=("h3",), many=True,
                          inside=Pick(tags=("div",), cls="job-item_name_url")),
            "info": Pick(tags=("div",), cls="job-item_more-info", sep=" | "),
            "heading": Pick(tags=("h1", "h2", "h3")), "leaves": LEAVES}),
        SourceSpec("game_jobs_uk", "", _game_jobs_uk, picks={
            "h3": Pick(tags=("h3",)), "h4": Pick(tags=("h4",)),
            "spans": Pick(tags=("span",), bare=True, many=True),
            "all_spans": Pick(tags=("span",), many=True),
            "day": Pick(cls=r"\blocal-date\b")},
            parse_posted=lambda c, now: N.parse_eu_date(c)),
        SourceSpec("games_career", "", _games_career, picks={
            "prop_title": _prop("title"), "heading": Pick(tags=("h3", "h2")),
            "co_name": _prop("name", org), "co": org,
            "city": _prop("addressLocality", place),
            "country": _prop("addressCountry", place), "place": place,
            "day": Pick(tags=("time",), attrs={"itemprop": "^datePosted$"},
                        take="datetime")}),
        SourceSpec("games_jobs_direct", "", _games_jobs_direct, picks={
            "job_title": Pick(tags=("h4",), cls="job-title"), "heading": HEADING,
            "posted_by": Pick(tags=("div",), attrs={"title": r"^Posted by\s+"}, take="title"),
            "place": Pick(tags=("p",), cls="job-location"),
            "text": Pick(tags=("div",), cls="job-desc")}),
        SourceSpec("gamesindustry", "", _gamesindustry, picks={
            "heading": HEADING,
            "link_title": Pick(tags=("a",), cls="recruiter-job-link", take="title"),
            "co_cls": Pick(cls="(?i)company"), "co_prop": org,
            "picture": Pick(tags=("picture",), take="title"),
            "img_title": Pick(tags=("img",), attrs={"alt": ""}, take="title"),
            "img_alt": Pick(tags=("img",), attrs={"alt": ""}, take="alt"),
            "place": Pick(cls="(?i)location"), "day": Pick(cls=r"\bdate\b")},
            parse_posted=lambda c, now: N.parse_month_date(c)),
        SourceSpec("ingamejob", "", _ingamejob, picks={
            "h5": Pick(tags=("h5",)),
            "building": Pick(tags=("i",), cls=r"\bla-building-o\b", up="strong"),
            "place": Pick(tags=("i",), cls=r"\bla-map-marker\b", up="p"),
            "contract": Pick(tags=("i",), cls=r"\bla-briefcase\b", up="p")}),
        SourceSpec("outscal", "", _outscal, picks={
            "h3": Pick(tags=("h3",)), "alt": Pick(tags=("img",), attrs={"alt": ""}, take="alt"),
            "medium": Pick(tags=("p",), cls="font-medium", many=True),
            "clamped": Pick(tags=("p",), cls="line-clamp-1", many=True),
            "medium_clamped": Pick(tags=("p",), cls="font-medium.*line-clamp-1|"
                                   "line-clamp-1.*font-medium", many=True)}),
        SourceSpec("remote_game_jobs", "", _remote_game_jobs, picks={
            "strong": Pick(tags=("strong",), cls="f-20"), "tip": anchor_title,
            "small": Pick(tags=("small",), cls="f-15"),
            "tags": Pick(tags=("span",), cls=r"\btag\b", many=True)}),
        SourceSpec("work_with_indies", "", _work_with_indies, picks={
            "title_28": Pick(cls=r"\btext-block-28\b"),
            "title_14": Pick(cls=r"\btext-block-14\b"),
            "logo": Pick(tags=("img",), cls="company-logo", take="alt"),
            "card_text": Pick(cls="job-card-text"),
            "bolds": Pick(cls=r"\bbold\b", many=True)}),
    ]
    return {spec.name: spec for spec in json_specs + card_specs}


SPECS = _build_specs()
# Curated sheets share one reader; each sheet is a source name of its own.
SHEET_SOURCE = "asgc_sheet"
