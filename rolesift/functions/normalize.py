"""Normalisation of names, titles, URLs, dates, pay and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import any_of, filled, squeeze, strip

# Accented letters and their base letters, position by position.
ACCENTED = (
            "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒ"
            "ēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũ"
            "ŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
            "\u00a0")
UNACCENTED = (
            "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdE"
            "eEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUu"
            "UuUuUuUuUuWwYyYZzZzZz"
            " ")
# Corporate suffixes.
CORPORATE_SUFFIXES = ("incorporated", "corporation", "limited", "holdings", "pty ltd", "gmbh",
                      "s\\.a\\.", "sa", "inc", "corp", "llc", "ltd", "co", "plc", "ag", "bv",
                      "nv")
COMPANY_TAIL = (r"(?:[,.\s]+(?:" + "|".join(CORPORATE_SUFFIXES) + r")\.?[ ,.]*"
                r"|\s*\([^)]*\)[ ,.]*)+$")


def fold_accents(c: Column) -> Column:
    """Base letters for Latin-1 and Latin Extended-A; combining marks are dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, UNACCENTED), "[\\u0300-\\u036f]", "")


def normalize_company(name: Column) -> Column:
    """Stable company key: folded, lower-cased, without corporate suffixes and aliases."""
    base = squeeze(F.lower(fold_accents(name)))
    trimmed = F.btrim(base, F.lit(" ,."))
    # The last suffix is only recognised with something before it, so a name that
    # consists of a suffix alone is kept.
    return F.coalesce(F.btrim(F.regexp_replace(
        F.when(base.rlike(COMPANY_TAIL), base).otherwise(trimmed), COMPANY_TAIL, ""),
        F.lit(" ,.")), F.lit(""))


def normalize_title(title: Column) -> Column:
    return F.coalesce(squeeze(F.lower(title)), F.lit(""))


# Fixed value: a pay range, each side optionally in thousands.
SALARY_RANGE = (r"(?i)\$?\s*([0-9]{2,3}(?:,[0-9]{3})*|[0-9]{3,7})\s*(k)?\s*(?:-|–|—|to)\s*"
                r"\$?\s*([0-9]{2,3}(?:,[0-9]{3})*|[0-9]{3,7})\s*(k)?")


def _plausible_pay(text: Column, number_group: int, k_group: int) -> Column:
    number = F.regexp_replace(F.regexp_extract(text, SALARY_RANGE, number_group), ",", "")
    value = number.try_cast("long") * F.when(
        F.regexp_extract(text, SALARY_RANGE, k_group) != "", 1000).otherwise(1)
    return F.when(value.between(10_000, 10_000_000), value)


def parse_salary_range(text: Column) -> Column:
    """struct(lo, hi) of the first range; implausible sides are NULL, swapped if inverted."""
    lo, hi = _plausible_pay(text, 1, 2), _plausible_pay(text, 3, 4)
    swap = lo.isNotNull() & hi.isNotNull() & (hi < lo)
    return F.struct(F.when(swap, hi).otherwise(lo).alias("lo"),
                    F.when(swap, lo).otherwise(hi).alias("hi"))


PAY_NUMBER = r"\$?\s*([\d,]+(?:\.\d+)?)\s*([kKmM]?)"
HOURLY = ["/hour", "/hr", "per hour", "hourly"]


def parse_salary_list(text: Column) -> Column:
    """struct(lo, hi): smallest and largest of at least two amounts of 20k or more."""
    numbers = F.regexp_extract_all(text, F.lit(PAY_NUMBER), 1)
    units = F.regexp_extract_all(text, F.lit(PAY_NUMBER), 2)

    def amount(n: Column, u: Column) -> Column:
        scale = F.when(F.lower(u) == "k", 1_000.0).when(F.lower(u) == "m", 1_000_000.0)\
            .otherwise(1.0)
        return F.try_multiply(F.regexp_replace(n, ",", "").try_cast("double"), scale)

    amounts = F.filter(F.zip_with(numbers, units, lambda n, u: F.floor(amount(n, u))),
                       lambda v: v >= 20_000)
    ok = ~any_of(F.lower(text), HOURLY) & (F.size(amounts) >= 2)
    return F.struct(F.when(ok, F.array_min(amounts)).alias("lo"),
                    F.when(ok, F.array_max(amounts)).alias("hi"))


def coerce_pay(*candidates: Column) -> Column:
    """First candidate that is a positive whole amount; below 20k is noise."""
    def positive(c: Column) -> Column:
        n = F.when(F.abs(c.try_cast("double")) < 1e15, c.try_cast("double")).cast("long")
        return F.when(n > 0, n)
    value = F.coalesce(*[positive(c) for c in candidates])
    return F.when(value >= 20_000, value)


# ---------------------------------------------------------------------------
# Dates. Nothing here reads the clock: callers pass ``as_of``.
# ---------------------------------------------------------------------------

MAX_EPOCH_SECONDS = 253_402_300_799  # last second of year 9999
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def canonical_timestamp(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds or ISO text to a UTC timestamp.

    Numbers past the last representable second are read as milliseconds.
    """
    v = strip(value.cast("string"))
    digits = v.rlike(r"^\d+$")
    epoch = F.when(digits, v.try_cast("long"))
    seconds = F.when(epoch > MAX_EPOCH_SECONDS, F.floor(epoch / 1000)).otherwise(epoch)
    from_epoch = F.timestamp_seconds(F.when(seconds <= MAX_EPOCH_SECONDS, seconds))
    from_iso = F.when(v.rlike(ISO), F.date_trunc("second", v.try_cast("timestamp")))
    return F.coalesce(from_epoch, F.when(~digits, from_iso))


def parse_relative_posted(text: Column, as_of: Column) -> Column:
    """'Posted Today / Yesterday / N Days Ago' counted back from ``as_of``."""
    low = F.lower(text)
    days = (F.when(F.contains(low, F.lit("today")), 0)
            .when(F.contains(low, F.lit("yesterday")), 1)
            .otherwise(F.regexp_extract(text, r"(?i)(\d+)\+?\s*Day", 1).try_cast("int")))
    return as_of - F.make_dt_interval(days=days)


def parse_eu_date(text: Column) -> Column:
    """Leading dd.mm.yyyy."""
    day = F.regexp_extract(strip(text), r"^(\d{2}\.\d{2}\.\d{4})", 1)
    return F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("dd.MM.yyyy"))


def parse_month_date(text: Column) -> Column:
    """'15 Apr 2026' or '15 April 2026', trailing commas allowed."""
    day = F.rtrim(squeeze(text), F.lit(","))
    return F.coalesce(F.try_to_timestamp(day, F.lit("d MMM yyyy")),
                      F.try_to_timestamp(day, F.lit("d MMMM yyyy")))


def parse_rfc822(text: Column) -> Column:
    """Feed dates such as 'Wed, 15 Apr 2026 10:00:00 +0000'."""
    body = F.regexp_replace(strip(text), r"^[A-Za-z]{3},\s*", "")
    body = F.regexp_replace(body, r"(GMT|UTC|UT|Z)$", "+0000")
    return F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def short_date(text: Column) -> Column:
    """First ten characters, '?' when missing."""
    return F.coalesce(F.nullif(F.substring(text, 1, 10), F.lit("")), F.lit("?"))


def days_ago_label(ts: Column, as_of: Column) -> Column:
    """'today', 'Nd ago' under two weeks, else month and day."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    days = F.floor(seconds / 86_400.0 + 0.5)
    return (F.when(ts.isNull(), "")
            .when(days <= 0, "today")
            .when(days < 14, F.concat(days.cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(ts, "MMM d")))


# ---------------------------------------------------------------------------
# Keys, URLs and small renderings.
# ---------------------------------------------------------------------------

def job_id(source: Column, native_id: Column) -> Column:
    return F.concat(source, F.lit(":"), native_id)


def score_posted(score: Column, posted_iso: Column) -> Column:
    """Sort key: score clamped to 0..100 and padded to four digits, '#', date text."""
    clamped = F.least(F.greatest(score.cast("int"), F.lit(0)), F.lit(100))
    return F.concat(F.lpad(clamped.cast("string"), 4, "0"), F.lit("#"),
                    F.coalesce(posted_iso, F.lit("")))


def url_slug(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/]+)/*$", 1)


def url_id(url: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, group), F.lit(""))


def slug_to_name(slug: Column) -> Column:
    return F.initcap(F.translate(slug, "-", " "))


def split_company_title(raw: Column) -> Column:
    """struct(company, title) around the first colon; no colon leaves company empty."""
    at = F.instr(raw, ":")
    return F.struct(
        F.when(at > 0, strip(F.substring_index(raw, ":", 1))).otherwise("").alias("company"),
        F.when(at > 0, strip(F.substr(raw, at + 1))).otherwise(strip(raw)).alias("title"))


# Host prefixes that name a careers site, in stripping order.
HOST_PREFIXES = ["www.", "careers.", "jobs.", "apply.", "boards.", "job-boards.", "about.",
                 "join.", "hire.", "work.", "team.", "talent."]
# Hosts that are hiring platforms, not employers.
PLATFORM_HOSTS = [
    "greenhouse", "lever", "ashby", "ashbyhq", "workable", "bamboohr", "jobvite", "breezy",
    "recruitee", "workday", "myworkdayjobs", "smartrecruiters", "icims", "taleo", "ultipro",
    "paylocity", "rippling", "gusto", "justworks", "pinpoint", "linkedin", "indeed",
    "glassdoor", "ziprecruiter", "wellfound", "angellist", "ycombinator", "github", "gitlab",
    "notion", "airtable", "typeform", "forms",
]


def company_from_host(text: Column) -> Column:
    """Employer guessed from the host of the first URL, NULL for hiring platforms."""
    host = F.lower(F.regexp_extract(text, r"(?i)https?://([a-z0-9][a-z0-9.\-]*)", 1))
    for prefix in HOST_PREFIXES:
        host = F.regexp_replace(host, "^" + prefix.replace(".", r"\."), "")
    root = F.substring_index(host, ".", 1)
    ok = (F.contains(host, F.lit(".")) & F.length(root).between(2, 40)
          & ~root.isin(PLATFORM_HOSTS))
    return F.when(ok, F.concat(F.upper(F.substring(root, 1, 1)), F.substr(root, F.lit(2))))


def remote_flag(explicit: Column | None = None, workplace: Column | None = None,
                text: Column | None = None, yes: tuple[str, ...] = ("remote",),
                no: tuple[str, ...] = ("onsite", "on-site")) -> Column:
    """TRUE / FALSE / NULL: explicit flag, then workplace type, then words in a text."""
    out = F.lit(None).cast("boolean")
    if text is not None:
        low = F.lower(text)
        out = F.when(any_of(low, yes), True).when(any_of(low, no), False).otherwise(out)
    if workplace is not None:
        w = F.lower(workplace)
        out = F.when(w == "remote", True)\
            .when(w.isin("onsite", "on-site", "on_site"), False).otherwise(out)
    if explicit is not None:
        out = F.coalesce(explicit, out)
    return out


def alias_coalesce(*cols: Column) -> Column:
    """First value with something left after trimming."""
    return F.coalesce(*[filled(c) for c in cols])


def join_sections(*sections: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(s, F.lit("")) for s in sections])


SNIPPET = 220


def rationale_snippet(text: Column, limit: int = SNIPPET) -> Column:
    """Short text verbatim; longer is cut at the last space in the second half, plus '…'."""
    head = F.substring(text, 1, limit)
    space = limit - F.locate(" ", F.reverse(head))
    at_space = (F.locate(" ", head) > 0) & (space >= limit // 2)
    cut = F.when(at_space, F.substring(text, F.lit(1), space)).otherwise(head)
    return F.when(text.isNull(), "").when(F.length(text) <= limit, text)\
        .otherwise(F.concat(F.rtrim(cut, F.lit(" \t\n\r\x0b\x0c")), F.lit("…")))


def salary_pretty(lo: Column, hi: Column, currency: Column | None = None) -> Column:
    """'$180k – $220k USD'; zero and NULL are absent."""
    lo, hi = F.nullif(lo, F.lit(0)), F.nullif(hi, F.lit(0))
    unit = F.coalesce(filled(currency), F.lit("USD")) if currency is not None else F.lit("USD")

    def pretty(n: Column) -> Column:
        thousands = F.bround(n / 1000.0).cast("long").cast("string")
        return F.when(n >= 1000, F.concat(F.lit("$"), thousands, F.lit("k")))\
            .otherwise(F.concat(F.lit("$"), n.cast("string")))

    both = F.concat(pretty(lo), F.lit(" – "), pretty(hi), F.lit(" "), unit)
    one = F.concat(pretty(F.coalesce(lo, hi)), F.lit(" "), unit)
    return F.when(lo.isNull() & hi.isNull(), "")\
        .when(lo.isNotNull() & hi.isNotNull(), both).otherwise(one)


def coerce_int(value: Column) -> Column:
    """Whole part of a number in any text form, NULL otherwise."""
    number = F.trim(value.cast("string")).try_cast("decimal(38,6)")
    return F.when(F.abs(number) < 9e18, F.signum(number) * F.floor(F.abs(number))).cast("long")


def coerce_bool(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("true", "t", "yes", "y", "1"),
                      F.lit(False))


def coerce_list(values: Column) -> Column:
    """Array without NULL and blank entries; NULL becomes an empty array."""
    return F.coalesce(F.filter(values, lambda v: v.isNotNull() & (strip(v) != "")),
                      F.array().cast("array<string>"))


# Name endings that slugs leave out, tried in this order.
SLUG_SUFFIXES = (r" inc\.", " inc", r" corp\.", " corp", " ltd", " llc", " entertainment",
                 " international", " company", " games", ", the")


def slug_candidates(name: Column, current: Column | None = None) -> Column:
    """Ordered distinct slugs a company may use on a hiring platform."""
    n = strip(F.lower(name))
    for suffix in SLUG_SUFFIXES:
        n = strip(F.regexp_replace(n, suffix + "$", ""))
    words = F.filter(F.split(F.regexp_replace(n, "[^a-z0-9 ]+", ""), " +"), lambda w: w != "")
    first, second = F.get(words, 0), F.get(words, 1)
    options = [F.array_join(words, "-"), F.array_join(words, ""), first,
               F.concat(first, second), F.concat(first, F.lit("-"), second)]
    if current is not None:
        options.insert(0, current)
    return F.array_distinct(F.filter(F.array(*options),
                                     lambda s: s.isNotNull() & (s != "")))
