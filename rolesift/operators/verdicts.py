"""Structured verdicts: request table out, response table in, tiers from both.

The external scorer itself is not called here. ``requests`` lists what it should be asked,
``parse`` turns its raw replies into typed columns and ``score_combined`` joins them on.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolesift.config.model import ScoringConfig
from rolesift.functions.text import any_of, computed_once, strip, text_or_empty
from rolesift.operators import prefilter as pf
from rolesift.operators.classify import text_phrases, with_classifiers
from rolesift.operators.weighted import tier_from_score

# Allowed values per field, in the order used for substring fallback.
ALLOWED = {
    "role_family_match": ["strong", "partial", "none", "unclear"],
    "industry_match": ["strong", "partial", "none", "unclear"],
    "geography_match": ["reachable", "unreachable", "unclear"],
    "level_match": ["match", "under", "over", "unclear"],
}
VERDICT_FIELDS = ["semantic_score", "semantic_rationale", "semantic_scored_at",
                  "semantic_model", "verdict_work_mode", "role_family_match",
                  "industry_match", "geography_match", "level_match", "watchlist_dream",
                  "life_fit_concerns"]
TRUNCATION_NOTE = "\n\n[…description truncated…]"
REPLY_SHAPE = (
    'Reply with JSON only, all nine fields: {"score": <int 0-100>, '
    '"work_mode": "remote|hybrid|onsite|unclear", "rationale": "<one sentence>", '
    '"role_family_match": "strong|partial|none", "industry_match": "strong|partial|none", '
    '"geography_match": "reachable|unreachable|unclear", '
    '"level_match": "match|under|over|unclear", "watchlist_dream": true|false, '
    '"life_fit_concerns": [<short phrases>]}')


# ---------------------------------------------------------------------------
# Coercions
# ---------------------------------------------------------------------------

def normalize_work_mode(raw: Column) -> Column:
    low = F.lower(strip(raw))
    return (F.when(low.isin("remote", "hybrid", "onsite", "unclear"), low)
            .when(any_of(low, ["remote", "anywhere", "distributed"]), "remote")
            .when(any_of(low, ["hybrid"]), "hybrid")
            .when(any_of(low, ["onsite", "on-site", "in office", "in-office"]), "onsite")
            .otherwise("unclear"))


def coerce_enum(raw: Column, allowed: list[str]) -> Column:
    """Allowed value, else the first allowed value contained in the text, else unclear.

    Longer values are looked for first so that 'unreachable' is not read as 'reachable'.
    """
    low = F.lower(strip(raw))
    order = sorted([a for a in allowed if a != "unclear"], key=lambda a: -len(a))
    out = F.when(low.isin(allowed), low)
    for value in order:
        out = out.when(F.contains(low, F.lit(value)), F.lit(value))
    return out.otherwise("unclear")


def coerce_bool_json(raw: Column) -> Column:
    """JSON boolean, number or yes/no text; anything else is false."""
    low = F.lower(strip(raw))
    number = low.try_cast("double")
    return F.coalesce(F.when(low.isin("true", "yes", "1"), True)
                      .when(number.isNotNull(), number != 0), F.lit(False))


def coerce_str_list(items: Column) -> Column:
    """All entries, stripped, blanks dropped. Views shorten them, storage does not."""
    kept = F.filter(F.transform(items, strip), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


# ---------------------------------------------------------------------------
# Raw reply -> typed columns
# ---------------------------------------------------------------------------

def _close_open(text: str | None) -> str | None:
    """Append the quote, bracket and brace closers a cut-off reply is missing."""
    if text is None or "{" not in text:
        return None
    body = text[text.index("{"):]
    closers: list[str] = []
    quoted = skip = False
    for ch in body:
        if skip:
            skip = False
        elif quoted:
            skip = ch == "\\"
            quoted = ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            closers.append("}" if ch == "{" else "]")
        elif closers and ch == closers[-1]:
            closers.pop()
    fixed = body + ('"' if quoted else "") + "".join(reversed(closers))
    try:
        json.loads(fixed)
    except ValueError:
        return None
    return fixed


@F.pandas_udf(StringType())
def salvage(raw: pd.Series) -> pd.Series:
    """Repaired JSON of truncated replies, NULL where nothing can be recovered."""
    return raw.map(_close_open)


# Keeps the optimizer from copying the repair, and all that leads to it, into the filter
# that follows; the repair runs once per reply.
salvage = salvage.asNondeterministic()


def _unfenced(raw: Column) -> Column:
    text = strip(raw)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z]*\n?", ""),
                             r"\n?```\s*$", "")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def _json_number(obj: Column, path: str) -> Column:
    """Number at a path; text that merely looks like a number does not count."""
    v = F.try_variant_get(obj, path, "variant")
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT"
                                           "|BOOLEAN)")
    value = F.when(F.schema_of_variant(v) == "BOOLEAN",
                   F.try_variant_get(obj, path, "boolean").cast("double"))\
        .otherwise(F.try_variant_get(obj, path, "double"))
    return F.when(numeric, value)


def _json_text(obj: Column, path: str) -> Column:
    v = F.try_variant_get(obj, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(obj, path, "string"))


_TEXT_FIELDS = ("rationale", "work_mode", *ALLOWED)


def _typed(df: DataFrame) -> DataFrame:
    """Verdict columns of the object in ``_obj``, read in two projections: values out of
    the object first, then the coercions that look at each value several times."""
    obj = F.col("_obj")
    items = F.try_variant_get(obj, "$.life_fit_concerns", "array<variant>")
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING",
                                                F.try_variant_get(v, "$", "string")))
    one = _json_text(obj, "$.life_fit_concerns")
    read = df.withColumns({
        "_score": F.bround(_json_number(obj, "$.score")),
        "_dream": F.try_variant_get(obj, "$.watchlist_dream", "string"),
        "_concerns": F.when(one.isNotNull(), F.array(one)).otherwise(texts),
        **{f"_{n}": _json_text(obj, f"$.{n}") for n in _TEXT_FIELDS}})
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_score")))
    typed = read.withColumns({
        "semantic_score": score.cast("int"),
        "semantic_rationale": strip(text_or_empty(F.col("_rationale"))),
        "verdict_work_mode": normalize_work_mode(F.col("_work_mode")),
        "watchlist_dream": coerce_bool_json(F.col("_dream")),
        "life_fit_concerns": coerce_str_list(F.col("_concerns")),
        **{n: coerce_enum(F.col(f"_{n}"), values) for n, values in ALLOWED.items()}})
    return typed.drop("_obj", "_score", "_dream", "_concerns",
                      *[f"_{n}" for n in _TEXT_FIELDS])


def parse(replies: DataFrame, raw: str = "raw_text") -> DataFrame:
    """Typed verdict columns from raw replies; replies without a numeric score are dropped.

    Three readings are tried: the unfenced reply, the widest ``{…}`` in it, and the
    repaired reply. Each reading happens only where the ones before it failed, and the
    repair, the only Python step, receives NULL for every reply that already parsed.
    """
    score = "$.score"
    block = F.nullif(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), F.lit(""))
    whole = replies.withColumn("_body", _unfenced(F.col(raw))) \
        .withColumn("_o1", F.try_parse_json("_body")) \
        .withColumn("_s1", _json_number(F.col("_o1"), score))
    inner = whole.withColumn("_o2", F.when(F.col("_s1").isNull(), F.try_parse_json(block))) \
        .withColumn("_s2", _json_number(F.col("_o2"), score))
    lost = F.col("_s1").isNull() & F.col("_s2").isNull()
    fixed = inner.withColumn("_fix", salvage(F.when(lost, F.col("_body")))) \
        .withColumn("_o3", F.try_parse_json("_fix")) \
        .withColumn("_s3", _json_number(F.col("_o3"), score))
    chosen = fixed.withColumn("_obj", F.coalesce(
        *[F.when(F.col(f"_s{n}").isNotNull(), F.col(f"_o{n}")) for n in (1, 2, 3)]))
    helpers = ["_body", "_fix", *[f"_{kind}{n}" for kind in "os" for n in (1, 2, 3)]]
    return _typed(chosen.where(F.col("_obj").isNotNull()).drop(*helpers))


# ---------------------------------------------------------------------------
# Cache, requests and joining
# ---------------------------------------------------------------------------

def is_fresh(scored_at: Column, score: Column, as_of: Column, cfg: ScoringConfig) -> Column:
    """A verdict with a score, younger than the cache window."""
    window = F.make_dt_interval(days=F.lit(cfg.cache_days))
    return F.coalesce((scored_at > as_of - window) & score.isNotNull(), F.lit(False))


def replay(df: DataFrame) -> DataFrame:
    """Fill what older verdict rows lack with neutral values."""
    present = set(df.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast(kind)

    return df.withColumns({
        "semantic_score": F.coalesce(col("semantic_score", "int"), F.lit(0)),
        "semantic_rationale": text_or_empty(col("semantic_rationale", "string")),
        "semantic_model": text_or_empty(col("semantic_model", "string")),
        "verdict_work_mode": F.coalesce(
            F.nullif(col("verdict_work_mode", "string"), F.lit("")), F.lit("unclear")),
        "watchlist_dream": F.coalesce(col("watchlist_dream", "boolean"), F.lit(False)),
        "life_fit_concerns": F.coalesce(col("life_fit_concerns", "array<string>"),
                                        F.array().cast("array<string>")),
        **{n: F.coalesce(F.nullif(col(n, "string"), F.lit("")), F.lit("unclear"))
           for n in ALLOWED},
    })


def fresh_verdicts(verdicts: DataFrame, as_of: Column, cfg: ScoringConfig) -> DataFrame:
    """One fresh verdict per posting, the newest; equal times are settled by content.
    Aggregation combines before the shuffle."""
    fresh = verdicts.where(is_fresh(F.col("semantic_scored_at"), F.col("semantic_score"),
                                    as_of, cfg))
    filled = replay(fresh)
    row = F.struct(*[F.col(c) for c in VERDICT_FIELDS])
    best = filled.groupBy("job_id").agg(F.max_by(
        row, F.struct("semantic_scored_at", F.xxhash64(F.to_json(row)))).alias("_v"))
    return best.select("job_id", "_v.*")


def context_block() -> Column:
    """Prefilter context as text lines; sections without content are left out."""
    flags = F.array_compact(F.array(
        F.when(F.col("is_dream_company"), "dream-tier"),
        F.when(F.col("is_hrc100"), "HRC 100"),
        F.when(F.col("is_crunch_co"), "crunch-company risk")))

    def listed(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))

    return F.concat_ws(
        "\n", F.lit("--- Pre-filter context ---"),
        F.concat(F.lit("Track: "), F.col("track")),
        F.concat(F.lit("Detected industry: "), F.col("industry"),
                 F.lit(" (preference score "), F.col("industry_score").cast("string"),
                 F.lit("/10)")),
        F.concat(F.lit("Location flag: "), F.col("location_flag")),
        listed("Company flags: ", flags),
        listed("Positive signals fired: ", F.col("positive_signals")),
        listed("Soft warnings fired: ", F.col("soft_warnings")),
        F.lit("--- End pre-filter ---"))


def message(limit: int | None = None) -> Column:
    """Request text of a prefiltered posting, with the whole description or, where the
    scorer's window needs it, its first ``limit`` characters."""
    def stripped(name: str) -> Column:
        return strip(text_or_empty(F.col(name)))

    def dollars(name: str) -> Column:
        amount = F.nullif(F.col(name), F.lit(0))
        return F.coalesce(F.concat(F.lit("$"), F.format_number(amount, 0)), F.lit("?"))

    desc = stripped("description")
    excerpt = desc if limit is None else F.when(
        F.length(desc) > limit, F.concat(F.substring(desc, 1, limit), F.lit(TRUNCATION_NOTE))) \
        .otherwise(desc)
    paid = (F.coalesce(F.col("salary_min"), F.lit(0)) != 0) \
        | (F.coalesce(F.col("salary_max"), F.lit(0)) != 0)
    salary = F.when(paid, F.concat(F.lit("\nSalary: "), dollars("salary_min"), F.lit(" - "),
                                   dollars("salary_max"))).otherwise("")
    return F.concat(
        context_block(), F.lit("\n\nTitle: "), stripped("title"),
        F.lit("\nCompany: "), stripped("company"), F.lit("\nLocation: "), stripped("location"),
        F.lit("\nRemote: "), F.when(F.col("remote"), "yes").otherwise("no"), salary,
        F.lit("\n\nDescription:\n"), excerpt, F.lit("\n\n" + REPLY_SHAPE))


def requests(prefiltered: DataFrame, verdicts: DataFrame, as_of: Column, cfg: ScoringConfig,
             force: bool = False) -> DataFrame:
    """job_id and request text of passed postings without a fresh verdict."""
    todo = prefiltered.withColumn("_ask", computed_once(F.col("passed_prefilter"))) \
        .where("_ask").drop("_ask")
    if not cfg.verdicts_enabled:
        todo = todo.where(F.lit(False))
    elif not force:
        known = verdicts.where(is_fresh(F.col("semantic_scored_at"), F.col("semantic_score"),
                                        as_of, cfg)).select("job_id")
        todo = todo.join(known, "job_id", "left_anti")
    return todo.select("job_id", message(cfg.description_limit).alias("message"))


def derive_tier(passed: Column, available: Column, score: Column, dream_flag: Column,
                dream_company: Column, leadership: Column, geography: Column,
                cfg: ScoringConfig) -> Column:
    base = tier_from_score(score, cfg)
    rescue = (base == "skip") & dream_flag & dream_company & leadership \
        & (geography == "unreachable")
    return (F.when(~passed, "DISQUALIFIED").when(~available, "needs_review")
            .when(rescue, "watchlist_dream").otherwise(base))


def score_combined(df: DataFrame, verdicts: DataFrame, cfg: ScoringConfig, as_of: Column,
                   companies: DataFrame | None = None,
                   skip_verdicts: bool = False) -> DataFrame:
    """Prefilter, classifiers and verdicts to the full scored row.

    The verdict join on job_id is the only shuffle of large tables. ``verdict_state`` is
    'skipped' (not asked), 'missing' (asked, no usable reply) or 'scored'.
    """
    stale = [c for c in VERDICT_FIELDS if c in df.columns]
    # The full text is read once for the prefilter and the classifiers.
    filtered = pf.prefilter(df.drop(*stale), cfg, companies, text_phrases(cfg), "_found")
    scored = with_classifiers(filtered, cfg, as_of, "_found").drop("_found")
    passed = F.col("passed_prefilter")
    ask = cfg.verdicts_enabled and not skip_verdicts
    if ask:
        joined = scored.join(fresh_verdicts(verdicts, as_of, cfg), "job_id", "left")
    else:
        kinds = {"semantic_score": "int", "semantic_scored_at": "timestamp",
                 "watchlist_dream": "boolean", "life_fit_concerns": "array<string>"}
        joined = scored.withColumns({c: F.lit(None).cast(kinds.get(c, "string"))
                                     for c in VERDICT_FIELDS})
    got = passed & F.col("semantic_score").isNotNull()
    only_passed = {c: F.when(passed, F.col(c)) for c in VERDICT_FIELDS[:5]}
    neutral = {
        **{n: F.when(got, F.col(n)).otherwise("unclear") for n in ALLOWED},
        "watchlist_dream": F.when(got, F.col("watchlist_dream")).otherwise(False),
        "life_fit_concerns": F.when(got, F.col("life_fit_concerns"))
        .otherwise(F.array().cast("array<string>")),
    }
    state = (F.when(got, "scored").when(passed & F.lit(ask), "missing").otherwise("skipped"))
    return joined.withColumns({
        "verdict_state": state, **only_passed, **neutral,
    }).withColumns({
        "score": F.when(F.col("verdict_state") == "scored", F.col("semantic_score"))
        .otherwise(0),
        "algo_score": F.when(passed, 100).otherwise(0),
        "gates_triggered": F.col("hard_disqualifiers"),
        "modifiers_applied": F.col("soft_warnings"),
        "stored_work_mode": F.col("work_mode"),
        "work_mode": F.coalesce(F.col("verdict_work_mode"), F.col("work_mode")),
        "tier": derive_tier(passed, F.col("verdict_state") == "scored",
                            F.coalesce(F.col("semantic_score"), F.lit(0)),
                            F.col("watchlist_dream"), F.col("is_dream_company"),
                            F.col("is_leadership_title"), F.col("geography_match"), cfg),
    })


def with_failure_defaults(df: DataFrame) -> DataFrame:
    """A posting whose scoring produced nothing stays, with score 0 and track 'unscored'."""
    return df.withColumns({"score": F.coalesce("score", F.lit(0)),
                           "track": F.coalesce("track", F.lit("unscored"))})


def calibration(scored: DataFrame, anchors: DataFrame) -> DataFrame:
    """PASS / FAIL per anchor: score within its expected band (missing scores count as 0).

    ``anchors``: job_id, name, expected_min, expected_max.
    """
    got = anchors.join(scored.select("job_id", "score"), "job_id", "left")
    value = F.coalesce("score", F.lit(0))
    return got.select(
        "job_id", "name", value.alias("score"), "expected_min", "expected_max",
        F.when(value.between(F.col("expected_min"), F.col("expected_max")), "PASS")
        .otherwise("FAIL").alias("verdict"))
