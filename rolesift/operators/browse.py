"""Browse: filters, cross-source deduplication, sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.normalize import normalize_title, rationale_snippet
from rolesift.functions.text import computed_once, text_or_empty

# List-view columns; long text and breakdowns are left out.
BROWSE_COLUMNS = [
    "job_id", "title", "company", "company_normalized", "company_group", "company_tier",
    "score", "qol_score", "track", "engagement_type", "work_mode", "industries", "role_types",
    "salary_min", "salary_max", "posted_at", "semantic_score", "semantic_rationale", "status",
    "source", "location", "url",
]
# Columns carried by each secondary index.
INDEX_COLUMNS = {
    "company": ["company_normalized", "posted_at", "job_id", "title", "score", "status", "url"],
    "source": ["source", "scraped_at", "job_id", "title", "company", "status"],
    "score": ["status", "score_posted", "job_id", "title", "company", "company_normalized",
              "url", "posted_at", "score", "track", "source", "location"],
    "track": ["track", "score_posted", "job_id", "title", "company", "url", "posted_at",
              "score", "status"],
}
SORTS = ("score", "qol", "comp", "newest", "oldest", "company_asc", "company_desc")


@dataclass(frozen=True)
class BrowseSpec:
    status: str = "active"
    q: str = ""
    industries: list[str] = field(default_factory=list)
    role_types: list[str] = field(default_factory=list)
    company_groups: list[str] = field(default_factory=list)
    work_modes: list[str] = field(default_factory=list)
    engagement_types: list[str] = field(default_factory=list)
    min_score: int = 0
    min_qol: int = 0
    min_salary: int = 0
    dedup: bool = True
    sort_by: str = "score"
    sort_dir: str = "desc"
    limit: int = 50
    offset: int = 0

    def with_(self, **changes) -> "BrowseSpec":
        return replace(self, **changes)


def browse_params(params: dict[str, str] | None) -> BrowseSpec:
    """Validated spec from request parameters; bad numbers fall back to their default."""
    p = params or {}

    def names(key: str) -> list[str]:
        return [v.strip() for v in (p.get(key) or "").split(",") if v.strip()]

    def number(key: str, default: int, low: int, high: int | None) -> int:
        try:
            n = int(p.get(key) or default)
        except (TypeError, ValueError):
            return default
        n = max(n, low)
        return n if high is None else min(n, high)

    sort_by = (p.get("sort_by") or "score").lower()
    sort_dir = (p.get("sort_dir") or "desc").lower()
    return BrowseSpec(
        status=p.get("status", "active"), q=(p.get("q") or "").strip(),
        industries=names("industries"), role_types=names("role_types"),
        company_groups=names("company_groups"), work_modes=names("work_modes"),
        engagement_types=names("engagement_types"),
        min_score=number("min_score", 0, 0, 100), min_qol=number("min_qol", 0, 0, 100),
        min_salary=number("min_salary", 0, 0, 10_000_000),
        dedup=(p.get("dedup") or "true").strip().lower() not in ("false", "0", "no", "off"),
        sort_by=sort_by if sort_by in SORTS else "score",
        sort_dir=sort_dir if sort_dir in ("asc", "desc") else "desc",
        limit=number("limit", 50, 1, 200), offset=number("offset", 0, 0, None))


# ---------------------------------------------------------------------------
# Projections and filters
# ---------------------------------------------------------------------------

def project_browse(df: DataFrame) -> DataFrame:
    return df.select(*BROWSE_COLUMNS)


def project_index(df: DataFrame, index: str) -> DataFrame:
    return df.select(*INDEX_COLUMNS[index])


def filter_status(df: DataFrame, status: str = "active") -> DataFrame:
    return df.where(F.col("status") == status)


def search(q: str) -> Column:
    hay = F.lower(F.concat_ws(" ", text_or_empty(F.col("title")),
                              text_or_empty(F.col("company")),
                              text_or_empty(F.col("location"))))
    return F.contains(hay, F.lit(q.strip().lower()))


def overlaps(column: str, wanted: list[str]) -> Column:
    values = F.array(*[F.lit(w.lower()) for w in wanted])
    return F.coalesce(F.arrays_overlap(F.transform(F.col(column), F.lower), values),
                      F.lit(False))


def one_of(column: str, wanted: list[str], missing: str = "") -> Column:
    value = F.lower(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)))
    return value.isin([w.lower() for w in wanted])


def at_least(column: str, n: int) -> Column:
    return F.coalesce(F.col(column), F.lit(0)) >= n


def stated_pay() -> Column:
    """Lower pay bound, else upper; zero counts as absent."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(F.col("salary_min"), zero), F.nullif(F.col("salary_max"), zero))


def min_salary(n: int) -> Column:
    return F.coalesce(stated_pay(), F.lit(0)) >= n


def apply_filters(df: DataFrame, spec: BrowseSpec) -> DataFrame:
    """Only the filters the spec asks for; the status test reaches the scan."""
    out = filter_status(df, spec.status)
    if spec.min_score:
        out = out.where(at_least("score", spec.min_score))
    if spec.min_qol:
        out = out.where(at_least("qol_score", spec.min_qol))
    if spec.min_salary:
        out = out.where(min_salary(spec.min_salary))
    if spec.company_groups:
        out = out.where(one_of("company_group", spec.company_groups))
    if spec.work_modes:
        out = out.where(one_of("work_mode", spec.work_modes))
    if spec.engagement_types:
        out = out.where(one_of("engagement_type", spec.engagement_types, "unclear"))
    if spec.industries:
        out = out.where(overlaps("industries", spec.industries))
    if spec.role_types:
        out = out.where(overlaps("role_types", spec.role_types))
    if spec.q:
        out = out.where(search(spec.q))
    return out


def hide_companies(df: DataFrame, hidden: DataFrame, below_score: int = 0) -> DataFrame:
    """Opt-in: drop postings of hidden companies and below a score."""
    keys = hidden.select(F.lower(F.trim("company_normalized")).alias("company_normalized"))
    out = df.join(keys.distinct(), "company_normalized", "left_anti")
    return out.where(at_least("score", below_score)) if below_score else out


def not_fresh(column: str, cutoff: Column) -> Column:
    """Rows not refreshed since the cutoff; never refreshed counts as stale."""
    return ~F.coalesce(F.col(column) > cutoff, F.lit(False))


# ---------------------------------------------------------------------------
# Deduplication
# ---------------------------------------------------------------------------

def dedup_postings(df: DataFrame) -> DataFrame:
    """One row per (company, title): best score, earliest job_id on ties.

    Adds dupe_count and dupe_sources (sources by first job_id). Rows without a usable key
    pass through with NULL in both. Aggregation runs in two steps, per source and then per
    key, and both combine before their shuffle, so a posting copied a billion times costs a
    handful of rows per task instead of one oversized group.
    """
    company = F.lower(F.trim(text_or_empty(F.col("company_normalized"))))
    keyed = df.withColumns({"_ck": company, "_tk": normalize_title(F.col("title"))})
    # A row without a usable key is a group of its own, so one branch reads the input once.
    keyed = keyed.withColumn("_own", F.when((F.col("_ck") == "") | (F.col("_tk") == ""),
                                            F.col("job_id")))
    rank = F.struct((-F.coalesce("score", F.lit(0))).alias("a"), F.col("job_id").alias("b"))
    row = F.struct(*[F.col(c) for c in df.columns])
    per_source = keyed.groupBy("_ck", "_tk", "_own", "source").agg(
        F.count(F.lit(1)).alias("_n"), F.min("job_id").alias("_first"),
        F.min_by(row, rank).alias("_row"), F.min(rank).alias("_rank"))
    seen = F.sort_array(F.collect_list(F.when(
        F.nullif("source", F.lit("")).isNotNull(),
        F.struct(F.col("_first").alias("f"), F.col("source").alias("s")))))
    shared = F.col("_own").isNull()
    return per_source.groupBy("_ck", "_tk", "_own").agg(
        F.sum("_n").alias("_n"), F.min_by("_row", "_rank").alias("_row"),
        F.transform(seen, lambda e: e["s"]).alias("_sources")).select(
            "_row.*", F.when(shared, F.col("_n")).alias("dupe_count"),
            F.when(shared, F.col("_sources")).alias("dupe_sources"))


# ---------------------------------------------------------------------------
# Sorting and paging
# ---------------------------------------------------------------------------

def sort_columns(sort_by: str = "score", sort_dir: str = "desc") -> list[Column]:
    """Total order for a sort option; job_id breaks ties."""
    def flat(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    company = F.lower(F.trim(text_or_empty(F.col("company"))))
    best = flat("score", 0).desc()
    keys = {
        "score": flat("score", 0), "qol": flat("qol_score", 0),
        "comp": F.coalesce(stated_pay(), F.lit(-1)), "newest": F.col("posted_at"),
        "semantic": flat("semantic_score", -1),
    }
    if sort_by == "company_asc":
        return [company.asc(), best, F.col("job_id").asc()]
    if sort_by == "company_desc":
        return [company.desc(), best, F.col("job_id").asc()]
    if sort_by == "oldest":
        return [F.col("posted_at").asc_nulls_first(), F.col("job_id").asc()]
    key = keys.get(sort_by, keys["score"])
    ordered = key.asc_nulls_first() if sort_dir == "asc" else key.desc_nulls_last()
    return [ordered, F.col("job_id").asc()]


def paginate_offset(df: DataFrame, spec: BrowseSpec) -> DataFrame:
    """Rows offset .. offset+limit of the total order (a top-k, no full sort)."""
    return df.orderBy(*sort_columns(spec.sort_by, spec.sort_dir)) \
        .offset(spec.offset).limit(spec.limit)


def page_totals(filtered: DataFrame, spec: BrowseSpec) -> DataFrame:
    """One row: raw_total, total, dupes_collapsed, has_more, next_offset."""
    raw = filtered.agg(F.count(F.lit(1)).alias("raw_total"))
    if spec.dedup:
        key = F.struct(F.lower(F.trim(text_or_empty(F.col("company_normalized")))).alias("c"),
                       normalize_title(F.col("title")).alias("t"))
        per_key = filtered.select(key.alias("k")).groupBy("k").count()
        usable = (F.col("k.c") != "") & (F.col("k.t") != "")
        raw = per_key.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("raw_total"),
            F.coalesce(F.sum(F.when(usable, 1).otherwise(F.col("count"))), F.lit(0))
            .alias("total"))
    else:
        raw = raw.withColumn("total", F.col("raw_total"))
    end = spec.offset + spec.limit
    return raw.select("raw_total", "total",
                      (F.col("raw_total") - F.col("total")).alias("dupes_collapsed"),
                      (F.col("total") > end).alias("has_more"),
                      F.when(F.col("total") > end, F.lit(end).cast("bigint"))
                      .alias("next_offset"))


def paginate_cursor(df: DataFrame, limit: int = 50, after: tuple[str, str] | None = None,
                    status: str = "active") -> DataFrame:
    """Keyset page by (score_posted desc, job_id asc); ``after`` is the last row seen."""
    limit = max(1, min(200, limit))
    rows = filter_status(df, status)
    if after is not None:
        key, job = after
        rows = rows.where((F.col("score_posted") < key)
                          | ((F.col("score_posted") == key) & (F.col("job_id") > job)))
    return rows.orderBy(F.col("score_posted").desc(), F.col("job_id").asc()).limit(limit)


def next_cursor(page: DataFrame) -> DataFrame:
    """Last (score_posted, job_id) of a page, as the cursor of the next one."""
    last = page.orderBy(F.col("score_posted").asc(), F.col("job_id").desc()).limit(1)
    return last.select("score_posted", "job_id")


def hydrate_fields(page: DataFrame, base: DataFrame,
                   columns: tuple[str, ...] = ("work_mode", "engagement_type")) -> DataFrame:
    """Columns of the base table joined back onto index rows."""
    return page.join(base.select("job_id", *columns), "job_id", "left")


def browse(df: DataFrame, spec: BrowseSpec | None = None) -> DataFrame:
    """Filter, deduplicate, sort, page and shorten rationales."""
    spec = spec or BrowseSpec()
    rows = project_browse(apply_filters(df, spec))
    if spec.dedup:
        rows = dedup_postings(rows)
    page = paginate_offset(rows, spec)
    return page.withColumn("semantic_rationale", rationale_snippet(F.col("semantic_rationale")))


def top_by(df: DataFrame, where: Column, order: list[Column], n: int,
           computed: bool = False) -> DataFrame:
    """First n rows of a filtered total order.

    ``computed`` says that ``where`` reads columns that the plan computes, which the filter would
    compute once more; on stored columns it would keep the filter from the scan.
    """
    if computed:
        df, where = df.withColumn("_take", computed_once(where)), F.col("_take")
    return df.where(where).orderBy(*order).limit(n).drop("_take")
