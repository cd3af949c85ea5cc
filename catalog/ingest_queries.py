"""Ingest runs, archives, shards and streams over the postings of the test tables."""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.normalize import iso_z
from rolesift.operators import shards as SH
from rolesift.plans import ingest_run as R
from rolesift.sources import archive as A
from rolesift.sources.specs import SPECS, normalize_source
from rolesift.streaming import ingest as ST
from catalog import bindings as B
from catalog.browse_queries import before_rescore, rescored
from catalog.registry import ORACLES, add
from catalog.scalar_queries import iso_sql
from catalog.source_queries import PAYLOADS, expected, folder

c = F.col

# --- one run of every source ----------------------------------------------
# Each posting is delivered by its own source; every seventh twice. Some payloads are cut off,
# missing or no object, and one in 13 comes from a source nobody knows.


def _payload(name: str):
    return F.to_json(F.struct(*[v.alias(n) for n, v in PAYLOADS[name][0]().items()]))


def _delivered(s: SparkSession, d: str) -> DataFrame:
    rows = B.postings(s, d)
    body = F.coalesce(*[F.when(c("source") == n, _payload(n)) for n in B.SOURCES])
    sent = F.when(c("k") % 11 == 0, F.substring(body, 1, 40)).when(c("k") % 11 == 1, None) \
        .when(c("k") % 11 == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    source = F.when(c("k") % 13 == 5, "nobody").otherwise(c("source"))
    times = F.when(c("k") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("k", source.alias("source"), c("posted_at").alias("run_ts"),
                       sent.alias("payload"), F.explode(times).alias("delivery"))


def _table_before(s: SparkSession, d: str) -> DataFrame:
    """Postings with an even key, ingested before."""
    out = None
    for name in B.SOURCES:
        rows = B.postings(s, d).where((c("source") == name) & (c("k") % 2 == 0))
        part = normalize_source(rows.select(_payload(name).alias("payload")), SPECS[name],
                                B.as_of())
        out = part if out is None else out.unionByName(part)
    return out


_SPECS = {n: SPECS[n] for n in B.SOURCES}


def _run(s: SparkSession, d: str) -> R.IngestRun:
    return R.ingest_run(_delivered(s, d).drop("k", "delivery"), _table_before(s, d), B.as_of(),
                        root=folder(s), specs=_SPECS)


def _landed(s: SparkSession, d: str) -> R.Landed:
    return R.land(_delivered(s, d).drop("k", "delivery"), B.as_of(), root=folder(s), specs=_SPECS)


@cache
def _run_sql() -> str:
    made = " UNION ALL ".join(
        f"SELECT * FROM ({expected(native, name, **over)}) WHERE job_id LIKE '{name}:%'"
        for name, (_, native, over) in PAYLOADS.items() if name in B.SOURCES)
    native = " ".join(f"WHEN '{n}' THEN {v[1]}" for n, v in PAYLOADS.items() if n in B.SOURCES)
    return f"""made AS ({made}),
sent AS (SELECT k, CASE WHEN k % 13 = 5 THEN 'nobody' ELSE source END AS source, k % 11 AS r,
  source || ':' || CASE source {native} END AS id, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS times
  FROM postings),
item AS (SELECT k, s.source, id, times, CASE WHEN s.source = 'nobody' THEN 'unknown source'
  WHEN r = 1 THEN 'empty payload' WHEN r IN (0, 2) THEN 'malformed payload'
  WHEN m.job_id IS NULL THEN 'incomplete: title' END AS reason
  FROM sent s LEFT JOIN (SELECT DISTINCT job_id FROM made) m ON m.job_id = id)"""


add("ingest_run", lambda s, d: _run(s, d).ledger.select(
    "source_name", "status", "jobs_found", "jobs_new", "jobs_updated", "jobs_skipped", "n_errors",
    "error_message", "expires_at", iso_z(c("run_timestamp")).alias("run_timestamp")),
    f"""WITH {_run_sql()},
    total AS (SELECT source, sum(times) AS found, sum(times) FILTER (reason IS NULL) AS good,
      count(*) FILTER (reason IS NULL AND k % 2 = 1) AS fresh,
      coalesce(sum(times) FILTER (starts_with(reason, 'incomplete')), 0) AS skipped,
      sum(times) FILTER (reason IS NOT NULL AND NOT starts_with(reason, 'incomplete')) AS bad,
      min(reason) FILTER (NOT starts_with(reason, 'incomplete')) AS message
      FROM item GROUP BY source)
    SELECT CASE source WHEN 'nobody' THEN 'unknown source' ELSE source END AS source_name,
      CASE WHEN bad > 0 THEN 'partial' ELSE 'ok' END AS status, CAST(found AS BIGINT) AS jobs_found,
      fresh AS jobs_new, CAST(coalesce(good, 0) - fresh AS BIGINT) AS jobs_updated,
      CAST(skipped AS BIGINT) AS jobs_skipped, CAST(coalesce(bad, 0) AS BIGINT) AS n_errors,
      message AS error_message, CAST(epoch(as_of) AS BIGINT) + 30 * 86400 AS expires_at,
      {iso_sql('as_of')} AS run_timestamp FROM total, params""", "params", "postings")
add("ingest_rejected", lambda s, d: _landed(s, d).rejected.groupBy("source", "reason").agg(
    F.count(F.lit(1)).alias("n"), F.count("payload").alias("with_payload")),
    f"""WITH {_run_sql()} SELECT source, reason, CAST(sum(times) AS BIGINT) AS n,
    CAST(coalesce(sum(times) FILTER (k % 11 <> 1), 0) AS BIGINT) AS with_payload FROM item
    WHERE reason IS NOT NULL AND NOT starts_with(reason, 'incomplete') GROUP BY 1, 2""",
    "params", "postings")
add("ingest_merged", lambda s, d: _run(s, d).merged.select("job_id", "change"),
    f"""WITH {_run_sql()} SELECT coalesce(old.job_id, id) AS job_id,
      CASE WHEN old.job_id IS NULL THEN 'new' WHEN id IS NULL THEN 'kept' ELSE 'updated' END
      AS change FROM (SELECT DISTINCT id FROM item WHERE reason IS NULL)
    FULL JOIN (SELECT job_id FROM made JOIN sent ON id = job_id WHERE k % 2 = 0) old
      ON old.job_id = id""", "params", "postings")

# --- archive of runs ------------------------------------------------------
# One run per source and quarter, written twice; then directories of 1000 days and more go.


def _replayed(s: SparkSession, d: str) -> tuple[DataFrame, str]:
    root = folder(s)
    rows = B.postings(s, d).select("source", F.date_trunc("quarter", "posted_at").alias("run_ts"),
                                   F.to_json(F.struct("job_id", "title")).alias("payload"))
    for _ in range(2):
        A.replace_runs(rows, root, files=1)
    return A.read_runs(s, root), root


def _expired(s: SparkSession, d: str) -> DataFrame:
    _, root = _replayed(s, d)
    A.drop_expired(s, root, date.fromisoformat(B.AS_OF[:10]), 1000)
    return A.read_runs(s, root)


_RUN_ROWS = """SELECT source, job_id, CAST(year(posted_at) AS BIGINT) AS y,
  CAST(quarter(posted_at) AS BIGINT) AS q FROM postings, params"""


def _by_quarter(df: DataFrame) -> DataFrame:
    return df.select("source", F.get_json_object("payload", "$.job_id").alias("job_id"),
                     F.year("run_ts").cast("bigint").alias("y"),
                     F.quarter("run_ts").cast("bigint").alias("q"))


add("raw_runs_replayed", lambda s, d: _by_quarter(_replayed(s, d)[0]), _RUN_ROWS,
    "params", "postings")
add("raw_runs_expired", lambda s, d: _by_quarter(_expired(s, d)),
    f"{_RUN_ROWS} WHERE date_trunc('quarter', posted_at) > as_of - INTERVAL 1000 DAY",
    "params", "postings")

# --- resumed passes -------------------------------------------------------


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """A rescore pass that stops after one of three shards and is started again."""
    root = folder(s)
    SH.write_shards(before_rescore(s, d), root, 3)
    SH.write_shards(B.verdicts(s, d), root, 3, "verdicts")
    for stop in (1, None):
        SH.run_shards(s, root, lambda rows, verdicts: rescored(s, d, rows, verdicts).select(
            "job_id", "outcome", c("score").cast("bigint").alias("score"), "tier", "track",
            c("semantic_score").cast("bigint").alias("semantic_score")), stop, ("verdicts",))
    return SH.read_finished(s, root)


add("rescore_resumed", _resumed)
ORACLES["rescore_resumed"] = ORACLES["rescore"]

# --- run counts as a stream -----------------------------------------------
# Events arrive in five files by time; some of the first file come with the fourth.
_CUTS = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-27")
_SLICE = "CASE " + " ".join(f"WHEN {{ts}} < TIMESTAMP '{d}' THEN {i}" for i, d in enumerate(_CUTS)) \
    + f" ELSE {len(_CUTS)} END"


def _run_events(s: SparkSession, d: str) -> str:
    root = folder(s)
    rows = B.runs(s, d).withColumn("slice", F.expr(_SLICE.format(ts="run_timestamp"))).withColumn(
        "slice", F.expr("CASE WHEN slice = 0 AND run_id % 50 = 7 THEN 3 ELSE slice END"))
    for i in range(len(_CUTS) + 1):     # files are taken in the order they were written
        rows.where(c("slice") == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
    ddl = ("source_name string, run_timestamp timestamp, jobs_new long, jobs_updated long")
    stream = ST.read_landed(s, f"{root}/in", ddl, "parquet", max_files=1)
    ST.write_run_events(ST.run_count_events(stream), f"{root}/out", f"{root}/progress") \
        .awaitTermination()
    return f"{root}/out"


_SLICED = f"""timed AS (SELECT *, CASE WHEN run_timestamp < TIMESTAMP '{_CUTS[0]}'
    AND run_id % 50 = 7 THEN 'late' ELSE 'count' END AS kind FROM runs),
  seen AS (SELECT max(run_timestamp) - INTERVAL 2 DAY AS watermark FROM runs)"""
add("stream_run_windows", lambda s, d: ST.read_run_events(s, _run_events(s, d), "count").select(
    iso_z(c("day")).alias("day"), "source_name", "runs", "jobs_new", "jobs_updated"),
    f"""WITH {_SLICED} SELECT {iso_sql("date_trunc('day', run_timestamp)::TIMESTAMP")} AS day,
      source_name, count(*) AS runs, CAST(sum(jobs_new) AS BIGINT) AS jobs_new,
      CAST(sum(jobs_updated) AS BIGINT) AS jobs_updated FROM timed, seen
    WHERE kind = 'count' AND date_trunc('day', run_timestamp) + INTERVAL 1 DAY <= watermark
    GROUP BY 1, 2""", "runs")
add("stream_late_runs", lambda s, d: ST.read_run_events(s, _run_events(s, d), "late").select(
    iso_z(F.date_trunc("second", "run_timestamp")).alias("run_timestamp"), "source_name",
    "jobs_new", "jobs_updated"),
    f"""WITH {_SLICED} SELECT {iso_sql("date_trunc('second', run_timestamp)")} AS run_timestamp,
      source_name, jobs_new, jobs_updated FROM timed WHERE kind = 'late'""", "runs")
