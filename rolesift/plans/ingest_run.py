"""One ingest run: landed payloads to postings, rejected rows and a ledger row per source.

The run reads its payloads once. Every payload gets a ``kind``: a posting, a skipped one (the
source's required fields are empty, which is no error) or a rejected one (it cannot be read, or no
spec knows its source). One job writes all three, each into its own partition, which is ``land``;
the merge into the table is the second job. What was accepted or rejected can be read from the first
alone. The ledger counts what was stored, from the few columns that say where
a row came from. What was accepted and is not new was an update, also where one run delivers a
posting twice.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators.combine import union_sources
from rolesift.operators.reports import RUN_TTL_DAYS
from rolesift.operators.tables import upsert_postings
from rolesift.session import shared_folder
from rolesift.sources.specs import INCOMPLETE, SPECS, SourceSpec, normalize_posting, tagged_jobs

POSTING, SKIPPED, REJECTED = "posting", "skipped", "rejected"
UNKNOWN_SOURCE = "unknown source"
#: What a payload's row says about it besides the posting's own columns.
ABOUT = ("reason", "run_ts", "payload")
LEDGER = ("source_name string, run_timestamp timestamp, status string, jobs_found long, "
          "jobs_new long, jobs_updated long, jobs_skipped long, n_errors long, "
          "duration_ms long, expires_at long, error_message string")


@dataclass(frozen=True)
class Landed:
    """Stored payloads of a run: ``items`` is all of them with their ``kind``, ``failed`` names the
    sources whose plan could not be built."""

    postings: DataFrame
    skipped: DataFrame
    rejected: DataFrame
    items: DataFrame
    failed: dict[str, str]


@dataclass(frozen=True)
class IngestRun:
    """Stored tables; ``merged`` is the table after the run, ``change`` says how it came."""

    postings: DataFrame
    skipped: DataFrame
    rejected: DataFrame
    ledger: DataFrame
    merged: DataFrame


def tag_payloads(raw: DataFrame, as_of: Column, specs: dict[str, SourceSpec]
                 ) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``raw`` (source, run_ts, payload) as a posting row with ``kind`` and
    ``reason``, and the sources whose plan could not be built with the message.

    Sources are separate branches, so an archive laid out by source is read once in all and a
    failing source does not stop the others. Null sources count as unknown.
    """
    parts: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, spec in specs.items():
        try:
            jobs = tagged_jobs(raw.where(F.col("source") == name).drop("source"), spec)
            parts[name] = normalize_posting(jobs, name, as_of, spec.parse_posted, keep=ABOUT)
        except AnalysisException as exc:
            failed[name] = f"{type(exc).__name__}: {exc.getCondition() or exc}"
    known = F.coalesce(F.col("source").isin([*specs]), F.lit(False))
    parts[UNKNOWN_SOURCE] = raw.where(~known).select(
        F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source"), "run_ts", "payload",
        F.lit(UNKNOWN_SOURCE).alias("reason"))
    reason = F.col("reason")
    kind = F.when(reason.isNull(), POSTING).when(F.startswith(reason, F.lit(INCOMPLETE)), SKIPPED) \
        .otherwise(REJECTED)
    tagged = union_sources(parts).withColumn("kind", kind)
    # A good payload is stored as its posting and need not be kept twice.
    return tagged.withColumn("payload", F.when(F.col("kind") != POSTING, F.col("payload"))), failed


def _counted(items: DataFrame) -> dict[str, dict]:
    """Per source: rows of each kind and the least message of a rejected one."""
    rows = items.groupBy("source").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in (POSTING, SKIPPED, REJECTED)],
        F.min(F.when(F.col("kind") == REJECTED, F.col("reason"))).alias("message"))
    return {r["source"]: r.asDict() for r in rows.collect()}


def _json_specs() -> dict[str, SourceSpec]:
    return {n: s for n, s in SPECS.items() if s.schema}


def land(raw: DataFrame, as_of: Column, root: str | None = None,
         specs: dict[str, SourceSpec] | None = None) -> Landed:
    """First step of a run: every payload of ``raw`` is read and stored under ``root``, nothing is
    merged. One job writes."""
    spark = raw.sparkSession
    specs = _json_specs() if specs is None else specs
    root = root or _new_folder(spark)
    tagged, failed = tag_payloads(raw, as_of, specs)
    tagged.write.partitionBy("kind").parquet(f"{root}/items")
    items = spark.read.schema(tagged.schema).parquet(f"{root}/items")

    def of(kind: str) -> DataFrame:
        return items.where(F.col("kind") == kind).drop("kind")

    return Landed(of(POSTING).drop(*ABOUT), of(SKIPPED).select("source", *ABOUT),
                  of(REJECTED).select("source", *ABOUT), items, failed)


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"


def ingest_run(raw: DataFrame, existing: DataFrame, as_of: Column, root: str | None = None,
               specs: dict[str, SourceSpec] | None = None, fetch_errors: dict[str, str] | None = None,
               duration_ms: int | None = None) -> IngestRun:
    """Land one run under ``root`` (a new folder below the shared one by default).

    Two jobs write, one the items and one the merged table; two more count what they wrote. A source
    named in ``fetch_errors`` gets status ``error``, as does one whose plan cannot be built; one
    with rejected payloads is ``partial``. Every source has one ledger row, also with no payload.
    """
    spark = raw.sparkSession
    specs = _json_specs() if specs is None else specs
    root = root or _new_folder(spark)
    landed = land(raw, as_of, root, specs)
    failed = {**landed.failed, **(fetch_errors or {})}
    names = [*dict.fromkeys([*specs, *failed]), UNKNOWN_SOURCE]
    merged = upsert_postings(existing, landed.postings)
    merged.write.parquet(f"{root}/table")
    table = spark.read.schema(merged.schema).parquet(f"{root}/table")
    # Sources nobody knows share one entry, so the list stays as long as the specs.
    source = F.col("source")
    named = F.when(source.isin([n for n in names if n != UNKNOWN_SOURCE]), source) \
        .otherwise(UNKNOWN_SOURCE).alias("source")
    new = table.where("change = 'new'").select(named).groupBy("source").count().collect()
    ledger = _ledger(spark, names, _counted(landed.items.select(named, "kind", "reason")),
                     {r["source"]: r["count"] for r in new}, failed, as_of, duration_ms)
    return IngestRun(landed.postings, landed.skipped, landed.rejected, ledger, table)


def _ledger(spark: SparkSession, names: list[str], landed: dict[str, dict], merged: dict[str, int],
            failed: dict[str, str], as_of: Column, duration_ms: int | None) -> DataFrame:
    """One row per source, a list as long as the specs; unknown sources only where met."""
    rows = []
    for name in names:
        found, new = landed.get(name, {}), merged.get(name, 0)
        good, skipped, bad = (found.get(kind, 0) for kind in (POSTING, SKIPPED, REJECTED))
        if name == UNKNOWN_SOURCE and not bad:
            continue
        status = "error" if name in failed else "partial" if bad else "ok"
        rows.append((name, status, good + skipped + bad, new, good - new, skipped,
                     bad + (name in failed), duration_ms,
                     failed.get(name) or found.get("message")))
    ddl = ("source_name string, status string, jobs_found long, jobs_new long, jobs_updated long, "
           "jobs_skipped long, n_errors long, duration_ms long, error_message string")
    ttl = F.unix_timestamp(as_of) + F.lit(RUN_TTL_DAYS * 86_400)
    return spark.createDataFrame(rows, ddl).withColumns(
        {"run_timestamp": as_of, "expires_at": ttl}).select(
        *[part.strip().split(" ")[0] for part in LEDGER.split(",")])
