"""Incremental ingestion of landed files and its streaming aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from rolesift.operators.tables import read_snapshot, save_snapshot, upsert_postings
from rolesift.session import delete_folder, path_exists

LANDED = "source string, run_ts timestamp, payload string"


def read_landed(spark: SparkSession, path: str, schema: str = LANDED,
                fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """File stream over a landing folder. The schema is fixed, nothing is inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_upsert(landed: DataFrame, normalize: Callable[[DataFrame], DataFrame], root: str,
                  checkpoint: str):
    """Drain new files and merge each micro-batch into the snapshot table.

    The merge is idempotent by job_id, so a batch that is replayed after a failure, or a
    late re-delivery, leads to the same table.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        incoming = normalize(batch)
        stored = read_snapshot(spark, root)
        if stored is None:
            stored = incoming.limit(0)
        save_snapshot(upsert_postings(stored, incoming).drop("change"), root)

    return (landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def merge_into_buckets(incoming: DataFrame, root: str, buckets: int = 64, files: int = 16) -> None:
    """Merge postings into the table under ``root``, rewriting only buckets that they touch.

    The table lies in directories by a hash of job_id. What is merged is written beside it first and
    then exchanged by dynamic partition overwrite. The merge is idempotent by job_id, so after a
    failure between two directories the same postings bring the table to the same state. A bucket
    is dealt over up to ``files`` tasks, and small ones share a task.
    """
    spark, table = incoming.sparkSession, f"{root}/table"
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    spread = F.pmod(F.hash("job_id"), F.lit(files))
    touched = [r[0] for r in incoming.select(bucket.alias("b")).distinct().collect()]
    if not touched:
        return
    stored = incoming.limit(0)
    if path_exists(spark, table):
        stored = spark.read.parquet(table).where(F.col("bucket").isin(touched)).drop("bucket")
    beside = f"{root}/_merging-{uuid.uuid4().hex}"
    upsert_postings(stored, incoming).drop("change").write.parquet(beside)
    spark.read.parquet(beside).withColumn("bucket", bucket).repartition("bucket", spread) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("bucket").parquet(table)
    delete_folder(spark, beside)


def stream_merge(landed: DataFrame, normalize: Callable[[DataFrame], DataFrame], root: str,
                 checkpoint: str, buckets: int = 64):
    """Drain new files; each micro-batch is merged into the buckets of the table it touches."""
    def merge(batch: DataFrame, _: int) -> None:
        merge_into_buckets(normalize(batch), root, buckets)

    return (landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_merged(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/table").drop("bucket")


def dedup_deliveries(postings: DataFrame, late: str = "1 day") -> DataFrame:
    """Re-delivered postings collapse by job_id; state is dropped behind the watermark."""
    return postings.withWatermark("scraped_at", late).dropDuplicatesWithinWatermark(["job_id"])


def run_counts(runs: DataFrame, late: str = "2 days", streaming: bool = True) -> DataFrame:
    """New and updated postings per source and day."""
    rows = runs.withWatermark("run_timestamp", late) if streaming else runs
    return rows.groupBy(F.window("run_timestamp", "1 day").alias("w"), "source_name").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("jobs_new").alias("jobs_new"),
        F.sum("jobs_updated").alias("jobs_updated")).select(
        F.col("w.start").alias("day"), "source_name", "runs", "jobs_new", "jobs_updated")


# ---------------------------------------------------------------------------
# Run counts as a running query
# ---------------------------------------------------------------------------

DAY_MS = 86_400_000
#: ``kind`` is "count" for a closed day and "late" for a run behind the watermark.
RUN_EVENTS = ("kind string, source_name string, day timestamp, run_timestamp timestamp, "
              "runs long, jobs_new long, jobs_updated long")
_OPEN = "days array<bigint>, runs array<bigint>, jobs_new array<bigint>, jobs_updated array<bigint>"


def run_count_events(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily counts per source in append mode, and the runs that come too late for them.

    A day is put out once, when the watermark has reached its end; until then its counts are the
    only state kept. A run whose day is already closed changes no count: it is put out
    itself, so counts and late runs together are all runs. Runs without a source are a source of
    their own; a run without a time belongs to no day and counts as late.
    """
    def update(key, frames, state):
        closed_at = state.getCurrentWatermarkMs()
        days, *sums = (np.array(x, np.int64) for x in (state.get if state.exists else ([],) * 4))
        for frame in frames:
            frame = frame[~frame["tick"].astype(bool)]
            day = frame["at"] // DAY_MS
            behind = frame["at"].isna() | ((day + 1) * DAY_MS <= closed_at)
            if behind.any():
                old = frame[behind]
                yield pd.DataFrame({
                    "kind": "late", "source_name": key[0],
                    "day": pd.to_datetime(old["at"] // DAY_MS * DAY_MS, unit="ms"),
                    "run_timestamp": pd.to_datetime(old["at"], unit="ms"), "runs": 1,
                    "jobs_new": old["jobs_new"], "jobs_updated": old["jobs_updated"]})
            fresh = frame[~behind]
            more = np.concatenate([days, day[~behind].to_numpy(np.int64)])
            days, slot = np.unique(more, return_inverse=True)
            added = (np.ones(len(fresh)), fresh["jobs_new"].fillna(0),
                     fresh["jobs_updated"].fillna(0))
            sums = [np.bincount(slot, np.concatenate([s, np.asarray(a, np.float64)]), len(days))
                    .astype(np.int64) for s, a in zip(sums, added)]
        done = (days + 1) * DAY_MS <= closed_at
        if done.any():
            start = pd.to_datetime(days[done] * DAY_MS, unit="ms")
            yield pd.DataFrame({
                "kind": "count", "source_name": key[0], "day": start, "run_timestamp": pd.NaT,
                "runs": sums[0][done], "jobs_new": sums[1][done],
                "jobs_updated": sums[2][done]})
        days, sums = days[~done], [s[~done] for s in sums]
        if len(days):
            state.update((days.tolist(), *(s.tolist() for s in sums)))
            state.setTimeoutTimestamp(int(days.min() + 1) * DAY_MS)
        elif state.exists:
            state.remove()

    # Spark drops rows whose watermarked time is late. So each run comes twice: as a tick that moves
    # the watermark, and with its time as a number beside a null one.
    clock = F.posexplode(F.array("run_timestamp", F.lit(None).cast("timestamp")))
    timed = runs.select(
        "source_name", F.unix_millis("run_timestamp").alias("at"),
        F.col("jobs_new").cast("long").alias("jobs_new"),
        F.col("jobs_updated").cast("long").alias("jobs_updated"), clock.alias("nth", "clock")) \
        .select("source_name", "at", "jobs_new", "jobs_updated", (F.col("nth") == 0).alias("tick"),
                "clock")
    return timed.withWatermark("clock", late).groupBy("source_name").applyInPandasWithState(
        update, RUN_EVENTS, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)


def write_run_events(events: DataFrame, root: str, checkpoint: str):
    """Counts and late runs as two directories of one file sink, each row exactly once."""
    return (events.writeStream.format("parquet").partitionBy("kind").option("path", root)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def read_run_events(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.schema(RUN_EVENTS).parquet(root).where(F.col("kind") == kind).drop("kind")
