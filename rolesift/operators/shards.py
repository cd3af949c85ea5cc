"""Long passes over a table in shards that can be resumed.

The table is dealt into directories by a hash of job_id. A shard is worked on, written and then
entered in a ledger; a pass that is started again works on the shards the ledger lacks, so an
interrupted and resumed pass gives the table of an uninterrupted one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.session import path_exists

DONE = "shard int, rows long"


def write_shards(postings: DataFrame, root: str, of: int, name: str = "input") -> None:
    """Deal the postings into ``of`` shards; null ids share one. Other tables by job_id that the work
    joins are dealt alike under a ``name`` of their own."""
    dealt = postings.withColumn("shard", F.pmod(F.xxhash64("job_id"), F.lit(of)).cast("int"))
    dealt.repartition("shard", F.pmod(F.xxhash64("job_id"), F.lit(of * 4))) \
        .write.partitionBy("shard").parquet(f"{root}/{name}")


def finished(spark: SparkSession, root: str) -> DataFrame:
    """Ledger of finished shards, one row each."""
    if not path_exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], DONE)
    # A shard that was entered twice, by two passes at once, is one.
    return spark.read.schema(DONE).json(f"{root}/ledger").groupBy("shard").agg(
        F.max("rows").alias("rows"))


def unfinished(spark: SparkSession, root: str) -> list[int]:
    shards = spark.read.parquet(f"{root}/input").select("shard").distinct()
    return sorted(r[0] for r in shards.join(finished(spark, root), "shard", "left_anti").collect())


def run_shards(spark: SparkSession, root: str, work: Callable[..., DataFrame],
               stop_after: int | None = None, beside: tuple[str, ...] = ()) -> list[int]:
    """Apply ``work`` to every unfinished shard in turn and return these shards.

    A shard is one Spark job that reads its own directory. Its output replaces what a broken
    attempt may have left. ``stop_after`` ends the pass early, as a time limit would. ``work`` also gets the same shard of
    each table named in ``beside``, so no shard reads or joins a whole table.
    """
    todo = unfinished(spark, root)[:stop_after]
    for shard in todo:
        tables = [spark.read.parquet(f"{root}/{name}").where(F.col("shard") == shard).drop("shard")
                  for name in ("input", *beside)]
        path = f"{root}/output/shard={shard}"
        work(*tables).write.mode("overwrite").parquet(path)
        spark.read.parquet(path).agg(F.lit(shard).alias("shard"), F.count(F.lit(1)).alias("rows")) \
            .write.mode("append").json(f"{root}/ledger")
    return todo


def read_finished(spark: SparkSession, root: str) -> DataFrame:
    """Output of the finished shards; what an attempt left behind unentered is not read."""
    done = [r["shard"] for r in finished(spark, root).collect()]
    return spark.read.option("basePath", f"{root}/output").parquet(
        *[f"{root}/output/shard={n}" for n in sorted(done)]).drop("shard")
