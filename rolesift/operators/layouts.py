"""Stored layouts that answer joins without a shuffle and lookups from few files.

``write_bucketed`` deals a table into buckets of its key: two tables with the same key and number
of buckets join bucket by bucket, and an equality on the key reads one bucket. The index tables
hold the columns of one secondary index, in directories by its first key and sorted by the
second, so the statistics of their files cut the ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators.browse import project_index

BUCKETS = 64


def write_bucketed(df: DataFrame, table: str, key: str, path: str, buckets: int = BUCKETS
                   ) -> DataFrame:
    """Store ``df`` as the catalog table ``table`` in ``buckets`` sorted buckets of ``key``."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key) \
        .option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


@dataclass(frozen=True)
class IndexLayout:
    """Directories and order of one index table; ``folders`` are expressions over its rows."""

    folders: dict[str, str]
    order: tuple[str, ...]


#: Companies are many and share directories by hash; dates lie in one directory per year.
LAYOUTS = {
    "company": IndexLayout({"part": "crc32(company_normalized) % 64"},
                           ("company_normalized", "posted_at")),
    "source": IndexLayout({"of_source": "source", "year": "year(scraped_at)"}, ("scraped_at",)),
    "score": IndexLayout({"of_status": "status"}, ("score_posted",)),
    "track": IndexLayout({"of_track": "track"}, ("score_posted",)),
}


def write_index(df: DataFrame, index: str, path: str, files: int = 16) -> None:
    """Store one index. Rows are dealt by range of directory and key, so a directory that holds
    most of the table becomes several files whose key ranges hardly overlap."""
    layout = LAYOUTS[index]
    rows = project_index(df, index).withColumns({n: F.expr(e) for n, e in layout.folders.items()})
    keys = [*layout.folders, *layout.order, "job_id"]
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys) \
        .write.partitionBy(*layout.folders).parquet(path)


def read_index(spark: SparkSession, index: str, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _newest(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(key).desc(), F.col("job_id")).limit(n)


def by_company(spark: SparkSession, path: str, company: str, n: int = 50) -> DataFrame:
    """Newest postings of a company."""
    rows = read_index(spark, "company", path).where(
        (F.col("part") == F.crc32(F.lit(company)) % 64)
        & (F.col("company_normalized") == company)).drop("part")
    return _newest(rows, "posted_at", n)


def by_source_since(spark: SparkSession, path: str, source: str, since: Column, n: int = 50
                    ) -> DataFrame:
    """Newest postings of a source from ``since`` on."""
    rows = read_index(spark, "source", path).where(
        (F.col("of_source") == source) & (F.col("year") >= F.year(since))
        & (F.col("scraped_at") >= since)).drop("of_source", "year")
    return _newest(rows, "scraped_at", n)


def by_status(spark: SparkSession, path: str, status: str = "active", n: int = 50,
              after: tuple[str, str] | None = None) -> DataFrame:
    """Best postings of a status; ``after`` is the (score_posted, job_id) of the last one seen."""
    rows = read_index(spark, "score", path).where(F.col("of_status") == status).drop("of_status")
    return _newest(_beyond(rows, after), "score_posted", n)


def by_track(spark: SparkSession, path: str, track: str, n: int = 50,
             after: tuple[str, str] | None = None) -> DataFrame:
    """Best postings of a track; ``after`` as in ``by_status``."""
    rows = read_index(spark, "track", path).where(F.col("of_track") == track).drop("of_track")
    return _newest(_beyond(rows, after), "score_posted", n)


def _beyond(rows: DataFrame, after: tuple[str, str] | None) -> DataFrame:
    if after is None:
        return rows
    key, job = after
    # The first test alone reaches the file statistics.
    return rows.where((F.col("score_posted") <= key) & (
        (F.col("score_posted") < key) | (F.col("job_id") > job)))
