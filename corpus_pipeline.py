"""The corpus pipeline: documents through quality rules, deduplication, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolesift.llm import common, decontaminate, jaccard, line_dedup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject; statistics come from the stage's input."""
    labels = common.tuned(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages of lines from the texts; every document stays."""
    common.tuned(spark)
    return line_dedup.remove(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles link at 0.8 or more.

    A text that is empty here had all its lines in other documents, and goes as well.
    """
    common.tuned(spark)
    return jaccard.keep_one(docs.filter("NOT text <=> ''"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    items = common.tuned(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into pieces and assign these to sequences."""
    common.tuned(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines),
          ("jaccard_join", dedup_documents), ("decontamination", drop_contaminated),
          ("packing", pack)]
#: Hashing, alignment and column generation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = common.tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
