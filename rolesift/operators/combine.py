"""Joins and set operations used across the pipeline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cap_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows per key (the site's own posting cap), best first.

    Spark turns ``row_number <= n`` into a limit inside each task before the shuffle, so a
    hot key sends n rows per task.
    """
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def distinct_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key by ``order``; an aggregate, so it combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    rank = F.struct(*order)
    return df.groupBy(key).agg(F.min_by(row, rank).alias("_r")).select(key, "_r.*")


def salted_left_join(big: DataFrame, dim: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Left join for a dimension too large to broadcast and a key that owns much of ``big``.

    Rows of ``big`` spread over ``salts`` slices of their key and the dimension is repeated
    per slice, so the result is exactly that of a plain left join.
    """
    row = F.xxhash64(F.to_json(F.struct(*big.columns)))  # the same salt on every attempt
    salted = big.withColumn("_salt", F.pmod(row, F.lit(salts)))
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) \
        .withColumn("_salt", F.col("_salt").cast("bigint"))
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``rows`` rows, which is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def phrase_matches(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str,
                   max_words: int) -> DataFrame:
    """(id, kind, bucket, phrase) for word-bounded dictionaries that live in a table.

    Phrases are matched as word n-grams with an equality join, so the work grows with
    texts x words and not with texts x phrases. ``max_words`` is the longest phrase.
    """
    words = F.col("_words")
    positions = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words)))

    def gram(i: Column, n: int) -> Column:
        return F.when(i + n - 1 <= F.size(words), F.array_join(F.slice(words, i, n), " "))

    grams = F.array_distinct(F.array_compact(F.flatten(F.transform(
        positions, lambda i: F.array(*[gram(i, n) for n in range(1, max_words + 1)])))))
    split = texts.select(id_col, F.regexp_extract_all(
        F.lower(F.col(text_col)), F.lit(r"\w+"), 0).alias("_words"))
    exploded = split.select(id_col, F.explode(grams).alias("phrase"))
    wanted = phrases.select("kind", "bucket", "phrase").distinct()
    # Frequent phrases are hot keys: a small dictionary goes to the texts instead.
    return exploded.join(broadcast_if_small(wanted), "phrase").select(
        id_col, "kind", "bucket", "phrase")


def union_sources(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as one table; a column one source lacks is NULL there."""
    out: DataFrame | None = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out
