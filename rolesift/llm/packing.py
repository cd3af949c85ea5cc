"""Packing documents into fixed-length training sequences by cutting-stock column generation.

Every document (its ids and the end id) is cut into full pieces of ``capacity`` ids and one
tail. Pieces fall into length classes of ``grain`` ids; the histogram of classes is all that the
driver sees. A linear program over patterns (how many pieces of each class share a sequence) is
solved by column generation: a revised simplex keeps the basis, an unbounded knapsack by dynamic
programming prices new patterns. Its solution is rounded down, the rest filled first-fit
decreasing, and patterns are then dealt to pieces by their rank within the class.

Ranks come from hash buckets with counted offsets, so no class meets in one task, however many
documents share a length.

Defined results: null text is the end id alone; rows are cut one by one, so null and repeated
ids simply give pieces of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.common import bare, slices, staged
from rolesift.llm.tokens import spaced_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Packing:
    capacity: int = 1024
    #: Piece lengths are rounded up to multiples of this within the linear program.
    grain: int = 8
    vocabulary: str = "byte_bpe_50k.json"
    end_id: int = 0
    #: Rows of one class that are ranked together.
    bucket_rows: int = 2_000


def cut_pieces(docs: DataFrame, rule: Packing = Packing(), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Full pieces and tail of every document with the CRC-32 of their ids."""

    def run(batches):
        encode = spaced_ids(rule.vocabulary).encode
        end, step = np.array([rule.end_id], "<u4").tobytes(), 4 * rule.capacity
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                rows += [(key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                         for at in range(0, len(ids), step) for part in [ids[at:at + step]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                [c.split()[0] for c in PIECES.split(", ")])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- patterns

def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for the given values: unbounded knapsack by dynamic programming."""
    use = np.flatnonzero(values > 1e-12)
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    if not len(use):
        return 0.0, np.zeros(len(sizes), np.int64)
    order = use[np.argsort(sizes[use], kind="stable")]
    s, v = sizes[order], values[order]
    fitting = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fitting[c]:
            totals = best[c - s[:k]] + v[:k]
            i = int(totals.argmax())
            if totals[i] > best[c] + 1e-15:
                best[c], took[c] = totals[i], order[i]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                      gap: float = 2e-4, smooth: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a basis of the cutting-stock program and their use.

    Minimise the number of sequences such that every class is covered at least as often as
    demanded. New patterns are priced at a mean of the current prices and the best ones so far,
    which steadies them; where that finds nothing, at the current prices alone. Ends when the
    best dual bound is within ``gap`` of the solution (or half a sequence), or when no pattern improves it.
    """
    m = len(sizes)
    cost, basis = np.ones(m), np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x, bound, centre, turn = inverse @ demand, 0.0, None, 0
    while True:
        turn += 1
        prices = np.einsum("i,ij->j", cost, inverse)  # small: threads of BLAS only cost time
        low = int(prices.argmin())
        if prices[low] < -1e-9:  # cover this class more often than demanded
            column, price = np.zeros(m), 0.0
            column[low] = -1
        else:
            price, better = 1.0, False
            trials = [prices] if centre is None else [smooth * centre + (1 - smooth) * prices,
                                                      prices]
            for trial in trials:
                value, column = knapsack(trial, sizes, capacity)
                proven = trial @ demand / max(value, 1.0)
                if proven > bound:
                    bound, centre = proven, trial / max(value, 1.0)
                better = column @ prices > 1 + 1e-9
                if better:
                    break
            if not better or x @ cost - bound <= max(gap * bound, 0.5):
                break
        step = np.einsum("ij,j->i", inverse, column)
        able = step > 1e-10
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave], cost[leave] = column, price
        if turn % 64:
            row = inverse[leave] / step[leave]
            inverse -= np.outer(step, row)
            inverse[leave] = row
            x = np.maximum(x - ratio[leave] * step, 0)
            x[leave] = ratio[leave]
        else:
            inverse = invert(basis)
            x = np.maximum(inverse @ demand, 0)
    patterns = cost > 0
    return np.rint(basis[:, patterns]).astype(np.int64), x[patterns]


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse. The matrices are small, and a threaded library call stalls on a
    driver whose cores are taken."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        work -= np.outer(factors, work[k])
    return work[:, n:]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(class sizes, pieces of each class in a sequence, number of such sequences)."""
    sizes = np.array(sorted(histogram, reverse=True), np.int64)
    left = np.array([histogram[s] for s in sizes], np.int64)
    out = []

    def take(pattern: np.ndarray, times: int) -> None:
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            left[:] -= pattern * times
            out.append((sizes[used], pattern[used], times))

    if len(sizes):
        basis, x = column_generation(sizes, left.astype(float), capacity)
        for j in np.argsort(-x, kind="stable"):
            take(basis[:, j], int(np.floor(x[j] + 1e-7)))
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for i in np.flatnonzero(left):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        take(pattern, int(left.max()))
    return out


# ---------------------------------------------------------------- assignment

def pack(docs: DataFrame, rule: Packing = Packing(), id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    units = rule.capacity // rule.grain
    pieces = staged(cut_pieces(docs, rule, id_col, text_col), "pieces").withColumn(
        "class", F.ceil(F.col("length") / rule.grain).cast("long"))
    # At most one row per class: bounded by capacity / grain.
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    deals, sequences, given = [], 0, {c: 0 for c in histogram}
    for sizes, counts, times in plan(histogram, units):
        for c, per in zip(sizes.tolist(), counts.tolist()):
            deals.append((c, given[c], given[c] + per * times, per, sequences))
            given[c] += per * times
        sequences += times
    buckets = spark.createDataFrame(
        [(c, -(-n // rule.bucket_rows)) for c, n in histogram.items()], "class long, buckets long")
    dealt = spark.createDataFrame(
        deals, "class long, low long, high long, per long, first long")

    # Both tables are bounded by the number of classes and patterns, not by the documents.
    pieces = pieces.join(F.broadcast(buckets), "class").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start"), "buckets"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("class", "bucket").count().select(
        "class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("lead"))
    inside = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(inside)).join(
        offsets, ["class", "bucket"]).withColumn("rank", F.col("lead") + F.col("place") - 1)
    d = F.broadcast(dealt.withColumnRenamed("class", "dealt_class"))
    placed = ranked.join(d, (F.col("class") == F.col("dealt_class"))
                         & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))) \
        .withColumn("turn", F.col("rank") - F.col("low")) \
        .withColumn("sequence_id", F.col("first") + F.floor(F.col("turn") / F.col("per"))) \
        .withColumn("slot", F.col("turn") % F.col("per"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(
        Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
