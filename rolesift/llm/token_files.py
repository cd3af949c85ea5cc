"""Token files in directly addressable codes, and random access to them.

An id is split into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id
that has one, as plain bytes, and a bitmap telling which of these ids go on to level k + 1; a
rank directory holds the number of set bits before every 512th bit. Any id is found by one
lookup, one bit test and one rank per level; nothing is decoded block by block.

A shard is one file: a header, the ids, offsets and null flags of its documents, and the levels.
Shards follow one another in ascending ``doc_id`` order. Documents are range-partitioned and
sorted first, so each task writes its own shards and no id stream passes one place.

Defined results: null text is empty (the end id alone); null ids sort first; rows with equal ids
are ordered by text and kept; an empty table gives no shards and no rows; other columns are not
read. A document longer than ``shard_tokens`` has a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm.common import bare, new_folder, read_blobs, slices, staged, write_blobs
from rolesift.llm.tokens import spaced_ids

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"DACT"
HEADER = struct.Struct("<4sIQQQQ")
#: Bits per entry of a rank directory.
STRIDE = 512


class Codes:
    """One sequence of ids as levels of bytes, bitmaps and rank directories."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> "Codes":
        levels, rest = [], ids.astype(np.uint32)
        while True:
            chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
            more = rest > 0
            bits = np.packbits(more, bitorder="little")
            levels.append((chunk, bits, directory(bits)))
            rest = rest[more]
            if not len(rest):
                return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = rank(bits, ranks, i)
        raise ValueError("codes end in a set continuation bit")

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start to stop, reading only these positions on every level."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            if start >= stop:
                break
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[start >> 3:(stop + 7) >> 3], bitorder="little")[
                start & 7:(start & 7) + stop - start].astype(bool)
            start = rank(bits, ranks, start)
            stop = start + int(more.sum())
            where = where[more]
        return out

    def tobytes(self) -> bytes:
        out = [struct.pack("<I", len(self.levels))]
        for chunk, bits, ranks in self.levels:
            out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(),
                    ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def frombytes(cls, data: memoryview, at: int = 0) -> "Codes":
        (count,), at, levels = struct.unpack_from("<I", data, at), at + 4, []
        for _ in range(count):
            (n,), at = struct.unpack_from("<Q", data, at), at + 8
            n_bits, n_ranks = (n + 7) // 8, (n + STRIDE - 1) // STRIDE
            chunk = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(data, "<u4", n_ranks, at + n + n_bits)
            at += n + n_bits + 4 * n_ranks
            levels.append((chunk, bits, ranks))
        return cls(levels)


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before every STRIDE-th bit."""
    step = STRIDE // 8
    padded = np.concatenate([_ONES[bits], np.zeros(-len(bits) % step, np.uint8)])
    sums = padded.reshape(-1, step).sum(1, dtype=np.int64)
    return (np.cumsum(sums) - sums).astype("<u4")


def rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
    """Set bits before bit i."""
    if not len(ranks):
        return 0
    entry = min(i // STRIDE, len(ranks) - 1)
    count = int(ranks[entry]) + int(_ONES[bits[entry * STRIDE // 8:i >> 3]].sum(dtype=np.int64))
    return count + (int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)


# ---------------------------------------------------------------- shards

def pack_shard(part: int, seq: int, doc_ids: list, streams: list[bytes]) -> bytes:
    size = np.fromiter((len(s) // 4 for s in streams), np.int64, len(streams))
    ids = np.frombuffer(b"".join(streams), "<u4")
    head = HEADER.pack(MAGIC, 1, part, seq, len(doc_ids), len(ids))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    return b"".join([head, keys.tobytes(), null.tobytes(), bounds.tobytes(),
                     Codes.of(ids).tobytes()])


class Shard:
    """A shard opened from its bytes."""

    def __init__(self, data: bytes):
        magic, version, self.part, self.seq, n, self.tokens = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard of this version")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.bounds = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.codes = Codes.frombytes(memoryview(data), at + 9 * n + 8 * (n + 1))

    def document(self, i: int) -> np.ndarray:
        return self.codes.range(int(self.bounds[i]), int(self.bounds[i + 1]))


def write_tokens(docs: DataFrame, path: str, shard_tokens: int = 4 << 20,
                 vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text"
                 ) -> None:
    """Encode every document, append the end id and write the shards below ``path``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = spaced_ids(vocabulary).encode
        part, seq, held, keys, streams = TaskContext.get().partitionId(), 0, 0, [], []
        end = np.array([END_ID], "<u4").tobytes()

        def shard():
            return pa.RecordBatch.from_arrays([pa.array(
                [pack_shard(part, seq, keys, streams)], pa.binary())], ["blob"])

        for batch in slices(batches, "text", 1 << 20):
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                n = len(ids) // 4 + 1
                if keys and held + n > shard_tokens:
                    yield shard()
                    seq, held, keys, streams = seq + 1, 0, [], []
                keys.append(key)
                streams.append(ids + end)
                held += n
        if keys:
            yield shard()

    ordered = bare(docs, doc_id=id_col, text=text_col).repartitionByRange("doc_id") \
        .sortWithinPartitions("doc_id", "text")
    write_blobs(ordered.mapInArrow(run, "blob binary"), "blob", path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: id, global start, length and CRC-32 of its ids."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        names = ["part", "seq", "total", "doc_id", "at", "n_tokens", "ids_crc32"]
        for batch in batches:
            for blob in batch.column(1):
                s = Shard(blob.as_py())
                data = memoryview(s.codes.range(0, s.tokens).astype("<u4").tobytes())
                ends = (4 * s.bounds).tolist()
                crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s.part] * n, pa.int64()), pa.array([s.seq] * n, pa.int64()),
                    pa.array([s.tokens] * n, pa.int64()), pa.array(s.doc_ids, mask=s.null),
                    pa.array(s.bounds[:-1]), pa.array(np.diff(s.bounds)),
                    pa.array(crc, pa.int64())], names)

    return read_blobs(spark, path).mapInArrow(
        run, "part long, seq long, total long, doc_id long, at long, n_tokens long, "
             "ids_crc32 long")


def shard_bases(rows: DataFrame) -> DataFrame:
    """Ids before each shard. Shards of a task are summed in that task's window; only one row
    per writing task meets in the last running sum."""
    heads = rows.select("part", "seq", "total").distinct()
    parts = heads.groupBy("part").agg(F.sum("total").alias("whole"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("lead"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return heads.join(parts, "part").select(
        "part", "seq", (F.col("lead") + F.coalesce(F.sum("total").over(inner), F.lit(0)))
        .alias("base"))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the token files, read them back, one row per document."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, **options)
    rows = staged(read_tokens(spark, path), "token-rows")
    return rows.join(shard_bases(rows), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
