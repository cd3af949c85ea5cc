"""Shared pieces: session settings, staged tables, archive files and vectorised words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolesift.session import work_folder

#: Arrow batches carry whole texts, so their bytes are bounded, not only their rows. Shuffle
#: files of a finished write are dropped at once: every step here ends in a written table.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in a table."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_blobs(df: DataFrame, column: str, path: str) -> None:
    """One file per row holding the bytes of ``column``, by Spark's own writer and committer.

    A single zero byte follows the content, which gzip readers take as padding.
    """
    df.select(F.col(column).cast("string").alias("value")).write \
        .option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def bare(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so extra or clashing columns cannot matter."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def plain(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20
           ) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice has about ``limit`` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.frombuffer(lengths(column), np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_numpy(
        zero_copy_only=False)


# ---------------------------------------------------------------- vectorised words

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII punctuation also separates.
PUNCTUATED = SPACES.copy()
PUNCTUATED[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(
                size - 1, b % (1 << 64), np.uint64)]), dtype=np.uint64)
                for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


class Words:
    """Words of a column of texts: byte ranges, owning row and 64-bit hash of each word.

    ``first[r]:first[r + 1]`` are the words of row ``r``. Hashes are polynomial over random
    64-bit symbols, taken block by block from prefix sums; a block ends between words.
    """

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False):
        size = lengths(column)
        self.rows = len(size)
        self.offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.buffer = text_bytes(column)
        n = len(self.buffer)
        gap = separators[self.buffer]
        before = np.ones(n + 1, bool)
        before[1:] = gap
        before[self.offsets] = True
        self.start = np.flatnonzero(before[:-1] & ~gap)
        after = np.ones(n + 1, bool)
        after[:-1] = gap
        after[self.offsets] = True
        self.end = np.flatnonzero(after[1:] & ~gap) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes(lower)

    def _hashes(self, lower: bool) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        w = 0
        while w < len(self.start):
            begin = self.start[w]
            stop = max(w + 1, int(np.searchsorted(self.end, begin + BLOCK, "right")))
            part = self.buffer[begin:self.end[stop - 1]]
            up, down = powers(len(part) + 1)
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_SYMBOL[LOWER[part] if lower else part] * up[:len(part)], out=sums[1:])
            s, e = self.start[w:stop] - begin, self.end[w:stop] - begin
            out[w:stop] = mix((sums[e] - sums[s]) * down[s])
            w = stop
        return out

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one row."""
        total = len(self.hash)
        if total < n:
            return np.empty(0, np.uint64), np.empty(0, bool)
        x = self.hash[:total - n + 1].copy()
        for k in range(1, n):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) \
                + self.hash[k:total - n + 1 + k]
        row = self.row_of_word()
        return mix(x), row[:total - n + 1] == row[n - 1:]


def text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of all texts of the column one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8)
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.empty(0, np.uint8)
    out = np.frombuffer(data, np.uint8)
    if column.null_count:  # a null may own bytes
        keep = column.is_valid().to_numpy(zero_copy_only=False)
        parts = [out[a:b] for a, b, k in zip(offsets[:-1], offsets[1:], keep) if k and b > a]
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return out[offsets[0]:offsets[-1]]


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
