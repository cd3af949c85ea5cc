"""Substrings at table size: runs of texts met with a dictionary, and a stored index by q-grams.

Texts are read once, whatever the dictionary's size: runs of a phrase's length that pass a bounded
table of bits are put together where the texts are read, and equal strings meet the dictionary. In
the index a text contains a needle only if it contains all of its q-grams; ``contains`` decides on
the texts left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rolesift.functions.text import INLINE_LIMIT, literals

Q = 3
#: Phrases that the bits are made for, 128 or more each; with more phrases, more runs pass them.
HELD_PHRASES = 1_000_000
#: Positions hashed at once.
BLOCK = 1 << 19
#: Blocks of text put together at once.
SPAN = 8
_END = "\0"
#: Takes the place of ``_END``, and no text has it.
_MARK = 0x110000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, ``n`` of each or more."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(int(_SPREAD), -1, 1 << 64)
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64)
                      for b in (int(_SPREAD), inverse)]
    return _powers


class Windows:
    """Hashes of runs of characters: a polynomial, read off prefix sums at any length."""

    def __init__(self, points: np.ndarray):
        up, self.down = _powers_to(len(points) + 1)
        signs = (points.astype(np.uint64) + np.uint64(1)) * _SPREAD
        signs ^= signs >> np.uint64(31)
        signs *= np.uint64(0xBF58476D1CE4E5B9)
        signs ^= signs >> np.uint64(29)
        signs *= up[:len(signs)]
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(signs, out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        out = self.sums[length:] - self.sums[:-length]
        out *= self.down[:len(out)]
        return out

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


@dataclass(frozen=True)
class Bits:
    """The lengths of all phrases, and a bit for the leading part of each phrase's hash."""

    sizes: list[int]
    bits: np.ndarray

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - (8 * len(self.bits)).bit_length())).view(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``hashes`` of those that may belong to a phrase."""
        slot = self.slots(hashes)
        low = slot.astype(np.uint8) & 7
        slot >>= 3
        return np.flatnonzero((self.bits.take(slot) >> low & 1).view(bool))


def _bits(known: DataFrame) -> Bits:
    """One reading of the phrases; what reaches the driver is bounded by the number of bits."""
    empty = Bits([], np.zeros(1 << max(3, (16 * HELD_PHRASES - 1).bit_length()), np.uint8))

    def mark(batches):
        mine, met = Bits([], empty.bits.copy()), set()
        for _, texts in _portions(batches, 1, BLOCK):
            size = np.array([len(t) for t in texts])
            end = np.cumsum(size)
            slot = mine.slots(Windows(_points("".join(texts))).between(end - size, end))
            np.bitwise_or.at(mine.bits, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
            met.update(size.tolist())
        words = mine.bits.view(np.int64)
        used = np.flatnonzero(words)
        # A length is a row of its own, below 0.
        yield pa.record_batch([pa.array(np.append(used, [-1 - n for n in met]).astype(np.int64)),
                               pa.array(np.append(words[used], [0] * len(met)).astype(np.int64))],
                              ["word", "bits"])

    rows = known.select(F.lit(None).alias("id"), "phrase").mapInArrow(
        mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, value = (rows[c].to_numpy() for c in ("word", "bits"))
    empty.bits.view(np.int64)[word[word >= 0]] = value[word >= 0]
    sizes = np.sort(-1 - word[word < 0]).tolist()
    if 0 in sizes:
        raise ValueError("an empty phrase matches every text")
    return Bits(sizes, empty.bits)


def _portions(batches: Iterator[pa.RecordBatch], column: int, limit: int
              ) -> Iterator[tuple[pa.Array, list[str]]]:
    """First columns and texts of about ``limit`` characters, over the ends of batches."""
    ids, texts, held = [], [], 0
    for batch in batches:
        rows = batch.column(column).to_pylist()
        ends, low = np.cumsum([len(t) for t in rows]), 0
        while low < len(rows):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + limit - held, "right")))
            ids.append(batch.column(0).slice(low, high - low))
            texts += rows[low:high]
            held, low = held + int(ends[high - 1] - done), high
            if low < len(rows) or held >= limit:
                yield pa.concat_arrays(ids), texts
                ids, texts, held = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), texts


def _packed(points: np.ndarray) -> tuple[np.ndarray, int, int]:
    """2, 4 or 8 characters from each position on in one integer, their number and bits a character."""
    met = np.zeros(_MARK + 1, bool)
    met[points] = True
    codes = (np.cumsum(met) - 1)[points].astype(np.uint64)
    letters = int(met.sum())
    n = 8 if letters <= 1 << 8 else 4 if letters <= 1 << 16 else 2
    for k in (1, 2, 4):
        if k < n:
            after = np.append(codes[k:], np.zeros(min(k, len(codes)), np.uint64))
            codes = (codes << np.uint64(64 // n * k)) | after
    return codes, n, 64 // n


def _strings(whole: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings between these bytes."""
    offsets = np.append(0, np.cumsum(end - start))
    at = np.repeat(start - offsets[:-1], end - start)
    at += np.arange(len(at))
    data = np.frombuffer(whole, np.uint8).take(at)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)),
                                       pa.py_buffer(data))


def _met(texts: list[str], held: Bits) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per length, each distinct run that passes the bits, with the number of texts it is in, and
    which texts these are, ascending, run after run."""
    whole, size = _END.join([*texts, ""]), np.array([len(t) + 1 for t in texts], int)
    points, ends, data = _points(whole), np.cumsum(size) - 1, whole.encode()
    byte = None if len(data) == len(points) else np.append(0, np.cumsum(
        1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
    points[ends] = _MARK
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    packs, many, width = _packed(points)
    places = np.uint64((1 << len(points).bit_length()) - 1)
    longest, hits = max(held.sizes, default=0), {n: [] for n in held.sizes}
    step = max(1, BLOCK // 8)
    for low in range(0, len(points), step):
        windows = Windows(points[low:low + step + longest])
        for n in held.sizes:
            if n >= len(points) - low:
                break  # the mark is last
            hashes = windows.of(n)[:step]
            at = held.may_hold(hashes)
            hits[n].append(hashes[at] & ~places | (at + low).view(np.uint64))

    def parts(at: np.ndarray, n: int) -> Iterator[np.ndarray]:
        if n < many:
            yield packs[at] >> np.uint64(width * (many - n))
        else:
            yield from (packs[at + k] for k in sorted({*range(0, n - many, many), n - many}))

    def changes(at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at) - 1, bool)
        for part in parts(at, n):
            out |= part[1:] != part[:-1]
        return out

    for n, keys in hits.items():
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        if not len(keys):
            continue
        keys.sort()
        apart = (keys[1:] ^ keys[:-1]) > places
        keys &= places
        at = keys.view(np.int64)
        other = changes(at, n)
        if (other & ~apart).any():  # different runs share the leading part of a hash
            group = np.append(0, np.cumsum(apart))
            rows = np.flatnonzero(np.isin(group, group[1:][other & ~apart]))
            mixed = at[rows]
            at[rows] = mixed[np.lexsort([mixed, *parts(mixed, n), group[rows]])]
            other = changes(at, n)
        text = owner[at]
        pair = np.flatnonzero(np.append(True, other | (text[1:] != text[:-1])))
        opens, text = np.append(True, other)[pair], text[pair]
        first = np.flatnonzero(opens)
        begin, count = at[pair[first]], np.diff(np.append(first, len(pair)))
        inside = begin + n <= ends[text[first]]
        begin, text, count = begin[inside], text[np.repeat(inside, count)], count[inside]
        where = (begin, begin + n) if byte is None else (byte[begin], byte[begin + n])
        rows, most = np.append(0, np.cumsum(count)), max(1, 2 * BLOCK // n)
        for low in range(0, len(begin), most):
            cut = slice(low, min(low + most, len(begin)))
            yield (_strings(data, *[x[cut] for x in where]), count[cut],
                   text[rows[low]:rows[cut.stop]])


def _runs(texts: DataFrame, id_col: str, text_col: str, known: DataFrame, counted: bool
          ) -> DataFrame:
    """Runs that may be a phrase: (phrase, id) once per row of ``texts`` it is in, or counted, with
    the smallest id, (phrase, texts, first) per portion of texts."""
    held = texts.sparkSession.sparkContext.broadcast(_bits(known))
    base = texts.select(id_col, F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    limit, own = SPAN * BLOCK, base.schema[0]
    names = ["phrase", "texts", "first"] if counted else ["phrase", own.name]

    def walk(batches):
        for ids, portion in _portions(batches, 1, limit):
            order = pc.sort_indices(ids)
            ids = ids.take(order)
            for runs, count, rows in _met([portion[i] for i in order.to_pylist()], held.value):
                if counted:
                    yield pa.record_batch([runs, pa.array(count), ids.take(
                        pa.array(rows[np.cumsum(count) - count]))], names)
                else:
                    yield pa.record_batch([runs.take(pa.array(np.repeat(
                        np.arange(len(runs)), count))), ids.take(pa.array(rows))], names)

    return base.mapInArrow(walk, StructType([
        StructField("phrase", StringType()), *([StructField("texts", LongType())] * counted),
        StructField(names[-1], own.dataType)]))


def _known(phrases: DataFrame, phrase_col: str) -> DataFrame:
    return phrases.select(F.col(phrase_col).alias("phrase")).where("phrase IS NOT NULL")


def substring_matches(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str,
                      phrase_col: str = "phrase") -> DataFrame:
    """(id, phrase) for every distinct phrase that is anywhere inside a text.

    Null texts and null phrases match nothing, null ids are ids like any other, and rows that
    share an id count as one text source. An empty phrase is refused, as it is in every text.
    While the plan is built the dictionary is read: a handful of phrases become literals, of more
    bits are made and broadcast, and what passes them is joined with the dictionary.
    """
    few = [r[0] for r in phrases.select(phrase_col).where(F.col(phrase_col).isNotNull())
           .distinct().limit(INLINE_LIMIT + 1).collect()]
    if "" in few:
        raise ValueError("an empty phrase matches every text")
    if 0 < len(few) <= INLINE_LIMIT:
        text = F.col(text_col)
        return texts.select(id_col, F.explode(F.filter(
            literals(sorted(few)), lambda p: F.contains(text, p))).alias("phrase")).distinct()
    known = _known(phrases, phrase_col)
    return _runs(texts, id_col, text_col, known, False).join(known, "phrase", "left_semi").select(
        id_col, "phrase").distinct()


def substring_counts(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str,
                     phrase_col: str = "phrase") -> DataFrame:
    """(texts, first, phrase) for every distinct phrase in a text: in how many rows of ``texts``
    it is, and the smallest id of these. Counts combine in the task that reads the texts, so the
    pairs behind them are not shuffled; they meet the dictionary's own rows in one grouping.
    """
    known = _known(phrases, phrase_col)
    runs = _runs(texts, id_col, text_col, known, True)
    # A row of the dictionary counts no texts.
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in runs.schema[1:]]
    return runs.unionAll(known.select("phrase", *nothing)).groupBy("phrase").agg(
        F.sum("texts").alias("texts"), F.min("first").alias("first"),
        F.count(F.when(F.col("texts").isNull(), 1)).alias("held")) \
        .where("held > 0 AND texts > 0").select("texts", "first", "phrase")


# ---------------------------------------------------------------------------
# Stored index
# ---------------------------------------------------------------------------

PARTS = 64
#: Texts numbered together; lists hold places in such a block.
PLACES = 1 << 16
_LISTS = "gram string, block bigint, folder int, places array<int>"


def _part(value: Column, parts: int) -> Column:
    return F.crc32(value.cast("string")) % parts


def _gram_lists(texts: list[str], q: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct q-grams of the texts, where the list of each ends, and all lists: in which texts
    a gram is, in order."""
    whole, size = "".join(texts), np.array([len(t) for t in texts], int)
    if len(whole) < q:
        return [], np.zeros(0, int), np.zeros(0, int)
    points, owner = _points(whole), np.repeat(np.arange(len(size)), size)
    met = np.zeros(points.max() + 1, bool)
    met[points] = True
    letters, codes = int(met.sum()), (np.cumsum(met) - 1)[points]
    keys, top = codes, letters
    for k in range(1, q):
        if top >= 1 << 40:
            kept, keys = np.unique(keys, return_inverse=True)
            top = len(kept)
        keys, top = keys[:-1] * letters + codes[k:], top * letters
    inside = np.flatnonzero(owner[:len(keys)] == owner[q - 1:])
    _, start, gram = np.unique(keys[inside], return_index=True, return_inverse=True)
    gram, place = np.divmod(_sorted_distinct(gram * len(texts) + owner[inside]), len(texts))
    ends = np.searchsorted(gram, np.arange(len(start)), "right")
    return [whole[i:i + q] for i in inside[start].tolist()], ends, place


def _lists(texts: DataFrame, q: int) -> DataFrame:
    """(gram, block, folder, places) of stored texts, one row per gram and run of texts read."""
    def walk(batches):
        for batch in batches:
            block, folder, place = (batch.column(k).to_numpy() for k in range(3))
            text = batch.column(3).to_pylist()
            ends = np.cumsum([len(t) for t in text])
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(folder) != 0)) + 1
            cuts = [*new.tolist(), len(text)]
            low = 0
            while low < len(text):
                done = ends[low - 1] if low else 0
                fits = int(np.searchsorted(ends, done + 4 * BLOCK, "right"))
                high = max(low + 1, min(fits, next(c for c in cuts if c > low)))
                found, last, among = _gram_lists(text[low:high], q)
                yield pa.record_batch([
                    pa.array(found, pa.string()), pa.array(np.full(len(found), block[low])),
                    pa.array(np.full(len(found), folder[low], np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, last).astype(np.int32)),
                                             pa.array(place[low + among].astype(np.int32)))],
                    ["gram", "block", "folder", "places"])
                low = high

    return texts.select("block", F.col("part").alias("folder"), "place", "text").mapInArrow(
        walk, _LISTS)


def build_gram_index(rows: DataFrame, id_col: str, text: Column, root: str, q: int = Q,
                     parts: int = PARTS, files: int = 4) -> None:
    """Store, below ``root``, the texts by id, and in which of them each q-gram of ``text`` is.

    Texts are numbered by block and place as they are written, and what was written is read for
    the lists, so both always agree. A list is an array of places per gram and batch of texts: it is
    put together where the texts are read, and neither ids nor single entries are shuffled. Lists
    lie in directories by a hash of the gram; a frequent gram is dealt over ``files`` files and is no
    single task. Null texts count as empty.
    """
    base = rows.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    nth = F.monotonically_increasing_id()
    base.withColumn("part", _part(F.coalesce(F.col("id").cast("string"), F.lit("")), parts)) \
        .repartition("part", F.pmod(F.xxhash64("id"), F.lit(files))) \
        .sortWithinPartitions("part", "id").withColumn("nth", nth) \
        .select("id", "text", "part", F.shiftright("nth", 16).alias("block"),
                F.col("nth").bitwiseAND(PLACES - 1).cast("int").alias("place")) \
        .write.partitionBy("part").parquet(f"{root}/texts")
    _lists(rows.sparkSession.read.parquet(f"{root}/texts"), q) \
        .withColumn("part", _part(F.col("gram"), parts)) \
        .repartition("part", F.pmod(F.xxhash64("block"), F.lit(files))) \
        .sortWithinPartitions("part", "gram", "block") \
        .write.partitionBy("part").parquet(f"{root}/grams")


def search_gram_index(spark: SparkSession, root: str, needle: str, q: int = Q,
                      parts: int = PARTS) -> DataFrame:
    """(id, text) of the stored texts that contain ``needle``.

    The lists of all its grams are read from their directories and intersected; the texts
    left prune the directories of the texts at run time. A needle shorter than a gram has no list
    and reads the texts. ``q`` and ``parts`` are those of the index.
    """
    texts = spark.read.parquet(f"{root}/texts")
    wanted = sorted({needle[i:i + q] for i in range(len(needle) - q + 1)})
    match = F.contains("text", F.lit(needle))
    if not wanted:
        return texts.where(match).select("id", "text")
    folders = sorted({zlib.crc32(g.encode()) % parts for g in wanted})
    lists = spark.read.parquet(f"{root}/grams").where(
        F.col("part").isin(folders) & F.col("gram").isin(wanted))
    # A text is in the list of a gram once.
    hits = lists.select(F.col("block").alias("_block"), F.col("folder").alias("_at"),
                        F.explode("places").alias("_place")) \
        .groupBy("_block", "_at", "_place").count().where(F.col("count") == len(wanted))
    return texts.join(hits, (F.col("block") == F.col("_block")) & (F.col("place") == F.col("_place"))
                      & (F.col("part") == F.col("_at")), "left_semi") \
        .where(match).select("id", "text")
