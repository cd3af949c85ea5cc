"""Benchmark decontamination: rare word n-gram seeds, then Smith-Waterman alignment.

Words are runs, with A-Z lower-cased, of anything but white space and ASCII punctuation. A seed is an
n-gram of a test item that is rare in the corpus: document frequencies of all item n-grams are
counted over all documents first. Where a document holds a seed, the passage around it on the
seed's diagonal is aligned with the item; the score is that of the best local alignment divided
by that of the item with itself. Edits, insertions and omissions lower it, they do not end it. An
excerpt of a long item may be a small share of it, so an alignment worth ``excerpt_words`` equal
words in a row counts as well.

The items are a stated set against which every document is tested. They are taken in blocks of a
bounded number of words, each block a scan of the documents; nothing is shuffled but the counts
of seeds and the rows found.

Defined results: null or empty texts and items match nothing; items shorter than the n-gram say
too little inside a sentence and match only where they are all the words of a line; null and repeated ids pass through row by row; empty tables give no
rows, and ``clean`` then returns the documents unchanged; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import PUNCTUATED, Words, bare, slices, staged

FOUND = ("doc_id long, item_id long, score double, aligned long, passage_start long, "
         "passage_end long")


@dataclass(frozen=True)
class Rule:
    n: int = 3
    #: Least score of a contaminated passage.
    threshold: float = 0.5
    #: Or the score of so many consecutive equal words, whatever share of the item they are.
    excerpt_words: int = 50
    #: A seed is rare if at most this share of documents has it, or if it is no more frequent
    #: than twice the median seed of its item (an item copied everywhere keeps its seeds).
    rare_share: float = 0.001
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: Item words per block; bounds what is sent to every task.
    block_words: int = 500_000


class Seeds:
    """N-grams of a block of items: sorted hashes and, for each, where it occurs."""

    def __init__(self, ids: list, words: Words, n: int, keep: np.ndarray | None = None):
        self.ids = ids
        self.items = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        hashes, item, place, size = [], [], [], []
        for k in range(1, n + 1):
            gram, inside = words.grams(k)
            row = words.row_of_word()[:len(gram)]
            count = np.diff(words.first)[row]
            use = inside & ((count >= n) if k == n else (count == k))
            hashes.append(gram[use])
            item.append(row[use])
            place.append((np.arange(len(gram)) - words.first[row])[use])
            size.append(np.full(int(use.sum()), k))
        h, self.item, self.place, size = map(np.concatenate, (hashes, item, place, size))
        order = np.argsort(h, kind="stable")
        h, self.item, self.place, size = h[order], self.item[order], self.place[order], size[order]
        self.hash, self.first = np.unique(h, return_index=True)
        self.first = np.append(self.first, len(h))
        self.sizes = sorted(set(size.tolist()))
        if keep is not None:
            chosen = keep[np.searchsorted(self.hash, h)] if len(h) else np.zeros(0, bool)
            self.item, self.place, h = self.item[chosen], self.place[chosen], h[chosen]
            self.hash, self.first = np.unique(h, return_index=True)
            self.first = np.append(self.first, len(h))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, seed number) of every seed in the texts."""
        at, which = [], []
        for k in self.sizes:
            gram, inside = words.grams(k)
            spot = np.flatnonzero(
                self.filter[(gram & np.uint64((1 << 20) - 1)).astype(np.int64)] & inside)
            if not len(spot) or not len(self.hash):
                continue
            seed = np.minimum(np.searchsorted(self.hash, gram[spot]), len(self.hash) - 1)
            real = self.hash[seed] == gram[spot]
            at.append(spot[real])
            which.append(seed[real])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(which)


def local_score(item: np.ndarray, passage: np.ndarray, rule: Rule) -> tuple[int, int]:
    """Best Smith-Waterman score and the passage position where that alignment ends.

    A row at a time: the best score with a gap along the row is a running maximum, because gaps
    cost the same at every step.
    """
    slope = np.arange(len(passage) + 1) * -rule.gap
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, rule.match, rule.mismatch),
                             above[1:] + rule.gap)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope) - slope, 0)
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
        above = row
    return best, end


def passages(words: Words, seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, last word + 1) around each group of seeds on near diagonals."""
    at, which = seeds.hits(words)
    if not len(at):
        return
    times = seeds.first[which + 1] - seeds.first[which]
    pick = np.repeat(seeds.first[which], times) + np.arange(times.sum()) - np.repeat(
        np.cumsum(times) - times, times)
    at, item = np.repeat(at, times), seeds.item[pick]
    row = words.row_of_word()[at]
    diagonal = at - words.first[row] - seeds.place[pick]
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    size = np.fromiter((len(i) for i in seeds.items), np.int64, len(seeds.items))
    if not len(row):
        return
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) \
        | (diagonal[1:] - diagonal[:-1] > size[item[1:]])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(row)) - 1
    for b, e in zip(begin, stop):
        r, i = int(row[b]), int(item[b])
        pad, total = int(size[i]) // 2 + 2, int(words.first[r + 1] - words.first[r])
        yield (r, i, max(int(diagonal[b]) - pad, 0),
               min(int(diagonal[e] + size[i]) + pad, total))


def fills_line(words: Words, row: int, first: int, size: int) -> bool:
    """Whether a run of words, counted from the row's first one, is all of a line or more."""
    begin, stop = words.first[row] + first, words.first[row] + first + size
    before = words.buffer[words.end[begin - 1]:words.start[begin]] if first else [10]
    after = words.buffer[words.end[stop - 1]:words.start[stop]] \
        if stop < words.first[row + 1] else [10]
    return 10 in before and 10 in after


def best_matches(column: pa.Array, seeds: Seeds, rule: Rule) -> dict[tuple[int, int], tuple]:
    """(row, item) -> (score, aligned, start, end) of the best passage that counts."""
    words, out = Words(column, PUNCTUATED, lower=True), {}
    for r, i, a, b in passages(words, seeds):
        item, first = seeds.items[i], words.first[r]
        if len(item) < rule.n:
            own = words.hash[first + a:first + b]
            at = next((a + k for k in range(len(own) - len(item) + 1)
                       if (own[k:k + len(item)] == item).all()
                       and fills_line(words, r, a + k, len(item))), None)
            if at is not None:
                out.setdefault((r, i), (1.0, rule.match * len(item), at, at + len(item)))
            continue
        raw, end = local_score(item, words.hash[first + a:first + b], rule)
        score = raw / (rule.match * len(item))
        if (score >= rule.threshold or raw >= rule.match * rule.excerpt_words) \
                and score > out.get((r, i), (0,))[0]:
            out[r, i] = (score, raw, a, a + end)
    return out


def blocks(items: DataFrame, rule: Rule, id_col: str, text_col: str
           ) -> Iterator[tuple[list, Words]]:
    """The distinct items in blocks of about ``block_words`` words; the driver holds one at a time.

    The items are stored with their block first: a block is then one small read of a table.
    """
    rows = bare(items, item_id=id_col, text=text_col).dropDuplicates()
    rows = staged(rows.withColumn("words", F.regexp_count("text", F.lit(r"\S+"))), "items")
    total = rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n = max(1, -(-total // rule.block_words))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        part.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        if part:
            yield [r["item_id"] for r in part], Words(
                pa.array([r["text"] for r in part], pa.string()), PUNCTUATED, lower=True)


def rare_seeds(texts: DataFrame, ids: list, words: Words, rule: Rule) -> Seeds:
    """The block's seeds that are rare in the whole corpus."""
    every = Seeds(ids, words, rule.n)
    shared = texts.sparkSession.sparkContext.broadcast(every)

    def count(batches):
        seeds, total, docs = shared.value, np.zeros(len(shared.value.hash), np.int64), 0
        for batch in slices(batches, "text"):
            w = Words(batch.column(batch.num_columns - 1), PUNCTUATED, lower=True)
            at, which = seeds.hits(w)
            pair = np.unique(w.row_of_word()[at] * len(seeds.hash) + which)
            np.add.at(total, pair % max(len(seeds.hash), 1), 1)
            docs += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))],
            ["seed", "docs"])

    # At most one row per seed of the block reaches the driver.
    sums = {r["seed"]: r["docs"] for r in texts.select("text").mapInArrow(
        count, "seed long, docs long").groupBy("seed").agg(F.sum("docs").alias("docs")).collect()}
    n_docs = sums.pop(-1, 0)
    df = np.zeros(len(every.hash), np.int64)
    df[list(sums)] = list(sums.values())
    of_place = df[np.repeat(np.arange(len(df)), np.diff(every.first))]
    keep = df <= rule.rare_share * n_docs
    for i in range(len(every.items)):
        mine = every.item == i
        if mine.any():
            usual = of_place[mine] <= 2 * np.median(of_place[mine])
            keep[np.repeat(np.arange(len(df)), np.diff(every.first))[mine][usual]] = True
    return Seeds(ids, words, rule.n, keep)


def find(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id",
         text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item with the best passage at or over the threshold."""
    texts = bare(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession

    def block(ids: list, words: Words) -> DataFrame:
        shared = spark.sparkContext.broadcast(rare_seeds(texts, ids, words, rule))

        def run(batches):
            for batch in slices(batches, "text"):
                keys, found = batch.column(0).to_pylist(), best_matches(
                    batch.column(1), shared.value, rule)
                rows = [(keys[r], shared.value.ids[i], *hit) for (r, i), hit in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.float64() if k == 2 else pa.int64())
                         for k, c in enumerate(zip(*rows))],
                        [c.split()[0] for c in FOUND.split(", ")])

        return texts.mapInArrow(run, FOUND)

    parts = [block(*b) for b in blocks(items, rule, item_id, item_text)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], FOUND)


def clean(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a contaminated passage, all columns unchanged."""
    texts, spark = bare(docs, text=text_col), docs.sparkSession
    for ids, words in blocks(items, rule, item_id, item_text):
        shared = spark.sparkContext.broadcast(rare_seeds(texts, ids, words, rule))

        def run(batches, shared=shared):
            for batch in slices(batches, text_col):
                column = batch.column(batch.schema.get_field_index(text_col))
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in best_matches(column, shared.value, rule)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
