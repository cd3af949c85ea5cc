"""Quality rules: word statistics and a hashed n-gram log-likelihood ratio per document.

Two multinomials over hashed word unigrams and bigrams are counted: one over the whole corpus,
one over all documents labelled as trusted. A document's score is the mean, over its n-grams, of
the log ratio of trusted to raw probability. It is kept when no base rule rejects it and the score
reaches the model's threshold. The threshold is set from all labelled rows: of all that keep the
stated share of the trusted ones, it rejects the most rows labelled bad (quality 0 or toxic),
midway in the gap that leaves. Only where no such row passes the base rules is it the trusted
quantile less a margin.

Defined results: a null or empty text has no words, fails the base rules and is rejected; null
ids pass through; repeated rows each get the same result; an empty table gives no rows. Columns
other than the id and the text are never read, so their names cannot clash. Without trusted
documents the ratio is 0 for every n-gram and only the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import SPACES, Words, bare, drop_staged, per_row, slices, staged

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean, llr double")
#: Bits that tell which hashes of ids have a label.
SLOTS = 1 << 24
#: Parts that a range of scores is cut into at once.
CUTS = 1 << 12


@dataclass(frozen=True)
class Rules:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    #: The threshold leaves at most this share of the trusted documents below it.
    tail: float = 0.001
    #: Taken off where no bad document is labelled.
    margin: float = 0.25
    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    threshold: float


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted, bad): trusted is quality 1 and not toxic, bad is quality 0 or toxic."""
    sides = labels.select("doc_id", F.expr("quality = 1 AND toxic = 0").alias("trusted"),
                          F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return sides.filter("doc_id IS NOT NULL AND (trusted OR bad)").groupBy("doc_id").agg(
        *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("trusted", "bad")])


def split(texts: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may have a mark, and those that have none.

    One bit per hash of an id tells them apart. The bits are a table of bounded size, which is sent
    to the texts, so texts without a mark need not be dealt by id.
    """
    slot, word, place = f"pmod(xxhash64(doc_id), {SLOTS})", "slot DIV 64", "int(slot % 64)"
    words = marked.selectExpr(f"{slot} AS slot").groupBy(F.expr(word).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, {place}))").alias("bits"))
    hit = F.expr(f"doc_id IS NOT NULL AND COALESCE(getbit(bits, {place}) = 1, false)")
    found = texts.selectExpr("*", f"{slot} AS slot").withColumn("word", F.expr(word)) \
        .join(F.broadcast(words), "word", "left").withColumn("hit", hit)
    return tuple(found.filter(c).select(texts.columns) for c in ("hit", "NOT hit"))


def threshold(trusted: np.ndarray, bad: np.ndarray, rules: Rules = Rules()) -> float:
    """From the scores of labelled documents that pass the base rules."""
    if not len(trusted):
        return -rules.margin
    low = np.sort(trusted)[int(rules.tail * len(trusted))]
    if not len(bad):
        return float(low - rules.margin)
    below = bad[bad < low]
    return float((low + below.max()) / 2 if len(below) else low)


def nth(values: DataFrame, k: int) -> float:
    """The double at place ``k`` (from 0) of the sorted column ``llr``.

    The range it lies in is cut into ``CUTS`` parts, of which only counts and ends reach the
    driver, until the part that holds it is one value.
    """
    low, high = values.agg(F.min("llr"), F.max("llr")).first()
    while low < high:
        part = F.width_bucket("llr", F.lit(low), F.lit(high), F.lit(CUTS))
        for _, n, low, high in values.filter(F.col("llr").between(low, high)).groupBy(part).agg(
                F.count("llr"), F.min("llr"), F.max("llr")).orderBy(F.min("llr")).collect():
            if k < n:
                break
            k -= n
    return low


def fitted_threshold(scores: DataFrame, rules: Rules) -> float:
    """``threshold`` over a table of any size, (trusted, llr), from the few rows that settle it."""
    sides = dict(scores.groupBy("trusted").count().collect())
    if True not in sides:
        return threshold(np.empty(0), np.empty(0), rules)
    low = nth(scores.filter("trusted"), int(rules.tail * sides[True]))
    bad = scores.filter("NOT trusted").agg(
        F.min("llr"), F.max(F.when(F.col("llr") < low, F.col("llr")))).first()
    return threshold(np.array([low]), np.array([x for x in bad if x is not None]), rules)


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Count both multinomials over all documents; only bucket sums reach the driver.

    Labels grow with the documents, so they are no broadcast: the texts that may have one are
    dealt by id, the others stay where they are.
    """
    texts, marked = bare(docs, doc_id=id_col, text=text_col), marks(labels)
    near, rest = split(texts, marked)
    dealt = near.join(marked.hint("merge"), "doc_id", "left")
    flagged = dealt.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).unionAll(
        rest.select("text", F.lit(False)))

    def count(batches):
        raw, good = (np.zeros(rules.buckets, np.int64) for _ in "rt")
        for batch in slices(batches, "text"):
            words = Words(batch.column(0))
            bucket, row = features(words, rules)
            chosen = batch.column(1).to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=rules.buckets)
            good += np.bincount(bucket[chosen[row]], minlength=rules.buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "good"])

    sums = flagged.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket") \
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = (np.zeros(rules.buckets) for _ in "rt")
    at = sums["bucket"].to_numpy(np.int64)
    raw[at], good[at] = sums["raw"], sums["good"]
    if not good.sum():
        return Model(np.zeros(rules.buckets), 0.0)
    a = rules.smoothing
    ratio = np.log((good + a) / (good.sum() + a * rules.buckets)) \
        - np.log((raw + a) / (raw.sum() + a * rules.buckets))
    # The flag takes the id's place, so that no join is needed after scoring.
    known = dealt.filter("bad IS NOT NULL").select((~F.col("bad")).cast("long").alias("trusted"),
                                                   "text")
    scores = staged(score(known, Model(ratio, -np.inf), rules, "trusted").filter(
        "NOT base_failed").select(F.col("doc_id").cast("boolean").alias("trusted"), "llr"),
        "quality-scores")
    found = fitted_threshold(scores, rules)
    drop_staged(scores)
    return Model(ratio, found)


def score(docs: DataFrame, model: Model, rules: Rules = Rules(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Base measures, ratio and verdict of every document, one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *measure(batch.column(1), shared.value, rules)],
                [c.split()[0] for c in MEASURES.split(", ")])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, MEASURES)


def keep(docs: DataFrame, model: Model, rules: Rules = Rules(), text_col: str = "text"
         ) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, text_col):
            text = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(measure(text, shared.value, rules)[-2])

    return docs.mapInArrow(run, docs.schema)


def features(words: Words, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram."""
    row = words.row_of_word()
    pair, inside = words.grams(2)
    mask = np.uint64(rules.buckets - 1)
    bucket = np.concatenate([words.hash & mask, (pair & mask)[inside]])
    return bucket.astype(np.int64), np.concatenate([row, row[:len(pair)][inside]])


def measure(column: pa.Array, model: Model, rules: Rules) -> list[pa.Array]:
    words = Words(column)
    data, bounds = words.buffer, words.offsets
    n_words = np.diff(words.first)
    chars = per_row(((data & 0xC0) != 0x80) & ~SPACES[data], bounds)
    symbols = per_row(SYMBOLS[data], bounds)
    again = repeat_words(words, rules.window)
    bucket, row = features(words, rules)
    grams = np.bincount(row, minlength=words.rows)
    llr = np.bincount(row, model.ratio[bucket], minlength=words.rows) / np.maximum(grams, 1)
    failed = (n_words < rules.min_words) | (100 * again > rules.repeat_percent * n_words)
    kept = ~failed & (llr >= model.threshold)
    return [pa.array(x) for x in (n_words, chars, symbols, duplicate_lines(column), again,
                                  failed, kept, llr)]


def duplicate_lines(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
            out[i] = len(lines) - len(set(lines))
    return out


def repeat_words(words: Words, window: int) -> np.ndarray:
    """Words inside windows that occur twice or more in their row."""
    gram, inside = words.grams(window)
    at = np.flatnonzero(inside)
    row = words.row_of_word()
    key, owner = gram[at], row[at]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return per_row(np.cumsum(edge[:-1]) > 0, words.first)
