"""Removal of repeated passages of lines: content-defined chunks and windows of enough words.

A document's lines are hashed; a rolling hash over the last ``window`` line hashes ends a chunk
where it is 0 modulo ``divisor``. A boundary depends on those lines alone, so inserting or
removing lines elsewhere does not move it. Chunks of two lines and more count. Besides, from each
line with a word on and back from it, the shortest run of lines with ``least_words`` words is a
chunk, a single line included. Any passage of whole lines with so many words is the union of such
windows, from its first word to its last, so it goes whole wherever it repeats, however the lines
around it move the boundaries.

Chunks that occur again anywhere in the corpus are candidates; candidates are grouped by the
SHA-256 digest of their bytes, and in each group all but the first occurrence (smallest id, then
earliest line) are removed. Each line removed equals an earlier one, so one copy always stays.

A document is known by its id and a hash of its text, so rows without an id or with a shared
one keep their own spans, whatever other rows lose.

Only built-in functions are used. Hashes and counts are shuffled first, then positions and
digests of chunks; text moves once, for the documents that are rewritten. Partial aggregates
collapse a chunk that a third of all documents share; joins on its hash are split at run time.

Defined results: null text stays null, empty text stays empty; a text whose lines all go becomes
empty; rows with the same id and the same text count as one document and stay alike; null ids sort
after all others; an empty table stays empty. Chunks without a word are left alone. Result columns
are those of the input, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import bare, staged


@dataclass(frozen=True)
class Rule:
    window: int = 2
    divisor: int = 3
    least_lines: int = 2
    #: Words of a window; a chunk of ``least_lines`` lines may have fewer.
    least_words: int = 50


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def reach(counts: str, least: int) -> Column:
    """For each line, how many from it on are the fewest with ``least`` words; 0 if all have less.

    ``counts`` names an array of positive word counts, so ``least`` lines always do.
    """
    pair = 1 << 32

    def walk(i: Column, most: int) -> Column:
        return F.aggregate(
            F.slice(counts, i + 1, most), F.lit(0).cast("long"),
            lambda total, n: F.when(total % pair < least, total + pair + n).otherwise(total),
            lambda total: F.when(total % pair >= least, F.floor(total / pair).cast("int"))
            .otherwise(0))

    def found(n: Column, i: Column) -> Column:
        near = walk(i, 4)
        return F.when(n >= least, 1).when(near > 0, near).otherwise(walk(i, least))

    return F.transform(counts, found)


def chunks(docs: DataFrame, rule: Rule = Rule(), form: Callable[[Column], Column] = lambda x: x
           ) -> DataFrame:
    """(doc_id, start, size, chunk) of every chunk of documents (doc_id, text)."""
    hashed = docs.filter("text IS NOT NULL").select("doc_id", lines(F.col("text")).alias("lines"))
    hashed = hashed.withColumns({
        "codes": F.transform("lines", lambda x: F.xxhash64(x)),
        "words": F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+")))})
    hashed = hashed.withColumn("held", F.filter(
        F.transform("words", lambda n, i: F.struct(i.alias("at"), n.alias("n"))),
        lambda h: h["n"] > 0))
    hashed = hashed.withColumns({"at": F.col("held.at"), "n": F.col("held.n"),
                                 "back_n": F.reverse("held.n")})

    def ends(code: Column, i: Column) -> Column:
        first = F.greatest(i - rule.window + 1, F.lit(0))
        rolled = F.xxhash64(F.slice("codes", first + 1, i - first + 1))
        return (F.pmod(rolled, F.lit(rule.divisor)) == 0) | (i == F.size("codes") - 1)

    marks = F.filter(F.transform("codes", lambda c, i: F.when(ends(c, i), i + 1)),
                     lambda e: e.isNotNull())
    hashed = hashed.withColumns({"ends": marks, "ahead": reach("n", rule.least_words),
                                 "back": F.reverse(reach("back_n", rule.least_words))})
    cut = F.filter(
        F.arrays_zip(
            F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)).alias("start"),
            F.col("ends").alias("stop")),
        lambda s: (s["stop"] - s["start"] >= rule.least_lines) & F.exists(
            F.slice("words", s["start"] + 1, s["stop"] - s["start"]), lambda n: n > 0))
    after = F.transform("ahead", lambda k, i: F.when(k > 0, number(
        F.get("at", i), F.get("at", i + k - 1) + 1)))
    before = F.transform("back", lambda k, i: F.when(k > 0, number(
        F.get("at", i - k + 1), F.get("at", i) + 1)))
    spans = F.array_distinct(F.array_compact(F.concat(
        F.transform(cut, lambda s: number(s["start"], s["stop"])), after, before)))
    # Texts are cut before the rows are, so no row repeats the whole document.
    parts = F.transform(F.transform(spans, lambda x: F.struct(
        F.shiftright(x, 32).cast("int").alias("start"),
        x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("stop"))), lambda s: F.struct(
            s["start"].alias("start"), (s["stop"] - s["start"]).alias("size"),
            form(F.array_join(F.slice("lines", s["start"] + 1, s["stop"] - s["start"]), "\n"))
            .alias("chunk")))
    return hashed.select("doc_id", F.inline(parts))


def number(start: Column, stop: Column) -> Column:
    """A span as one number, so that equal spans are found by hashing."""
    return F.shiftleft(start.cast("long"), 32) + stop


def document_key(doc_id: Column, text: Column) -> Column:
    """Order and identity of a document: ids ascending, null last, then the text's hash."""
    doc_id = doc_id.cast("long")
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"),
                    F.xxhash64(text).alias("hash"))


def repeats(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, start, size) of every chunk to remove; ``doc_id`` may be any key that sorts."""
    found = chunks(docs, rule, lambda x: F.unhex(F.sha2(x, 256))).withColumn(
        "code", F.xxhash64("chunk"))
    often = found.groupBy("code").count().filter("count > 1").select("code")
    candidates = staged(found.join(often, "code"), "chunk-candidates")
    # The digest decides; the code only spreads the groups.
    firsts = candidates.groupBy("code", "chunk").agg(
        F.min(F.struct("doc_id", "start")).alias("kept"))
    return candidates.join(firsts, ["code", "chunk"]).filter(
        F.struct("doc_id", "start") != F.col("kept")).select("doc_id", "start", "size").distinct()


def remove(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text"
           ) -> DataFrame:
    """The documents without repeated chunks; same columns, same rows."""
    narrow = bare(docs, doc_id=id_col, text=text_col).withColumn(
        "doc_id", document_key(F.col("doc_id"), F.col("text")))
    # Chunks of one document: bounded by its lines.
    gone = repeats(narrow, rule).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "size")).alias("spans")).select(
            F.struct("doc_id", "spans").alias("_gone"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row").getField(text_col)
    key = document_key(F.col("_row").getField(id_col), text)

    def rest(of: Column) -> Column:
        numbers = F.array_except(
            F.sequence(F.lit(1), F.size(of)),
            F.flatten(F.transform("_gone.spans", lambda s: F.sequence(
                s["start"] + 1, s["start"] + s["size"]))))
        return F.array_join(F.transform(numbers, lambda i: F.element_at(of, i)), "\n")

    # The outer transform binds the split text once.
    kept = F.transform(F.array(lines(text)), rest)[0]
    joined = row.join(gone, key == F.col("_gone.doc_id"), "left").select(
        "_row", F.when(F.col("_gone").isNull() | text.isNull(), text).otherwise(kept)
        .alias("_text"))
    return joined.select(*[
        (F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c)
        for c in docs.columns])
