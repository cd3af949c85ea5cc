"""Alignment of two tokenizers' tokens over the same bytes, and how often id pairs are linked.

``align`` encodes every text with a byte-level vocabulary (A, a space before the text) and a
space-sign vocabulary (B, which adds that space itself). Both token lists are lists of ascending
end offsets; the shorter one drives exponential and binary search into the longer. The offsets
found in both cut the lists into groups; differences of their ranks say which tokens of A and B
overlap, and the last tokens of a group, which end together, are linked. ``link_counts`` adds
up the links of each id pair over the whole corpus and ``link_statistics`` gives them back to the
documents.

A space between two non-spaces starts a token under both vocabularies, as does a lone line feed,
so texts are cut there and the alignment of a piece is kept in a bounded cache.

Id pairs with a 10,000th of all links or more are 10,000 at most and are broadcast; no key of the
remaining join is therefore hot.

Defined results: null and empty texts, and texts whose tokens do not give back their bytes (a
space sign inside the text), have no tokens and zeros; null ids and repeated rows stay rows of
their own; ties of the highest count all count as best; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import bare, slices, staged
from rolesift.llm.piece_codec import SPACE, library
from rolesift.llm.tokens import PieceCache, SpacedIds, pieces

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, groups string, "
           "pairs array<long>, times array<int>")
#: An id pair is one number: the id of A above this many bits, the id of B in them.
B_BITS = 24
#: Pairs with at least one in this many links are broadcast; there are no more of them than this.
HOT_SHARE = 10_000
#: Pieces in each of the two generations of the cache.
CACHE_ENTRIES = 250_000


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of the values that two ascending lists share, by galloping search."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    out, low, n = [], 0, len(b)
    for i, x in enumerate(a):
        step = 1
        while low + step < n and b[low + step] < x:
            step *= 2
        low = bisect_left(b, x, low + step // 2 if step > 1 else low, min(low + step + 1, n))
        if low == n:
            break
        if b[low] == x:
            out.append((i, low))
    return out


def overlaps(shared: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Token ranges of A and B that cover the same bytes, from the ranks of shared ends."""
    out, a, b = [], 0, 0
    for i, j in shared:
        out.append((a, i + 1, b, j + 1))
        a, b = i + 1, j + 1
    return out


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class PlainIds(SpacedIds):
    """Ids under the byte-level vocabulary with special strings as plain text."""

    def __init__(self, name: str):
        super().__init__(name)
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(self.library.to_str())
        self.library.encode_special_tokens = True
        sign = byte_signs()
        self.bytes = {i: bytes(map(sign.__getitem__, t))
                      for t, i in self.library.get_vocab(with_added_tokens=False).items()
                      if sign.keys() >= set(t)}

    def one(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class PieceCacheOfPairs(PieceCache):
    """The piece cache with fewer entries, since these are larger."""

    def fill(self, cut):
        if len(self.now) > CACHE_ENTRIES:
            self.now, self.older = {}, self.now
        return super().fill(cut)


class Aligner:
    """Alignments of pieces: groups as text, tokens of A and B, linked pairs; None where the
    tokens do not give back the bytes."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        self.a, self.b = PlainIds(byte_vocabulary), library(piece_vocabulary)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            token = self.b.id_to_piece(i)
            if "\n" in token or SPACE in token.lstrip(SPACE):
                raise ValueError("a token holds a line feed or a space that does not start it")
            self.b_bytes.append(bytes([int(token[3:5], 16)]) if self.b.is_byte(i)
                                else token.replace(SPACE, " ").encode())
        self.cache = PieceCacheOfPairs(self._learn)

    def _learn(self, new: list[str]) -> dict[str, tuple | None]:
        """Pieces follow a space unless they start with a line feed."""
        a = self.a._learn(new)
        b = self.b.encode(new, num_threads=1)
        out = {}
        for piece, b_ids in zip(new, b):
            text = piece
            if piece[0] == "\n":
                b_ids = b_ids[1:]           # the added space, which stands alone before it
            else:
                text = " " + piece
            out[piece] = self.align(text, np.frombuffer(a[piece], "<u4").tolist(), b_ids)
        return out

    def align(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        a_bytes, b_bytes = [self.a.bytes[i] for i in a], [self.b_bytes[i] for i in b]
        own = text.encode()
        if b"".join(a_bytes) != own or b"".join(b_bytes) != own:
            return None
        shared = common_ends(list(accumulate(map(len, a_bytes))),
                             list(accumulate(map(len, b_bytes))))
        groups = ";".join(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}"
                          for i, k, j, m in overlaps(shared))
        links = np.array([a[i] << B_BITS | b[j] for i, j in shared], "<i8")
        return groups, len(a), len(b), len(shared), links.tobytes()

    def align_all(self, texts: list[str | None]) -> list[list[tuple | None]]:
        """The aligned pieces of each text; a text that starts with a line feed has a space
        before it all the same."""
        cut = [pieces(t, lines=True) if t else [] for t in texts]
        heads = {k: parts[0] for k, parts in enumerate(cut) if parts and parts[0][0] == "\n"}
        get = self.cache.fill([parts[1:] if k in heads else parts for k, parts in enumerate(cut)])
        return [[self.align(" " + heads[k], self.a.one(" " + heads[k]),
                            self.b.encode(heads[k])), *map(get, parts[1:])]
                if k in heads else list(map(get, parts)) for k, parts in enumerate(cut)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(*names: str) -> Aligner:
    if names not in _aligners:
        _aligners[names] = Aligner(*names)
    return _aligners[names]


def align(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY,
          piece_vocabulary: str = PIECE_VOCABULARY, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Groups of every text as ``a1,a2|b1;a3|b2,b3``, and its linked id pairs with how often."""

    def run(batches):
        work = aligner(byte_vocabulary, piece_vocabulary)
        for batch in slices(batches, "text", 1 << 20):
            found = [[] if None in parts else parts
                     for parts in work.align_all(batch.column(1).to_pylist())]
            groups = [";".join([p[0] for p in parts]) for parts in found]
            sums = [np.array([sum([p[k] for p in parts]) for parts in found], np.int64)
                    for k in (1, 2, 3)]
            links = np.frombuffer(b"".join([p[4] for parts in found for p in parts]), "<i8")
            row = np.repeat(np.arange(len(found)), sums[2])
            order = np.lexsort((links, row))
            links, row = links[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (links[1:] != links[:-1])
                                                   | (row[1:] != row[:-1])])[:len(links)])
            times = np.diff(np.concatenate([first, [len(links)]])).astype(np.int32)
            bounds = pa.array(np.searchsorted(row[first], np.arange(len(found) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, sums), pa.array(groups, pa.string()),
                 pa.ListArray.from_arrays(bounds, pa.array(links[first])),
                 pa.ListArray.from_arrays(bounds, pa.array(times))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, ALIGNED)


def _links(aligned: DataFrame, *keep: str) -> DataFrame:
    return aligned.select(*keep, F.inline(F.arrays_zip(F.col("pairs").alias("pair"),
                                                       F.col("times").alias("n"))))


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, how often it is linked in the corpus, and whether no pair of its B id is more
    often. The highest counts are one row per id of B and are broadcast."""
    counts = staged(_links(aligned).groupBy("pair").agg(F.sum("n").alias("count")), "link-counts")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))
    return counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def link_statistics(docs: DataFrame, **options) -> DataFrame:
    """Per document: tokens, groups, links, links of a best pair, and the counts of all links
    added up. ``options`` are those of ``align``."""
    aligned = staged(align(docs, **options).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
        "pairs", "times"), "aligned")
    counts = staged(link_counts(aligned), "pair-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.filter(F.col("count") * HOT_SHARE >= total)
    links, measured = _links(aligned, "row"), []
    rare = counts.filter(F.col("count") * HOT_SHARE < total)
    for part in (links.join(F.broadcast(hot), "pair"),
                 links.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
                      .join(rare, "pair")):
        measured.append(part.groupBy("row").agg(
            F.sum("n").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum")))
    sums = measured[0].unionByName(measured[1]).groupBy("row").agg(
        *[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *zeros, "groups_sha256")
