"""Exact token counts of every prefix of a text, by dynamic programming over its pieces.

``count_texts`` gives totals; ``PrefixCounts`` answers, for one text, how many tokens any
prefix has and which is the longest prefix within a budget. Counts at the ends of pieces
(runs between lone spaces) are running sums, and inside a piece the counts at the ends of its
pre-tokens are, which one encoding of the piece shows. Inside a pre-token the count at every
character comes from a second recurrence over the merge table and the pre-token's bytes: the
encoding of a prefix ends in the one token ``t`` that is stable after the last token of the prefix
before it, so ``count[p] = count[p - len(t)] + 1``. Only short pre-tokens that are not basic
letters, prefixes that end inside a special string, and pre-tokens whose characters change each
other in normalisation (decomposed accents) are encoded prefix by prefix.

Defined results: null text counts as empty, 0 bytes and 0 tokens; null ids and repeated rows
pass through; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolesift.llm.common import bare, lengths, slices
from rolesift.llm.tokens import PieceCache, pieces, tokenizer

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_chars long"
VOCABULARY = "word_bpe_49k.json"
#: Characters up to which a pre-token's prefixes are simply encoded.
SHORT = 48


class WordCounter:
    """Token counts of pieces under a vocabulary that drops white space."""

    def __init__(self, name: str = VOCABULARY):
        self.library = tokenizer(name)
        self.cache = PieceCache(self._learn)
        self._table: MergeTable | None = None

    @property
    def table(self) -> "MergeTable":
        if self._table is None:
            self._table = MergeTable(self.library)
        return self._table

    def _learn(self, new: list[str]) -> zip:
        encoded = self.library.encode_batch_fast(new, add_special_tokens=False)
        return zip(new, map(len, encoded))

    def prefixes(self, texts: list[str | None]) -> list["PrefixCounts"]:
        cut = [pieces(t) if t else [] for t in texts]
        get = self.cache.fill(cut)
        return [PrefixCounts(self, parts, np.cumsum(
            np.fromiter(map(get, parts), np.int64, len(parts)))) for parts in cut]


class PrefixCounts:
    """Token counts of one text's prefixes: ``ends[i]`` tokens up to the end of piece i."""

    def __init__(self, counter: WordCounter, parts: list[str], ends: np.ndarray):
        self.counter, self.parts, self.ends = counter, parts, ends

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def _chars(self) -> np.ndarray:
        """Characters before each piece."""
        size = np.fromiter((len(p) + 1 for p in self.parts), np.int64, len(self.parts))
        return np.concatenate([[0], np.cumsum(size)])

    def at(self, chars: int) -> int:
        """Tokens of the prefix of that many characters."""
        if not self.parts or chars <= 0:
            return 0
        starts = self._chars()
        i = min(int(np.searchsorted(starts, chars, "right")) - 1, len(self.parts) - 1)
        inner = min(chars - int(starts[i]), len(self.parts[i]))
        before = int(self.ends[i - 1]) if i else 0
        return before + self.counter.table.inside(self.parts[i])[inner]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if self.total <= budget:
            return sum(map(len, self.parts)) + max(len(self.parts) - 1, 0)
        # Counts at piece and pre-token ends never fall, so only the pre-token that crosses the
        # budget matters; inside it they may fall again, so the last fitting prefix is taken.
        i = bisect_right(self.ends, budget)
        before = int(self.ends[i - 1]) if i else 0
        return int(self._chars()[i]) + self.counter.table.longest(self.parts[i], budget - before)


@dataclass(frozen=True)
class Unit:
    """Characters ``start`` to ``stop`` of a piece with the tokens before and after them;
    ``joined`` is the pre-token that a special string touches; a ``shared`` unit begins inside
    the last character of the one before it, which normalisation made two of."""

    start: int
    stop: int
    before: int
    after: int
    special: bool
    joined: "Unit | None"
    shared: bool


def byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class MergeTable:
    """Per-character prefix counts inside a piece, from the vocabulary's merge ranks."""

    def __init__(self, library):
        model = json.loads(library.to_str())["model"]
        self.library = library
        self.end = model["end_of_word_suffix"]
        self.vocabulary = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                  for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.longest_token = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        #: All endings of tokens; what is none of them ends no token, however far it is extended.
        self.tails = {t[k:] for t in self.vocabulary for k in range(len(t.removesuffix(self.end)))}
        self.special = {t.content for t in library.get_added_tokens_decoder().values()}
        self.sign = byte_signs()
        self.stable: dict[tuple[str, str], bool] = {}

    def units(self, piece: str) -> list["Unit"]:
        """Pre-tokens and special strings of a piece, in order."""
        found = self.library.encode(piece, add_special_tokens=False)
        out, begin, before = [], None, 0
        for n, (token, (a, b)) in enumerate(zip(found.tokens, found.offsets), 1):
            begin = a if begin is None else begin
            special = token in self.special
            if special or token.endswith(self.end):
                # Cut short, a special string is text and belongs to what touches it.
                joined = special and bool(out) and out[-1].stop == begin and not out[-1].special
                out.append(Unit(begin, b, before, n, special, out[-1] if joined else None,
                                bool(out) and begin < out[-1].stop))
                begin, before = None, n
        return out

    def inside(self, piece: str) -> list[int]:
        """Counts of the prefixes of 0, 1, … characters."""
        out = [0] * (len(piece) + 1)
        for unit in self.units(piece):
            counts = self.within(piece, unit)
            for k in range(unit.start + 1, len(piece) + 1):
                if k > unit.stop:
                    out[k:] = [unit.after] * (len(piece) + 1 - k)
                    break
                out[k] = counts[k - unit.start]
        return out

    def longest(self, piece: str, budget: int) -> int:
        """Characters of the piece's longest prefix with at most ``budget`` tokens."""
        units = self.units(piece)
        crossing = next((u for u in units if u.after > budget), None)
        if crossing is None:
            return len(piece)
        counts = self.within(piece, crossing, budget)
        fits = [k for k in range(1, len(counts)) if counts[k] <= budget]
        return crossing.start + (fits[-1] if fits else 0)

    def within(self, piece: str, unit: "Unit", budget: int | None = None) -> list[int]:
        """Counts of the piece's prefixes that end 0, 1, … characters into a unit. With ``budget``
        those that cannot be within it may be left out: a token has a bounded size."""
        if unit.special:
            first = unit.joined or unit
            head, before = first.start, first.before
            if first.shared:
                before -= self.units(piece[head])[0].after
            cut = [piece[head:k] for k in range(unit.start, unit.stop + 1)]
        else:
            text, before = piece[unit.start:unit.stop], unit.before
            if unit.shared:
                before -= self.units(text[0])[0].after
                word = ends = None
            elif re.fullmatch("[A-Za-z]+", text):
                word, ends = text.lower(), None
            else:
                word, ends = self.signs(text) if len(text) > SHORT else (None, None)
            if word is not None:
                most = len(word) if budget is None else max(budget - before, 0) * self.longest_token
                counts = self.letters(word[:most])
                return [before + counts[e] for e in (ends if ends is not None else
                                                     range(len(counts))) if e < len(counts)]
            cut = [text[:k] for k in range(len(text) + 1)]
        return [before + len(e) for e in self.library.encode_batch_fast(
            cut, add_special_tokens=False)]

    def signs(self, text: str) -> tuple[str | None, list[int] | None]:
        """The vocabulary's signs of a pre-token's bytes and how many its first 0, 1, …
        characters have; None where characters are not normalised one by one."""
        normal = self.library.normalizer.normalize_str
        each = {c: "".join(self.sign[b] for b in normal(c).encode()) for c in set(text)}
        word = "".join(map(each.__getitem__, text))
        if word != "".join(self.sign[b] for b in normal(text).encode()):
            return None, None
        return word, np.cumsum([0, *(len(each[c]) for c in text)]).tolist()

    def letters(self, word: str) -> list[int]:
        """``count[p]`` and ``last[p]`` for unfinished prefixes; a finished prefix is one whose
        last token carries the end-of-word mark."""
        count, last, out = [0], [""], [0]
        for p in range(1, len(word) + 1):
            for mark in ("", self.end):
                sizes, size = [], 1
                while size <= p and (tail := word[p - size:p] + mark) in self.tails:
                    if tail in self.vocabulary:
                        sizes.append(size)
                    size += 1
                for size in reversed(sizes):
                    token, before = word[p - size:p] + mark, last[p - size]
                    if self.alone(token) and (not before or self.adjacent(before, token)):
                        break
                else:
                    raise ValueError(f"no token ends prefix {p} of {word!r}")
                if mark:
                    out.append(count[p - size] + 1)
                else:
                    count.append(count[p - size] + 1)
                    last.append(token)
        return out

    def alone(self, token: str) -> bool:
        key = (token, "")
        if key not in self.stable:
            self.stable[key] = self.merge(self.symbols(token)) == [token]
        return self.stable[key]

    def adjacent(self, left: str, right: str) -> bool:
        """Whether both tokens stay as they are when their characters stand side by side."""
        key = (left, right)
        if key not in self.stable:
            self.stable[key] = self.merge(self.symbols(left) + self.symbols(right)) \
                == [left, right]
        return self.stable[key]

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            rank, i = min((self.rank.get(pair, len(self.rank)), i)
                          for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]
        return parts


_counters: dict[str, WordCounter] = {}


def counter(name: str) -> WordCounter:
    if name not in _counters:
        _counters[name] = WordCounter(name)
    return _counters[name]


def count_texts(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens, whether over ``limit``, and the characters that fit into ``limit``."""

    def run(batches):
        count = counter(vocabulary)
        for batch in slices(batches, "text", 1 << 20):
            found = count.prefixes(batch.column(1).to_pylist())
            totals = np.array([f.total for f in found], np.int64)
            fits = [f.longest(limit) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths(batch.column(1))), pa.array(totals),
                 pa.array(totals > limit), pa.array(fits, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_chars"])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, COUNTS)
