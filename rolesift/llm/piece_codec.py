"""SentencePiece encoding by backtracking over merge-type vocabularies, and decoding.

A merge vocabulary joins the best-scored neighbours until none are left. The result is the one
sequence of tokens that (a) each come out whole when their own characters are merged and (b) are
adjacent-compatible: merging the characters of both leaves both as they are. An automaton over
the tokens gives the longest match at every character; from left to right the longest compatible
token is taken, then its next shorter prefix, and where none fits the position is marked as
failed and the last token is taken back. No position fails twice, so the work is linear in the
text, also for a text without any space. Characters outside the vocabulary stand for themselves
and become byte tokens.

A space sign stands only at the head of tokens, and line feeds in none, so texts are cut at both
and the ids of a piece are kept in a bounded cache; the vocabulary is checked for this, else the
text is one piece.

Defined results: null and empty texts have no tokens but the end id and decode to the empty
text; null ids, ties and repeated rows pass through row by row; empty tables give no rows; other
columns are not read. Vocabularies with unused pieces or without byte tokens are refused.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rolesift.llm.common import bare, slices
from rolesift.llm.tokens import PieceCache, as_bytes

VOCABULARY = "piece_bpe_32k.model"
CODED = "doc_id long, ids array<int>, decoded string"
SPACE = "▁"
#: In no token, so no match spans it.
BETWEEN = "\0"
CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
#: Pairs whose compatibility is remembered.
PAIR_ENTRIES = 2_000_000

_libraries: dict[str, "object"] = {}


def library(name: str):
    """The library's processor of a public vocabulary file, one per Python worker."""
    if name not in _libraries:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        path = name if os.path.sep in name else public_tokenizers.path(name)
        _libraries[name] = SentencePieceProcessor(model_file=path)
    return _libraries[name]


class MergeCodes:
    """Tokens of one vocabulary, which neighbours stay apart, and the backtracking search."""

    def __init__(self, name: str = VOCABULARY):
        import ahocorasick
        sp = library(name)
        ids = range(sp.get_piece_size())
        if any(map(sp.is_unused, ids)) or not any(map(sp.is_byte, ids)):
            raise ValueError("vocabularies need byte tokens and no unused ones")
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.whole = {t for t in self.id if len(t) == 1 or self.merge(list(t)) == [t]}
        self.shorter = {t: next((t[:k] for k in range(len(t) - 1, 0, -1)
                                 if k == 1 or t[:k] in self.whole), None) for t in self.whole}
        self.cuttable = not any(SPACE in t.lstrip(SPACE) or "\n" in t and len(t) > 1
                                for t in self.id)
        if max(map(len, self.whole)) > 255 or any(BETWEEN in t for t in self.id):
            raise ValueError("tokens are too long or hold a zero character")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t in self.whole:
            self.automaton.add_word(t, len(t))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """Join the best-scored neighbours, the leftmost of equals, until none are left."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both leaves both as they are."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            found = self.pairs[key] = self.merge([*left, *right]) == [left, right]
        return found

    def longest(self, text: str) -> bytearray:
        """Characters of the longest token that starts at each character, 0 for none."""
        out = bytearray(len(text))
        for end, size in self.automaton.iter(text):
            out[end - size + 1] = size       # ends ascend, so longer ones come last
        return out

    def tokens(self, text: str, longest: bytearray) -> list[str]:
        n, at, out = len(text), 0, []
        failed = bytearray(n + 1)
        shorter, apart, pairs = self.shorter, self.apart, self.pairs
        token = text[:longest[0] or 1] if n else None
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(token)
                if not failed[end]:
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits if fits is not None else apart(last, token):
                        break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at = end
                if at < n:
                    token = text[at:at + (longest[at] or 1)]
            else:
                failed[at] = 1
                if last is None:
                    raise ValueError(f"no tokens for {text[:40]!r}")
                token = out.pop()
                at -= len(token)
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        get, out = self.id.get, []
        for t in tokens:
            i = get(t)
            if i is None:
                out.extend(self.byte[b] for b in t.encode())
            else:
                out.append(i)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of escaped texts; one pass of the automaton serves them all."""
        found = self.longest(BETWEEN.join(texts))
        out, begin = [], 0
        for text in texts:
            out.append(self.ids(self.tokens(text, found[begin:begin + len(text)])))
            begin += len(text) + 1
        return out


class PieceIds:
    """Ids of whole texts; a piece has a space sign before it unless it starts a line."""

    def __init__(self, name: str = VOCABULARY):
        self.codes = MergeCodes(name)
        self.cache = PieceCache(self._learn)

    def _learn(self, new: list[str]) -> zip:
        if not self.codes.cuttable:
            return zip(new, map(as_bytes, self.codes.encode_all(new)))
        return zip(new, map(as_bytes, self.codes.encode_all(
            [p if p.startswith("\n") else SPACE + p for p in new])))

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.codes.cuttable:
            return [SPACE + text.replace(" ", SPACE)]
        if SPACE in text or "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return [c if c[0] == "\n" else c[1:]
                    for c in CHUNKS.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        cut = [self.pieces(t) for t in texts]
        get = self.cache.fill(cut)
        return [b"".join(map(get, parts)) for parts in cut]


_encoders: dict[str, PieceIds] = {}


def piece_ids(name: str) -> PieceIds:
    if name not in _encoders:
        _encoders[name] = PieceIds(name)
    return _encoders[name]


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``ids`` of every text with the end id last, and the text they decode to."""

    def run(batches):
        codec, sp = piece_ids(vocabulary), library(vocabulary)
        end = as_bytes([sp.eos_id()])
        for batch in slices(batches, "text", 1 << 20):
            coded = [ids + end for ids in codec.encode(batch.column(1).to_pylist())]
            ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
            bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
            decoded = [sp.decode(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids),
                 pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return bare(docs, doc_id=id_col, text=text_col).mapInArrow(run, CODED)
