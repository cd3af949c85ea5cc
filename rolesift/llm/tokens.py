"""Token ids of whole texts with a word cache in front of the tokenizers library.

Both vocabularies used here split a text into pre-tokens before any merge, and a lone space
between two non-spaces always starts a new pre-token. A text may therefore be cut at such
spaces, each piece encoded once by the library, and the results joined: the ids are those of
the whole text. Pieces repeat, so a bounded cache per Python worker saves most of the work.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ALONE = re.compile(r"(?<=\S) (?=\S)")
#: Other white space that could stand beside a space.
EXOTIC = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What may close a word: a run of these after a letter or digit is one pre-token.
CLOSING = ".,;:!?#*$%&"
#: Pieces in each of the two generations of a cache.
CACHE_ENTRIES = 600_000

_loaded: dict[str, "object"] = {}


def tokenizer(name: str):
    """The library's tokenizer of a public vocabulary file, one per Python worker."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import public_tokenizers
        from tokenizers import Tokenizer
        path = name if os.path.sep in name else public_tokenizers.path(name)
        _loaded[name] = Tokenizer.from_file(path)
    return _loaded[name]


def spaced(text: str, lines: bool = False) -> str | None:
    """The text if every space in it is a lone one, so that its pieces are what stands between
    spaces; with ``lines`` a space stands before lone line feeds too. None for other texts."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text \
            or "\n " in text or any(c in text for c in EXOTIC):
        return None
    if lines and "\n" in text and "\n\n" not in text and text[0] != "\n" != text[-1]:
        text = text.replace("\n", " \n")
    return text


def pieces(text: str, lines: bool = False) -> list[str]:
    """The text cut at every lone space; the spaces themselves are left out. With ``lines`` it
    is also cut before lone line feeds, which stay at the head of their pieces."""
    even = spaced(text, lines)
    return ALONE.split(text) if even is None else even.split(" ")


class PieceCache:
    """Results by piece. What the newer generation lacks is first looked for in the older one;
    when the newer is full it becomes the older, so pieces in steady use stay."""

    def __init__(self, learn):
        self.learn, self.now, self.older = learn, {}, {}

    def fill(self, cut: list[list[str]]):
        """The getter of a table that has every piece of ``cut``."""
        if len(self.now) > CACHE_ENTRIES:
            self.now, self.older = {}, self.now
        now, older = self.now, self.older
        new = set().union(*cut).difference(now)
        if older:
            again = [p for p in new if p in older]
            now.update((p, older[p]) for p in again)
            new.difference_update(again)
        if new:
            now.update(self.learn(list(new)))
        return now.__getitem__


class SpacedIds:
    """Ids under a byte-level vocabulary in which a space belongs to the word after it."""

    def __init__(self, name: str):
        self.library = tokenizer(name)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith(("Ġ", "Ċ"))
        self.cache, self.closing = PieceCache(self._learn), {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty.

        Pieces become codes of a dictionary: each distinct one is looked up once in a call, and
        the ids are gathered by code.
        """
        heads, tails, loose, counts = [], [], [], []
        for text in texts:
            even = spaced(text, lines=True) if text else ""
            if even is None:
                head, *rest = ALONE.split(text)
                loose += rest
                counts.append(len(rest))
                tails.append(None)
            else:
                head, gap, tail = even.partition(" ")
                counts.append(0)
                tails.append(tail if gap else None)
            heads.append(head)
        split = pc.split_pattern(pa.array(tails, pa.string()), " ")
        codes = pa.concat_arrays([split.flatten(), pa.array(loose, pa.string())]) \
            .dictionary_encode()
        known = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.fill([known]), known))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = codes.indices.to_numpy()
        n = size[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        first = np.cumsum(size) - size
        where = np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[where].tobytes()
        even = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        odd = np.array(counts, np.int64)
        # Even texts come first among the codes, then the others.
        stop = np.where(odd > 0, int(even.sum()) + np.cumsum(odd), np.cumsum(even))
        begin = (4 * ends[stop - even - odd]).tolist()
        library = iter(self.library.encode_batch_fast([h for h, t in zip(heads, texts) if t],
                                                      add_special_tokens=False))
        return [as_bytes(next(library).ids) + ids[a:b] if text else b""
                for text, a, b in zip(texts, begin, (4 * ends[stop]).tolist())]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of unseen pieces. What closes a word is a pre-token of its own, so the word is
        encoded without it, once for all that may follow."""
        words = {p: p.rstrip(CLOSING) for p in new if p[-1] in CLOSING}
        words = {p: w for p, w in words.items() if w and w[-1] < "\u0250" and w[-1].isalnum()}
        now, older = self.cache.now, self.cache.older
        lacking = {w for w in words.values() if w not in now}
        out = {w: older[w] for w in lacking if w in older}
        out.update(self._encode_all([*{*new, *lacking}.difference(words, out)]))
        closing = {p[len(w):] for p, w in words.items()}.difference(self.closing)
        if closing:
            self.closing.update(zip(closing, (as_bytes(e.ids) for e in self.library
                                              .encode_batch_fast([*closing],
                                                                 add_special_tokens=False))))
        for p, w in words.items():
            end, ids = p[len(w):], out.get(w)
            out[p] = (now[w] if ids is None else ids) + self.closing[end]
        if len(self.closing) > CACHE_ENTRIES:
            self.closing.clear()
        return out

    def _encode_all(self, new: list[str], run: int = 512) -> dict[str, bytes]:
        """Ids of pieces by the library; a piece follows a space unless it starts with a line feed.
        Pieces without inner white space or special strings are encoded many at a time: a token
        that starts with a space or line feed then always starts a piece."""
        out: dict[str, bytes] = {}
        lines = [p for p in new if p[0] == "\n"]
        words = [p for p in new if p[0] != "\n"] if lines else new
        for family, lead in ((words, " "), (lines, "")):
            groups = [family[i:i + run] for i in range(0, len(family), run)]
            joined = [lead + lead.join(g) for g in groups]
            for group, text, e in zip(groups, joined, self.library.encode_batch_fast(
                    joined, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = (4 * np.flatnonzero(self.starts[ids])).tolist()
                if text.count(" ") + text.count("\n") > len(group) or "<|" in text:
                    out.update(zip(group, (as_bytes(x.ids) for x in self.library.encode_batch_fast(
                        [lead + p for p in group], add_special_tokens=False))))
                elif len(at) != len(group):
                    raise ValueError("vocabulary does not keep a space with the word after it")
                else:
                    out.update(zip(group, map(ids.tobytes().__getitem__,
                                              map(slice, at, [*at[1:], 4 * len(ids)]))))
        return out


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[str, SpacedIds] = {}


def spaced_ids(name: str) -> SpacedIds:
    if name not in _encoders:
        _encoders[name] = SpacedIds(name)
    return _encoders[name]
