"""Phrase and pattern matching as Column expressions.

Three ways to ask about phrases, by size:

* a short list against a short text is an OR of ``contains``;
* a long list is one regular expression that shares common beginnings, so a text is read
  once instead of once per phrase;
* many lists against the same text are answered together: ``find_phrases`` reads the text
  once and returns every phrase in it, and ``Found`` answers the lists from that array.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"
INLINE_LIMIT = 24


def strip(c: Column) -> Column:
    """Trim spaces, tabs and line breaks on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def filled(c: Column) -> Column:
    """Stripped value, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def build_text(*cols: Column, keep_empty: bool = False) -> Column:
    """Lower-cased, space-joined text of the given columns.

    ``keep_empty`` keeps the separator of a missing part; otherwise missing and empty
    parts are left out.
    """
    parts = [text_or_empty(c) if keep_empty else F.nullif(c, F.lit("")) for c in cols]
    return F.lower(F.concat_ws(" ", *parts))


def computed_once(c: Column) -> Column:
    """The value as a generated row of one.

    A filter on a projected column is pushed below the projection and repeats its
    expression there; it is not pushed below a generator. Worth it for whole-payload
    parsing and similar work that filters look at.
    """
    return F.explode(F.array(c))


def literals(phrases: Iterable[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases])


def _balanced_or(terms: Sequence[Column]) -> Column:
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return _balanced_or(terms[:half]) | _balanced_or(terms[half:])


@dataclass(frozen=True)
class Found:
    """Phrases already found in a text; stands in for the text in ``any_of`` and friends."""

    column: Column


def shared_pattern(phrases: Iterable[str]) -> str:
    """Regular expression for the longest phrase at a position.

    Common beginnings are written once, and first letters are grouped behind a look-ahead
    so that most positions are rejected after a few comparisons.
    """
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def tails(node: dict) -> list[str]:
        return [re.escape(ch) + rest(child) for ch, child in sorted(node.items()) if ch]

    def rest(node: dict) -> str:
        options = tails(node)
        if not options:
            return ""
        joined = options[0] if len(options) == 1 and "" not in node \
            else "(?:" + "|".join(options) + ")"
        return joined + ("?" if "" in node else "")

    firsts = sorted(tree)
    groups = [firsts[i:i + 6] for i in range(0, len(firsts), 6)]
    parts = ["(?=[" + "".join(re.escape(ch) for ch in g) + "])(?:"
             + "|".join(tails({ch: tree[ch] for ch in g})) + ")" for g in groups]
    return "(?:" + "|".join(parts) + ")"


def find_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """All distinct phrases contained in the text, from one pass over it.

    A look-ahead visits every position and yields the longest phrase starting there;
    shorter phrases that begin a longer one are added from a lookup.
    """
    known = sorted({p for p in phrases if p})
    if not known:
        return F.array().cast("array<string>")
    longest = F.array_distinct(F.regexp_extract_all(
        text, F.lit("(?=(" + shared_pattern(known) + "))"), 1))
    shorter = {p: [q for q in known if p.startswith(q)] for p in known}
    pairs = [x for p, qs in shorter.items() if len(qs) > 1 for x in (F.lit(p), literals(qs))]
    if pairs:
        lookup = F.create_map(*pairs)
        longest = F.array_distinct(F.flatten(F.transform(
            longest, lambda p: F.coalesce(F.try_element_at(lookup, p), F.array(p)))))
    return F.coalesce(longest, F.array().cast("array<string>"))


def distinct_phrases(phrases: Sequence[str]) -> list[str]:
    """Each phrase once, in order. An empty phrase would be in every text and is refused."""
    if "" in phrases:
        raise ValueError("an empty phrase matches every text")
    return list(dict.fromkeys(phrases))


def any_of(text: Column | Found, phrases: Sequence[str]) -> Column:
    """True when any phrase is a substring; NULL text counts as no match."""
    phrases = distinct_phrases(phrases)
    if not phrases:
        return F.lit(False)
    if isinstance(text, Found):
        return F.exists(text.column, lambda p: p.isin(phrases))
    if len(phrases) <= INLINE_LIMIT:
        found = _balanced_or([F.contains(text, F.lit(p)) for p in phrases])
    else:
        found = F.rlike(text, F.lit(shared_pattern(phrases)))
    return F.coalesce(found, F.lit(False))


def count_of(text: Column | Found, phrases: Sequence[str]) -> Column:
    """Number of distinct phrases present, each counted once."""
    phrases = distinct_phrases(phrases)
    if not phrases:
        return F.lit(0)
    if not isinstance(text, Found) and len(phrases) <= INLINE_LIMIT:
        hits = [F.contains(text, F.lit(p)).cast("int") for p in phrases]
        return F.coalesce(reduce(lambda a, b: a + b, hits), F.lit(0))
    found = text if isinstance(text, Found) else Found(find_phrases(text, phrases))
    return F.size(F.filter(found.column, lambda p: p.isin(phrases)))


def which_of(text: Column | Found, buckets: Mapping[str, Sequence[str]]) -> Column:
    """Names of all buckets with a hit, in configuration order."""
    return present({name: any_of(text, phrases) for name, phrases in buckets.items()})


def present(flags: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    if not flags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def first_of(text: Column | Found, buckets: Mapping[str, Sequence[str]]) -> Column:
    """Name of the first bucket with a hit, NULL when none."""
    return F.coalesce(*[F.when(any_of(text, ps), F.lit(n)) for n, ps in buckets.items()],
                      F.lit(None).cast("string"))


def first_value(text: Column | Found, steps: Sequence[tuple[Sequence[str], float]],
                default: float) -> Column:
    """Value of the first step whose phrases hit, else ``default``."""
    return F.coalesce(*[F.when(any_of(text, ps), F.lit(float(v))) for ps, v in steps],
                      F.lit(float(default)))


def first_phrase(text: Column | Found, phrases: Sequence[str]) -> Column:
    """First phrase of the list found in the text, NULL when none."""
    phrases = distinct_phrases(phrases)
    if not phrases:
        return F.lit(None).cast("string")
    if isinstance(text, Found):
        return F.get(F.filter(literals(phrases),
                              lambda p: F.array_contains(text.column, p)), 0)
    if len(phrases) <= INLINE_LIMIT:
        return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases],
                          F.lit(None).cast("string"))
    return F.get(F.filter(literals(phrases), lambda p: F.contains(text, p)), 0)


def any_pattern(text: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """True when any regular expression matches. ``.`` stops only at line feeds."""
    if not patterns:
        return F.lit(False)
    flags = "(?id)" if ignore_case else "(?d)"
    edge = r"\b"
    if all(p.startswith(edge) for p in patterns):  # test the word edge once per position
        joined = edge + "(?:" + "|".join(f"(?:{p[len(edge):]})" for p in patterns) + ")"
    else:
        joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(F.rlike(text, F.lit(flags + joined)), F.lit(False))


def first_pattern(text: Column, groups: Mapping[str, Sequence[str]], default: str) -> Column:
    """Name of the first pattern group that matches."""
    return F.coalesce(
        *[F.when(any_pattern(text, ps), F.lit(n)) for n, ps in groups.items()], F.lit(default))


def longest_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """Word-bounded phrase at the leftmost hit, longest preferred; '' when none."""
    cleaned = list(dict.fromkeys(p.strip() for p in phrases if len(p.strip()) > 1))
    if not cleaned:
        return F.lit("")
    pattern = r"\b" + shared_pattern(cleaned) + r"\b"
    return F.coalesce(F.regexp_extract(text, pattern, 0), F.lit(""))


def longest_phrase_ngrams(text: Column, phrases: Sequence[str]) -> Column:
    """Same question as ``longest_phrase`` answered by hash lookups of word n-grams.

    Suits dictionaries of many thousand phrases made of words and single spaces: the
    cost per title does not depend on the dictionary size. Phrases with punctuation
    belong in ``longest_phrase``.
    """
    cleaned = list(dict.fromkeys(p.strip() for p in phrases if len(p.strip()) > 1))
    longest = max((len(p.split(" ")) for p in cleaned), default=1)
    words = F.regexp_extract_all(text, F.lit(r"\w+"), 0)

    def best_at(i: Column) -> Column:
        grams = [F.array_join(F.slice(words, i, n), " ") for n in range(longest, 0, -1)]
        return F.coalesce(*[F.when(g.isin(cleaned), g) for g in grams])

    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words)))
    hits = F.filter(F.transform(starts, best_at), lambda g: g.isNotNull())
    return F.coalesce(F.get(hits, 0), F.lit(""))


def is_diluted(text: Column, phrase: Column, prefixes: Sequence[str]) -> Column:
    """The phrase occurs past the start and a diluting prefix comes before it."""
    at = F.call_function("locate", phrase, text)
    head = F.substring(text, F.lit(1), at - 1)
    return (at > 1) & F.exists(literals(prefixes), lambda d: F.contains(head, d))


def percent_after(text: Column, pattern: str, group: int) -> Column:
    """Integer captured by a pattern, NULL when it does not match."""
    return F.regexp_extract(text, pattern, group).try_cast("int")
