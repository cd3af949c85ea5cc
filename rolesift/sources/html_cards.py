"""Listing pages: cards cut out of a page, fields read out of a card.

What to read is data (``Pick``); the only Python here walks pages and small cards inside
Arrow-batched UDFs, plain ones from mark to mark, others with the standard library parser. Cards
that come one by one are read by their shape: where the fields of a shape stand is found once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}
#: Pages whose cards are held at once; Spark hands over thousands in a batch.
PAGES = 64
#: Shapes of cards kept with where their fields stand, up to a number of marks and texts.
KNOWN_SHAPES, SHAPE_LENGTH = 1 << 10, 1 << 9
#: Marks kept with what was read from them, up to a length.
KNOWN_MARKS, KNOWN_LENGTH = 1 << 14, 256
BLOCKS = ("p", "span", "div", "h1", "h2", "h3", "h4", "h5")


@dataclass(frozen=True)
class Pick:
    """First matching element's text (or attribute); ``many`` collects all matches."""

    tags: tuple[str, ...] = ()
    cls: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    take: str = "text"
    many: bool = False
    leaf: bool = False          # only elements without block children
    bare: bool = False          # only elements without a class
    up: str = ""                # read the nearest ancestor with this tag instead
    next_sibling: bool = False  # read the following sibling instead
    inside: "Pick | None" = None
    sep: str = " "


@dataclass(eq=False, slots=True)
class _Mark:
    """What stands between ``<`` and ``>``: a start tag, an end tag, or neither."""

    tag: str
    attrs: dict[str, str] | None = None     # None for an end tag
    selfclosed: bool = False
    void: bool = False
    matched: dict[int, bool] = field(default_factory=dict)
    number: int = -1                        # what a card reader's picks see in it


class _Marks:
    """Marks that were read before, and which picks they match; one per reader, bounded."""

    NAME = r"[a-zA-Z][a-zA-Z0-9]*"
    ATTR = r"""[ \t\n\r\f]+([a-zA-Z][-_:a-zA-Z0-9]*)(=(?:'[^']*'|"[^"]*"))?"""
    END = re.compile(f"/({NAME})")
    START = re.compile(f"({NAME})((?:{ATTR})*)[ \\t\\n\\r\\f]*(/?)")
    #: A comment or a document type without marks inside.
    OTHER = re.compile(r"!--[^-]*--|!doctype [-/a-zA-Z0-9 ]*", re.I)
    #: Their content has rules of its own.
    RAW = {"plaintext", *HTMLParser.CDATA_CONTENT_ELEMENTS,
           *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())}

    def __init__(self):
        self.known: dict[str, _Mark] = {}
        self.picks: dict[int, Pick] = {}    # kept, so that no other pick gets their id

    def parse(self, head: str) -> _Mark | None:
        """The mark, None where only the whole parser knows what it is."""
        if found := self.END.fullmatch(head):
            mark = _Mark(found[1].lower())
        elif self.OTHER.fullmatch(head):
            mark = _Mark("")
        elif (found := self.START.fullmatch(head)) and found[1].lower() not in self.RAW:
            attrs = [(m[1], m[2][2:-1] if m[2] else "")
                     for m in re.finditer(self.ATTR, found[2])]
            mark = self.start(found[1].lower(), {
                k.lower(): unescape(v) if "&" in v else v for k, v in attrs}, found[5] == "/")
        else:
            return None
        if len(head) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN_MARKS:
                self.known.clear()
            self.known[head] = mark
        return mark

    @staticmethod
    def start(tag: str, attrs: dict[str, str], selfclosed: bool = False) -> _Mark:
        return _Mark(tag, attrs, selfclosed, tag in VOID)

    def matches(self, mark: _Mark, pick: "Pick") -> bool:
        result = mark.matched.get(id(pick))
        if result is None:
            self.picks[id(pick)] = pick
            result = mark.matched[id(pick)] = _matches(mark, pick)
        return result


class _Parser(HTMLParser):
    """The library's parser, for pages that are more than plain tags and text."""

    def __init__(self, tree: "_Tree", html: str):
        super().__init__(convert_charrefs=True)
        self.tree, self.source, self.starts = tree, html, [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(html)
        self.close()

    def _at(self) -> int:
        line, col = self.getpos()
        return self.starts[line - 1] + col

    def handle_starttag(self, tag, attrs, selfclosed=False):
        at = self._at()
        self.tree.enter(_Marks.start(tag, {k: v or "" for k, v in attrs}, selfclosed), at,
                        at + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        if self.tree.open_by_tag.get(tag):
            self.tree.leave(self.tree.open_by_tag[tag][-1],
                            self.source.find(">", self._at()) + 1)

    def handle_data(self, data):
        piece = data.strip()
        if piece:
            self.tree.pieces.append(piece)


def _piece(text: str) -> str:
    return (unescape(text) if "&" in text else text).strip()


#: The page or card that is read, as a parent of its elements.
ROOT = -1


class _Tree:
    """Elements and text pieces of a page from one forward pass, in lists by document order.

    Each tag and each text costs the same however deep it lies: an end tag looks its element up
    by name, and elements keep ranges of the lists of elements and pieces instead of lists of their
    own. Pages of plain tags, comments and texts are cut at their marks, each mark read once;
    any other page goes through the library's parser as a whole.
    """

    def __init__(self, html: str, marks: _Marks | None = None):
        self.seen = marks or _Marks()
        self._clear()
        if not self._plain(html):
            self._clear()
            _Parser(self, html)
        for at in self.open[1:]:
            self.last[at], self.last_piece[at] = len(self.marks), len(self.pieces)
        self.nodes = range(len(self.marks))
        self.blocks: list[int] | None = None
        self.by_mark: dict[_Mark, list[int]] | None = None
        self.found: dict[int, list[int]] = {}

    def _clear(self) -> None:
        self.marks, self.parent, self.start, self.end, self.last = [], [], [], [], []
        self.piece, self.last_piece, self.pieces = [], [], []
        self.open, self.open_by_tag = [ROOT], {}

    def _plain(self, html: str) -> bool:
        """Read the page if it is plain; False, and nothing that counts, if it is not."""
        before, *parts = html.split("<")
        self._text(before)
        known, open_by_tag, at = self.seen.known, self.open_by_tag, len(before)
        for part in parts:
            head, closed, text = part.partition(">")
            mark = known.get(head) or self.seen.parse(head)
            if mark is None or not closed:
                return False
            if mark.attrs is not None:
                self.enter(mark, at, at + len(head) + 2)
            elif open_by_tag.get(mark.tag):
                self.leave(open_by_tag[mark.tag][-1], at + len(head) + 2)
            if text:
                self._text(text)
            at += len(part) + 1
        return True

    def _text(self, text: str) -> None:
        piece = _piece(text)
        if piece:
            self.pieces.append(piece)

    def enter(self, mark: _Mark, start: int, end: int) -> None:
        index, n, still = len(self.marks), len(self.pieces), self.open
        self.marks.append(mark)
        self.parent.append(still[-1])
        self.start.append(start)
        self.piece.append(n)
        self.last_piece.append(n)
        self.last.append(index + 1)
        self.end.append(end if mark.void else None)
        if not (mark.void or mark.selfclosed):
            if mark.tag in self.open_by_tag:
                self.open_by_tag[mark.tag].append(len(still))
            else:
                self.open_by_tag[mark.tag] = [len(still)]
            still.append(index)

    def leave(self, depth: int, end: int) -> None:
        for at in self.open[depth:]:
            self.last[at], self.last_piece[at] = len(self.marks), len(self.pieces)
            self.end[at] = end
            self.open_by_tag[self.marks[at].tag].pop()
        del self.open[depth:]

    def hits(self, pick: "Pick") -> list[int]:
        """Indexes of the elements that match, found once per page."""
        if id(pick) not in self.found:
            if self.by_mark is None:
                self.by_mark = {}
                for at, mark in enumerate(self.marks):
                    self.by_mark.setdefault(mark, []).append(at)
            out = [at for mark, those in self.by_mark.items() if self.seen.matches(mark, pick)
                   for at in those]
            out.sort()
            if pick.leaf:
                out = [at for at in out if not self._has_blocks(at)]
            self.found[id(pick)] = out
        return self.found[id(pick)]

    def _has_blocks(self, at: int) -> bool:
        if self.blocks is None:
            self.blocks = [0, *accumulate(m.tag in BLOCKS for m in self.marks)]
        return self.blocks[self.last[at]] > self.blocks[at + 1]


class _Scope:
    """What a pick is read from: a whole page, or one card as if it were a page of its own."""

    def __init__(self, tree: _Tree, card: int | None = None):
        self.tree, self.card = tree, card
        self.first, self.last = (0, len(tree.marks)) if card is None else (card, tree.last[card])
        self.above: dict[str, dict[int, int | None]] = {}

    def parent(self, at: int) -> int:
        return ROOT if at == self.card else self.tree.parent[at]

    def nearest(self, at: int, tag: str) -> int | None:
        """Nearest element around ``at`` with the tag; ways up are walked once."""
        known, way = self.above.setdefault(tag, {}), []
        climb, marks = self.parent(at), self.tree.marks
        while climb != ROOT and marks[climb].tag != tag and climb not in known:
            way.append(climb)
            climb = self.parent(climb)
        if climb == ROOT:
            result = None
        else:
            result = climb if marks[climb].tag == tag else known[climb]
        known.update(dict.fromkeys(way, result))
        return result

    def target(self, at: int, pick: "Pick") -> int | None:
        if pick.up:
            near = self.nearest(at, pick.up)
            at = self.parent(at) if near is None else near
        if pick.next_sibling and at != ROOT:
            after = self.tree.last[at]
            # An element's elements are followed by its sibling, where it has one.
            near = at != self.card and after < len(self.tree.marks) \
                and self.tree.parent[after] == self.tree.parent[at]
            at = after if near else None
        return at

    def value(self, at: int, pick: "Pick") -> str:
        tree = self.tree
        if pick.take != "text":
            raw = "" if at == ROOT else tree.marks[at].attrs.get(pick.take, "")
        elif at == ROOT and self.card is None:
            raw = pick.sep.join(tree.pieces)
        else:
            at = self.card if at == ROOT else at
            raw = pick.sep.join(tree.pieces[tree.piece[at]:tree.last_piece[at]])
        return " ".join(raw.split())

    def read(self, pick: "Pick"):
        first, last = self.first, self.last
        if pick.inside is not None:
            holders = self.tree.hits(pick.inside)
            at = bisect_left(holders, first)
            if at == len(holders) or holders[at] >= last:
                return [] if pick.many else None
            first, last = holders[at] + 1, self.tree.last[holders[at]]
        hits, out = self.tree.hits(pick), []
        for at in range(bisect_left(hits, first), len(hits)):
            if hits[at] >= last:
                break
            node = self.target(hits[at], pick)
            if node is None:
                continue
            value = self.value(node, pick)
            if not pick.many:
                return value
            out.append(value)
        return out if pick.many else None


def _matches(mark: _Mark, pick: Pick) -> bool:
    """Whether a start tag matches; ``leaf`` asks for its content besides."""
    if pick.tags and mark.tag not in pick.tags:
        return False
    if pick.cls and not re.search(pick.cls, mark.attrs.get("class", "")):
        return False
    if pick.bare and mark.attrs.get("class"):
        return False
    for name, pattern in pick.attrs.items():
        if name not in mark.attrs or not re.search(pattern, mark.attrs[name], re.I):
            return False
    return True


class _Route(_Scope):
    """Reads where the values of a card stand: an attribute of its nth element, or a range of its
    texts."""

    def value(self, at: int, pick: "Pick") -> tuple:
        if pick.take != "text":
            return pick.take, at, 0, ""
        last = len(self.tree.pieces) if at == ROOT else self.tree.last_piece[at]
        return None, 0 if at == ROOT else self.tree.piece[at], last, pick.sep


class _Reader:
    """Fields of cards. Cards of one template have one shape: marks in which the picks see the
    same, with texts between the same ones. Where a shape's fields stand is found once; a
    card of a known shape is cut at its marks and no tree is made."""

    def __init__(self, picks: dict[str, Pick]):
        self.picks = [*picks.values()]
        self.asked = [*self.picks, *(p.inside for p in self.picks if p.inside is not None)]
        #: Attributes that decide which picks match.
        self.deciding = sorted({"class"}.union(*(p.attrs for p in self.asked)))
        self._clear()

    def _clear(self) -> None:
        self.marks, self.numbers, self.sights, self.routes = _Marks(), {}, {}, {}

    def _number(self, mark: _Mark) -> int:
        if mark.attrs is None:
            sight = (mark.tag,)
        else:
            key = (mark.tag, mark.selfclosed, *map(mark.attrs.get, self.deciding))
            sight = self.sights.get(key)
            if sight is None:
                sight = (mark.tag, mark.selfclosed, *(_matches(mark, p) for p in self.asked))
                if sum(len(v) for v in key[2:] if v) <= KNOWN_LENGTH:
                    if len(self.sights) >= KNOWN_MARKS:
                        self.sights.clear()
                    self.sights[key] = sight
        mark.number = self.numbers.setdefault(sight, len(self.numbers))
        return mark.number

    def read(self, html: str) -> list:
        """The value of each pick."""
        if len(self.numbers) >= KNOWN_MARKS:
            self._clear()
        before, *parts = html.split("<")
        known, pieces, starts, shape = self.marks.known, [], [], []
        if piece := _piece(before):
            pieces.append(piece)
            shape.append(-1)
        for part in parts:
            head, closed, text = part.partition(">")
            mark = known.get(head) or self.marks.parse(head)
            if mark is None or not closed:      # only the whole parser knows what it is
                scope = _Scope(_Tree(html, self.marks))
                return [scope.read(pick) for pick in self.picks]
            shape.append(self._number(mark) if mark.number < 0 else mark.number)
            if mark.attrs is not None:
                starts.append(mark)
            if text and (piece := _piece(text)):
                pieces.append(piece)
                shape.append(-1)
        key = tuple(shape)
        route = self.routes.get(key)
        if route is None:
            scope = _Route(_Tree(html, self.marks))
            route = [scope.read(pick) for pick in self.picks]
            if len(key) <= SHAPE_LENGTH:
                if len(self.routes) >= KNOWN_SHAPES:
                    self.routes.clear()
                self.routes[key] = route

        def value(place: tuple) -> str:
            name, first, last, sep = place
            if name is None:
                raw = sep.join(pieces[first:last])
            else:
                raw = "" if first == ROOT else starts[first].attrs.get(name, "")
            return " ".join(raw.split())

        return [[*map(value, r)] if isinstance(r, list) else None if r is None else value(r)
                for r in route]


def html_fields(df: DataFrame, picks: dict[str, Pick], html: str = "html") -> DataFrame:
    """Add one column per pick, read from the card in ``html``."""
    kinds = _arrow(picks)

    @F.arrow_udf(_ddl(picks))
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _Reader(picks)
        for cards in batches:
            values = [[] for _ in picks]
            for card in cards.to_pylist():
                for column, value in zip(values, reader.read(card or "")):
                    column.append(value)
            yield _struct(values, kinds)

    # Not deterministic for the optimizer, so that a filter on a field does not read twice.
    once = read.asNondeterministic()
    return df.withColumn("_f", once(F.col(html))).select("*", "_f.*").drop("_f")


def _ddl(picks: dict[str, Pick]) -> str:
    return ", ".join(f"{n}: {'array<string>' if p.many else 'string'}" for n, p in picks.items())


def _arrow(picks: dict[str, Pick]) -> pa.StructType:
    return pa.struct([(n, pa.list_(pa.string()) if p.many else pa.string())
                      for n, p in picks.items()])


def _read(scope: _Scope, picks: dict[str, Pick], values: list[list]) -> None:
    for pick, column in zip(picks.values(), values):
        column.append(scope.read(pick))


def _struct(values: list[list], kinds: pa.StructType) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(column, kind.type) for column, kind in zip(values, kinds)], fields=list(kinds))


def cut_cards(card: Pick, href: Pick, picks: dict[str, Pick] | None = None,
              keep_html: bool = True) -> "Column":
    """UDF cutting a page into array<struct<href, html, …>> of the matching elements.

    The link and the fields of ``picks`` are read from the same pass over the page; nothing is
    parsed again. Without ``keep_html`` the html is null, and nested cards cost no copies.
    """
    picks = picks or {}
    fields = f", f: struct<{_ddl(picks)}>" if picks else ""

    def one(page, marks):
        tree = _Tree(page or "", marks)
        out = []
        for at in tree.hits(card):
            scope = _Scope(tree, at)
            row = {"href": _link(scope, href),
                   "html": page[tree.start[at]:tree.end[at]] if keep_html else None}
            if picks:
                row["f"] = {n: scope.read(p) for n, p in picks.items()}
            out.append(row)
        return out

    @F.pandas_udf(f"array<struct<href: string, html: string{fields}>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = _Marks()
        for pages in batches:
            for low in range(0, len(pages), PAGES):
                yield pages.iloc[low:low + PAGES].map(lambda page: one(page, marks))

    # Not deterministic for the optimizer, so that a filter on a field does not cut twice.
    return cut.asNondeterministic()


def _link(scope: _Scope, href: Pick) -> str | None:
    mark = scope.tree.marks[scope.card]
    return mark.attrs.get("href") if mark.tag == "a" else scope.read(href)


def _first_cards(card: Pick, href: Pick, picks: dict[str, Pick]) -> "Column":
    """UDF reading a page into array<struct<pos, href, f>>: each link's first card, whose fields alone
    are read. ``pos`` counts all cards of the page; cards without a link are left out."""
    kinds = _arrow(picks)

    @F.arrow_udf(f"array<struct<pos: int, href: string, f: struct<{_ddl(picks)}>>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = _Marks()
        for pages in batches:
            for low in range(0, len(pages), PAGES):
                pos, links, ends, values = [], [], [0], [[] for _ in picks]
                for page in pages[low:low + PAGES].to_pylist():
                    tree, met = _Tree(page or "", marks), set()
                    for nth, at in enumerate(tree.hits(card)):
                        scope = _Scope(tree, at)
                        link = _link(scope, href)
                        if link is not None and link not in met:
                            met.add(link)
                            pos.append(nth)
                            links.append(link)
                            _read(scope, picks, values)
                    ends.append(len(pos))
                rows = pa.StructArray.from_arrays(
                    [pa.array(pos, pa.int32()), pa.array(links, pa.string()),
                     _struct(values, kinds)], ["pos", "href", "f"])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return cut.asNondeterministic()


LINK = Pick(tags=("a",), attrs={"href": "."}, take="href")


def absolute_url(base: str, href: Column) -> Column:
    host = F.lit(base.rstrip("/"))
    return F.when(href.rlike("^https?://"), href) \
        .when(F.startswith(href, F.lit("/")), F.concat(host, href)) \
        .otherwise(F.concat(host, F.lit("/"), href))


ANCHOR = r"""<a\s[^>]*?href=["']([^"']*)["']"""


def anchor_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Anchors of each page with position, on the JVM.

    The page is cut at closing tags; the first anchor with a link in a part is a card, up to the
    part's end. So an anchor that is never closed costs its part and not the rest of the page.
    """
    parts = F.split(F.col(html), "</a>", -1)
    bodies = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
                         lambda p: F.regexp_extract(p, f"(?s){ANCHOR}[^>]*>.*", 0))
    cards = F.transform(F.filter(bodies, lambda b: b != ""), lambda b: F.struct(
        F.regexp_extract(b, f"^{ANCHOR}", 1).alias("href"),
        F.concat(b, F.lit("</a>")).alias("html")))
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(cards).alias("pos", "c")) \
        .select(*kept, "pos", F.col("c.href").alias("href"), F.col("c.html").alias("card_html"))


def extract_cards(pages: DataFrame, href_pattern: str, base: str, card: Pick | None = None,
                  page_key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per distinct link: href, url, card html, from its first appearance.

    Plain anchors stay on the JVM; other containers are cut out by the card pick. The
    first appearance is an aggregate per link, so repeated links combine before the
    shuffle.
    """
    if card is None or card == LINK:
        rows = anchor_cards(pages.select(page_key, html), html)
    else:
        rows = pages.select(page_key, F.posexplode(cut_cards(card, LINK)(F.col(html)))
                            .alias("pos", "c")) \
            .select(page_key, "pos", F.col("c.href").alias("href"),
                    F.col("c.html").alias("card_html"))
    links = rows.where(F.col("href").rlike(href_pattern))
    first = links.groupBy("href").agg(
        F.min_by(F.struct(page_key, "pos", "card_html"), F.struct(page_key, "pos")).alias("c"))
    return first.select("href", absolute_url(base, F.col("href")).alias("url"), "c.*")


def card_fields(pages: DataFrame, card: Pick, href_pattern: str, base: str,
                picks: dict[str, Pick], page_key: str = "page_id", html: str = "html"
                ) -> DataFrame:
    """One row per distinct link with the fields of its card, from its first appearance.

    Pages are parsed once, cards are not stored, and of a link's cards on one page only the first is
    read. Null and unfinished pages give the cards they have;
    cards without a matching link are left out.
    """
    rows = pages.select(page_key, F.inline(_first_cards(card, LINK, picks)(F.col(html))))
    links = rows.where(F.col("href").rlike(href_pattern))
    first = links.groupBy("href").agg(
        F.min_by(F.struct(page_key, "pos", "f"), F.struct(page_key, "pos")).alias("c"))
    return first.select("href", absolute_url(base, F.col("href")).alias("url"),
                        F.col(f"c.{page_key}"), F.col("c.pos"), "c.f.*")
