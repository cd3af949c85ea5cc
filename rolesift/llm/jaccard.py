"""Exact Jaccard self-join of documents on word n-grams by a grouped prefix join.

1. Every document becomes its set of n-gram hashes. Equal sets are one class, represented by
   the smallest id.
2. Sets are ordered by (level of corpus frequency, hash). Two sets whose Jaccard similarity
   reaches the limit share ``k`` elements of their prefixes, the first ``n - ceil(limit n) + k``
   elements, for any k up to the overlap they need. Frequencies only shape this order, never
   the result.
3. Classes with the same size and prefix form a group. Groups meet on prefix elements that more
   than one class has; size and position filters drop groups that cannot reach the limit.
4. Links are verified on whole sets in two rounds. First each class is compared with one hub,
   the group that leads most of its lists, and members with their group's pivot; this joins
   families of copies by as many comparisons as they have members. Then every pair of members
   that shares k prefix elements, passes the filters and lies in different components is
   verified. Pairs within a component cannot change it and are not formed.
5. Components of all verified links are found by alternating star contraction.

Defined results: a null or empty text has no set, no links and its own id as component; rows
without an id or with a shared one are documents of their own, known by id and text, so only
repeated rows are one; a component without any id has none; an empty table gives no rows; other
columns are not read. Hashes have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.common import Words, bare, drop_staged, mix, slices, staged


@dataclass(frozen=True)
class Rule:
    n: int = 4
    percent: int = 85
    #: Prefix elements that a pair must share (fewer for sets that need a smaller overlap).
    common: int = 4
    #: Elements in at least this share of documents get a frequency level of their own. The
    #: table sent to every task has at most 1 / share times the mean set size entries.
    frequent_share: float = 1e-4
    frequent_least: int = 16


def sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one gram of all its words."""
    words = Words(column, lower=True)
    grams = {k: words.grams(k)[0] for k in range(1, n + 1)}
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        size = min(b - a, n)
        if size == n:
            out.append(np.unique(grams[n][a:b - n + 1]))
        else:
            out.append(mix(grams[size][a:a + 1] + np.uint64(size)) if size
                       else np.empty(0, np.uint64))
    return out


def frequent(texts: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent elements and the levels that order them after all others.

    Tasks count all their elements, dropping single ones whenever the table is full, and report
    those met three times or more; the sums decide the order of elements only.
    """

    def count(batches):
        seen, times, held, size, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0, 0

        def merge(prune: bool) -> None:
            h = np.concatenate([*seen, *held])
            c = np.concatenate([*times, np.ones(len(h) - len(seen[0]), np.int64)])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else \
                np.empty(0, np.int64)
            c = np.add.reduceat(c, first) if len(first) else c
            h = h[first]
            if prune and len(h) > 3_000_000:
                h, c = h[c > 1], c[c > 1]
            seen[:], times[:] = [h], [c]
            held.clear()

        for batch in slices(batches, "text"):
            docs += batch.num_rows
            held += sets(batch.column(0), rule.n)
            size += sum(map(len, held[-batch.num_rows:]))
            if size > 3_000_000:
                merge(prune=True)
                size = 0
        merge(prune=False)
        use = times[0] >= 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen[0][use].view(np.int64), 0)),
             pa.array(np.append(times[0][use], docs)),
             pa.array(np.append(np.zeros(int(use.sum()), bool), True))],
            ["element", "n", "total"])

    sums = texts.mapInArrow(count, "element long, n long, total boolean").groupBy(
        "element", "total").agg(F.sum("n").alias("n"))
    sums = staged(sums, "element-counts")
    docs = sums.filter("total").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(rule.frequent_least, int(docs * rule.frequent_share))
    found = sums.filter((F.col("n") >= least) & ~F.col("total")).select("element", "n").toPandas()
    drop_staged(sums)
    found = found.sort_values("element", kind="stable") if len(found) else found
    h = found["element"].to_numpy(np.int64).view(np.uint64)
    level = np.minimum(np.ceil(np.log2(np.maximum(found["n"].to_numpy(float), 1)) * 4), 255)
    order = np.argsort(h)
    return h[order], level[order].astype(np.uint64)


def signatures(texts: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, f1, f2, prefix) of each document; f1 and f2 identify the set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts.select("text"), rule))
    other = np.uint64(0x5851F42D4C957F2D)

    def run(batches):
        known, level = shared.value
        for batch in slices(batches, "text"):
            size, f1, f2, prefixes = [], [], [], []
            for s in sets(batch.column(1), rule.n):
                n = len(s)
                key = s >> np.uint64(8)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    key[hit] |= level[at[hit]] << np.uint64(56)
                size.append(n)
                f1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(mix(s ^ other).sum(dtype=np.uint64).astype(np.int64)))
                least = -(-n * rule.percent // 100)
                length = n - least + min(rule.common, least)
                prefixes.append(np.sort(key)[:length].view(np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(f1, pa.int64()),
                 pa.array(f2, pa.int64()), pa.ListArray.from_arrays(
                     pa.array(bounds, pa.int32()), pa.array(np.concatenate(prefixes)))],
                ["id", "n", "f1", "f2", "prefix"])

    return texts.mapInArrow(run, "id long, n long, f1 long, f2 long, prefix array<long>")


def possible(rule: Rule, a: str, b: str):
    """Size and position filter for two sets at one of their first shared elements.

    Before the k-th shared element lie k - 1 shared ones, all among the ``met`` elements that
    other prefixes have too; whatever else lies before it is in one set only.
    """
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    left = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos")) + F.least(
        F.lit(rule.common - 1), F.col(f"{a}met"), F.col(f"{b}met"))
    p = rule.percent
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * p) & (left * (100 + p) >= (na + nb) * p)


def shared_least(rule: Rule, n):
    """Prefix elements a set shares with any set it links to."""
    return F.least(F.lit(rule.common), F.ceil(n * rule.percent / 100))


def verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of ids whose sets reach the limit. Sets are made anew for the ids that
    occur in pairs, so nothing is stored for documents without candidates."""
    p = rule.percent
    wanted = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(),
                    "wanted")
    whole = staged(whole_sets(texts.join(wanted, "id"), rule), "sets")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    left = whole.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = whole.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    links = staged(joined.mapInArrow(run, "a long, b long"), "links")
    drop_staged(wanted, whole)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Alternates large stars (neighbours above a node move to its smallest neighbour) and small
    stars (the others do) until the edges stay the same; each step is a written table.
    """
    edges, before = staged(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct(), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m")
                                                                    .alias("m"))
        large = staged(both.join(least, "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        found = staged(small, "small-star")
        drop_staged(edges, large)
        edges = found
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state


def labelled(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``df`` with ``comp``, the component of ``column``: itself where it has no link."""
    return df.join(labels.withColumnRenamed("node", column), column, "left").withColumn(
        "comp", F.coalesce("component", column)).drop("component")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with one id per document, and (key, doc_id) of ids that had to be made.

    A unique id is its own key. Rows with a null or shared id get keys outside the range of the
    ids, one per id and text; these are made once and stored.
    """
    texts = bare(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    shared = staged(texts.groupBy("id").count().filter("id IS NULL OR count > 1").select(
        F.col("id").alias("_id")), "shared-ids")
    if shared.isEmpty():
        return texts, None
    low, high = texts.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    room = 2**62
    if low < -room and high > room:
        raise ValueError("ids leave no room for keys of rows without their own")
    nth = F.monotonically_increasing_id() + 1
    hashed = texts.withColumn("hash", F.md5("text"))
    keys = staged(hashed.join(shared, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select(
        F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct().withColumn(
        "key", F.lit(low) - nth if low >= -room else F.lit(high) + nth), "keys")
    own = hashed.join(keys, F.col("id").eqNullSafe(F.col("_id"))
                      & F.col("hash").eqNullSafe(F.col("_hash")), "left")
    return staged(own.select(F.coalesce("key", "id").alias("id"), "text"), "keyed-texts"), \
        keys.select("key", F.col("_id").alias("doc_id"))


def join(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text"
         ) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    texts, keys = keyed(docs, id_col, text_col)
    return named(classed(texts, rule), keys).select("doc_id", "n_shingles", "component_id")


def named(placed: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Ids in place of made keys; the smallest one of a component names it."""
    if keys is None:
        return placed.select("key", F.col("key").alias("doc_id"), "n_shingles", "component",
                             F.col("component").alias("component_id"))
    rows = placed.join(keys.withColumn("made", F.lit(True)), "key", "left").withColumn(
        "doc_id", F.when(F.col("made"), F.col("doc_id")).otherwise(F.col("key"))).drop("made")
    names = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "component").select("key", "doc_id", "n_shingles", "component",
                                                "component_id")


def classed(texts: DataFrame, rule: Rule) -> DataFrame:
    """(key, n_shingles, component) of every row of (id, text) with one id per document."""
    marks = staged(signatures(texts, rule), "signatures")
    same = ["n", "f1", "f2"]
    full = staged(marks.filter("n > 0").groupBy(*same, "prefix").agg(F.min("id").alias("rep")),
                  "classes-with-prefix")
    whole_marks, marks = marks, staged(marks.select("id", *same), "marks")
    drop_staged(whole_marks)
    groups = staged(full.groupBy("n", "prefix").agg(
        F.min("rep").alias("pivot"), F.count("*").alias("members")), "groups")
    members = staged(full.join(groups.filter("members > 1"), ["n", "prefix"]).select(
        "pivot", "rep"), "members")
    classes = staged(full.select(*same, "rep"), "classes")
    drop_staged(full)

    postings = groups.select("pivot", "n", "members", F.posexplode("prefix").alias(
        "pos", "element"))
    often = postings.groupBy("element").agg(F.sum("members").alias("m")).filter("m > 1") \
        .select("element")
    # A set's prefix is bounded by its document.
    before = Window.partitionBy("pivot", "n").orderBy("pos")
    shared = staged(postings.join(often, "element").drop("members").withColumn(
        "met", F.row_number().over(before) - 1), "postings")
    drop_staged(groups)

    hubs = shared.groupBy("element").agg(
        F.min(F.struct("pos", "n", "pivot", "met")).alias("hub")).select(
            "element", F.col("hub.pos").alias("h_pos"), F.col("hub.n").alias("h_n"),
            F.col("hub.met").alias("h_met"), F.col("hub.pivot").alias("hub"))
    led = shared.select("element", "pivot", F.col("pos").alias("p_pos"), F.col("n").alias("p_n"),
                        F.col("met").alias("p_met")).join(hubs, "element").filter(
        (F.col("pivot") != F.col("hub")) & possible(rule, "p_", "h_"))
    # Round one may leave pairs out: round two takes every pair that it did not join.
    first = led.groupBy("pivot", "hub", "p_n").count().filter(
        F.col("count") >= shared_least(rule, F.col("p_n"))).groupBy("pivot").agg(
        F.max(F.struct("count", -F.col("hub"))).alias("best")).select(
            F.col("pivot").alias("a"), (-F.col("best.col2")).alias("b"))
    first = first.union(members.filter("pivot <> rep").select("rep", "pivot"))
    links = verify(staged(first.distinct(), "first-pairs"), texts, rule)
    labels = components(links)

    rest = verify(staged(across(shared, members, labels, rule), "rest-pairs"), texts, rule)
    drop_staged(shared)
    labels = components(links.union(rest))

    of_class = labelled(classes.select(*same, "rep"), labels, "rep").groupBy(*same).agg(
        F.min("comp").alias("comp"))
    placed = marks.select("id", *same).join(of_class, same, "left").withColumn(
        "comp", F.coalesce("comp", "id"))
    return placed.select(F.col("id").alias("key"), F.col("n").alias("n_shingles"),
                         F.col("comp").alias("component"))


def whole_sets(texts: DataFrame, rule: Rule) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets(batch.column(1), rule.n)],
                                           pa.binary())], ["id", "elements"])

    return texts.select("id", "text").mapInArrow(run, "id long, elements binary")


def across(shared: DataFrame, members: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members on one list, possible under the filters, in different components.

    On a list most members are usually in one component already; only the others are paired with
    the list, so the work is the number of others times the length of the list.
    """
    every = shared.join(members, "pivot", "left").select(
        "element", "pos", "n", "met", F.coalesce("rep", "pivot").alias("id"))
    every = labelled(every, labels, "id")
    by_comp = every.groupBy("element", "comp").count()
    main = by_comp.groupBy("element").agg(
        F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps")) \
        .filter("comps > 1").select("element", F.col("top.comp").alias("main"))
    mixed = staged(every.join(main, "element"), "mixed-lists")
    a = mixed.filter("comp <> main").select(
        F.col("element").alias("e"), F.col("id").alias("a"), F.col("comp").alias("a_comp"),
        F.col("met").alias("a_met"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"))
    b = mixed.select("element", "main", F.col("id").alias("b"), F.col("comp").alias("b_comp"),
                     F.col("met").alias("b_met"), F.col("n").alias("b_n"),
                     F.col("pos").alias("b_pos"))
    pairs = a.join(b, (F.col("e") == F.col("element")) & (F.col("a_comp") != F.col("b_comp"))
                 & ((F.col("b_comp") == F.col("main")) | (F.col("a") > F.col("b")))
                 & possible(rule, "a_", "b_")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"),
        F.least("a_n", "b_n").alias("n"))
    return pairs.groupBy("a", "b", "n").agg(F.count("*").alias("common")).filter(
        F.col("common") >= shared_least(rule, F.col("n"))).select("a", "b")


def keep_one(docs: DataFrame, rule: Rule = Rule(n=5, percent=80), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id; columns unchanged.

    Rows that repeat id and text are one document, of which one row stays; among rows that share
    the smallest id, and among rows without one, the least hash of the text decides.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own_id = F.col("_row").getField(id_col).cast("long")
    text = F.col("_row").getField(text_col)
    texts, keys = keyed(docs, id_col, text_col)
    placed = classed(texts, rule)
    if keys is None:
        kept = placed.filter("key = component").select(F.struct("key").alias("_kept"))
        return rows.join(kept, own_id == F.col("_kept.key"), "left_semi").select("_row.*")
    hashed = texts.select(F.col("id").alias("key"), F.md5("text").alias("hash")).distinct()
    found = named(placed, keys).select("key", "doc_id", "component").distinct().join(hashed, "key")
    best = found.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("_kept"))
    first = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    return rows.withColumns({"_id": own_id, "_hash": F.md5(text)}).join(
        best.select("_kept"), F.col("_id").eqNullSafe(F.col("_kept.doc_id"))
        & F.col("_hash").eqNullSafe(F.col("_kept.hash")), "left_semi").withColumn(
        "_n", F.row_number().over(first)).filter("_n = 1").select("_row.*")
