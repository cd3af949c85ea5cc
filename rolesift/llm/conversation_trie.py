"""Prefix trie of conversations with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns (role, text); its key is the exclusive or of 128
hash bits per turn and place, so prefix keys are running aggregates. ``nodes`` builds the nodes,
``subtree_totals`` contracts the tree: bare runs of a deepest member's path become one node, then
rounds of joins alternately splice out unary nodes (those with coin 1 whose only child has coin
0, so no two neighbours go at once) and rake leaves into their parents. The recorded splices are
undone last round first, which gives every node the totals of its subtree.

A conversation's turns are numbered and its prefix keys taken in buckets of ``BUCKET`` turns whose
offsets are added afterwards, and runs end at such a bucket, so a conversation that holds much of
the table is spread over tasks. Members that end at a node are sorted by range over all tasks and
joined to strings per task; only those strings meet for the digest.

Defined results: null turns come first; equal turns are ordered by role and a hash of the text;
null role or text is empty; rows without a conversation are no part of a trie; repeated
rows are turns of their own; a table without conversations gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.llm.common import bare, staged

#: Turns of one conversation that a task orders at once.
BUCKET = 256
#: Parents with at least one in this many nodes as children are broadcast; at most this many.
HOT_SHARE = 10_000
WORD = r"[^\x20\x09-\x0D]+"
KEY = "struct<a:bigint,b:bigint>"
TOTALS = ("leaves", "saved")


def in_buckets(rows: DataFrame, key: str, order: list[Column], bucket: Column,
               running: dict[str, Column], combine) -> DataFrame:
    """Running aggregates per ``key`` in ``order``, whose buckets ascend with it. They are taken
    inside each bucket; what the buckets before it hold is joined back where there are any."""
    rows = rows.withColumn("_bucket", bucket)
    local = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    whole = rows.groupBy(key, "_bucket").agg(*[v.alias(f"_{c}") for c, v in running.items()])
    before = Window.partitionBy(key).orderBy(F.asc_nulls_first("_bucket"))
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(key, "_bucket", F.row_number().over(before).alias("_nth"), *[
        combine(F.col(f"_{c}")).over(earlier).alias(f"_{c}") for c in running]).filter(
        "_nth > 1").drop("_nth").withColumnRenamed(key, "_key").withColumnRenamed(
        "_bucket", "_of")
    ranked = rows.withColumns({c: v.over(local) for c, v in running.items()})
    return ranked.join(offsets, (F.col(key) == F.col("_key"))
                       & F.col("_bucket").eqNullSafe(F.col("_of")), "left")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 1), the turn's two hashes and the words of its text."""
    turns = bare(conversations, conv_id="conv_id", turn="turn", role="role", text="text") \
        .filter("conv_id IS NOT NULL")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = turns.select("conv_id", "turn", role.alias("role"),
                         F.xxhash64(role, text).alias("x"),
                         F.xxhash64(F.lit(1), text, role).alias("y"),
                         F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ranked = in_buckets(turns, "conv_id", [F.asc_nulls_first("turn"), "role", "x", "y"],
                        F.floor(F.col("turn") / BUCKET), {"at": F.count(F.lit(1))}, F.sum)
    return ranked.select("conv_id", (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"),
                         "x", "y", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations and their turns: the first ``head`` turns of the conversation
    that opens the block of 20, then the own ones after as many."""
    opening = turns.filter("at <= 3 AND conv_id % 20 = 0").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "x", "y", "words"))).alias("first")) \
        .withColumnRenamed("conv_id", "opens")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({
        "head": F.crc32(F.col("conv_id").cast("string")) % 4,
        "opens": F.col("conv_id") - F.col("conv_id") % 20}).join(opening, "opens", "left")
    n_taken = F.coalesce(F.size("taken"), F.lit(0))
    convs = staged(convs.withColumn("taken", F.slice("first", 1, F.col("head").cast("int"))).select(
        "conv_id", "head", "taken", (n_taken + F.greatest(
            F.col("own") - F.col("head"), F.lit(0))).alias("size")), "rebuilt")
    opened = convs.select("conv_id", "size", F.inline("taken"))
    own = turns.join(convs, "conv_id").filter("at > head").select(
        "conv_id", "size", (F.col("at") - F.col("head") + n_taken).alias("at"), "x", "y", "words")
    return convs.select("conv_id", "size"), opened.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations with the keys of their node and its parent."""
    turns = turns.withColumns({"a": F.xxhash64("at", "x", "y"),
                               "b": F.xxhash64(F.lit(2), "y", "x", "at")})
    keyed = in_buckets(turns, "conv_id", ["at"], F.floor(F.col("at") / BUCKET),
                       {"ka": F.bit_xor("a"), "kb": F.bit_xor("b")}, F.bit_xor)
    ka, kb = (F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in ("ka", "kb"))
    return keyed.select(
        "conv_id", "size", F.col("at").alias("depth"), "words",
        F.struct(ka.alias("a"), kb.alias("b")).alias("node"),
        F.struct(ka.bitwiseXOR(F.col("a")).alias("a"), kb.bitwiseXOR(F.col("b")).alias("b")).alias("parent"))


def nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (the root has a null parent), and the members that end at them."""
    turns = staged(numbered(conversations), "turns")
    convs, turns = rebuilt(turns)
    members = staged(prefixes(turns), "prefixes")
    root = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    deepest = F.max(F.struct("size", (-F.col("conv_id")).alias("conv"))).alias("path")
    below = members.groupBy("node", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.any_value("words").alias("words"), F.any_value("parent").alias("parent"), deepest)
    top = convs.groupBy().agg(F.min("conv_id").alias("conv_id"),
                              F.count(F.lit(1)).alias("n_convs"), deepest).filter(
        "n_convs > 0").select(root.alias("node"), F.lit(0).cast("long").alias("depth"),
                              "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
                              F.lit(None).cast(KEY).alias("parent"), "path")
    ends = members.filter("depth = size").select("node", "conv_id").unionByName(
        convs.filter("size = 0").select(root.alias("node"), "conv_id"))
    tree = below.unionByName(top)
    children = tree.groupBy(F.col("parent").alias("_of")).agg(
        F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, F.col("node") == F.col("_of"), "left").select(
        "node", "parent", "depth", "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("path.conv").alias("path"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    return staged(tree, "nodes"), ends


def runs(tree: DataFrame) -> DataFrame:
    """Contract each bare run of a path to its last node: that node (``last``), what the run adds
    between a node and it, and the parent of the run's first node."""
    piece = Window.partitionBy("path", "_bucket").orderBy(F.desc("depth"))
    deepest = F.row_number().over(piece) == 1
    run = Window.partitionBy("path", "_bucket", "run").orderBy(F.desc("depth"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = (F.col("n_children") != 1) | F.col("parent").isNull() | F.col("deepest")
    return tree.withColumn("_bucket", F.floor(F.col("depth") / BUCKET)) \
        .withColumn("deepest", deepest).withColumn("run", F.sum(cut.cast("int")).over(piece)) \
        .withColumns({"last": F.first("node").over(whole), "above": F.last("parent").over(whole),
                      "plus": F.sum("saved").over(run) - F.first("saved").over(run),
                      "up": F.sum("saved").over(whole) - F.first("saved").over(whole)})


def contract(active: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of splicing and raking until only the root is left. ``active`` has ``node``,
    ``parent``, the totals gathered so far, ``up_``, what the node's parent gets on top of
    them, and ``round``, a column so that all rounds share their generated code. Gives the finished
    nodes and the splices of each round."""
    finished, spliced = [], []

    def coin(node: str) -> Column:
        return F.xxhash64(node, "round").bitwiseAND(1) == 1

    while True:
        kids = active.groupBy(F.col("parent").alias("_of")).agg(
            F.count(F.lit(1)).alias("kids"), F.min("node").alias("child"))
        known = active.join(kids, F.col("node") == F.col("_of"), "left").withColumn(
            "goes", F.expr("kids <=> 1 AND parent IS NOT NULL")
            & coin("node") & ~coin("child"))
        gone = known.filter("goes").select(
            F.col("child").alias("_child"), F.col("node").alias("_spliced"),
            F.col("parent").alias("_parent"),
            *[(F.col(t) + F.col(f"up_{t}")).alias(f"_{t}") for t in TOTALS],
            *[F.col(t).alias(f"_own_{t}") for t in TOTALS])
        step = staged(known.filter("NOT goes OR goes IS NULL").join(
            gone, F.col("node") == F.col("_child"), "left").select(
            "node", F.coalesce("_parent", "parent").alias("parent"), *TOTALS,
            *[(F.col(f"up_{t}") + F.coalesce(f"_{t}", F.lit(0))).alias(f"up_{t}")
              for t in TOTALS],
            F.col("kids").isNull().alias("leaf"), (F.col("round") + 1).alias("round"), "_spliced",
            *[(F.col(f"_own_{t}") + F.col(f"up_{t}")).alias(f"plus_{t}") for t in TOTALS]),
            "contraction")
        finished.append(step.filter("leaf").select("node", *TOTALS))
        spliced.append(step.filter("_spliced IS NOT NULL").select(
            F.col("_spliced").alias("node"), F.col("node").alias("child"),
            *[F.col(f"plus_{t}").alias(t) for t in TOTALS]))
        if step.filter("NOT leaf").isEmpty():
            return finished, spliced
        raked = step.filter("leaf").groupBy(F.col("parent").alias("_of")).agg(
            *[F.sum(F.col(t) + F.col(f"up_{t}")).alias(f"_{t}") for t in TOTALS])
        active = step.filter("NOT leaf").join(raked, F.col("node") == F.col("_of"), "left").select(
            "node", "parent", *[(F.col(t) + F.coalesce(f"_{t}", F.lit(0))).alias(t)
                                for t in TOTALS], *[f"up_{t}" for t in TOTALS], "round")


def expand(finished: list[DataFrame], spliced: list[DataFrame]) -> DataFrame:
    """Totals of every node that the rounds saw, from the last round back to the first."""
    totals = reduce(DataFrame.unionByName, finished)
    for splices in reversed(spliced):
        if splices.isEmpty():
            continue
        below = totals.select(F.col("node").alias("_node"),
                              *[F.col(t).alias(f"_{t}") for t in TOTALS])
        totals = totals.unionByName(staged(splices.join(
            below, F.col("child") == F.col("_node")).select(
            "node", *[(F.col(t) + F.col(f"_{t}")).alias(t) for t in TOTALS]), "expanded"))
    return totals


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` of every node's subtree, itself included."""
    contracted = staged(runs(tree).select("node", "n_children", "last", "above", "saved", "plus",
                                          "up"), "runs")
    active = contracted.filter("node = last").select(
        "node", F.col("above").alias("parent"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), "saved",
        F.lit(0).cast("long").alias("up_leaves"), F.col("up").alias("up_saved"),
        F.lit(0).alias("round"))
    totals = expand(*contract(active)).select(F.col("node").alias("_last"), *TOTALS)
    return contracted.select("node", "last", "plus").join(
        totals, F.col("last") == F.col("_last")).select(
        "node", F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.col("plus")).alias("saved_tokens"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids that end at each node, joined by commas."""

    def join_ids(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1])
                                                   | (b[1:] != b[:-1])]))
            text = [",".join(map(str, part)) for part in np.split(ids, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[first]), pa.array(b[first]), pa.array(ids[first]), pa.array(text)],
                ["a", "b", "first_id", "ids"])

    def digest(batches):
        key, state, done = None, None, ([], [], [])
        for batch in batches:
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    for column, value in zip(done, (*key, state.hexdigest())):
                        column.append(value)
                key, state = (a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()),
                 pa.array(done[2], pa.string())], ["a", "b", "ends_sha256"])
            done = ([], [], [])
        if key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])],
                ["a", "b", "ends_sha256"])

    ids = staged(ends.select("node.a", "node.b", "conv_id"), "ends")
    parts = ids.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id") \
        .mapInArrow(join_ids, "a long, b long, first_id long, ids string")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first_id").mapInArrow(
        digest, "a long, b long, ends_sha256 string").select(
        F.struct("a", "b").alias("_end"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: smallest member, depth, the parent's smallest member, members, children,
    and of its subtree leaves and saved tokens; the digest of the members that end there."""
    tree, ends = nodes(conversations)
    total = tree.count()
    parents = tree.filter("n_children > 0").select(
        F.col("node").alias("_up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = F.col("n_children") * HOT_SHARE >= total
    hot, rest = parents.filter(wide).drop("n_children"), parents.filter(~wide).drop("n_children")
    of = F.col("parent") == F.col("_up")
    near = tree.join(F.broadcast(hot), of).unionByName(
        tree.join(F.broadcast(hot), of, "left_anti").join(rest, of, "left"))
    nothing = hashlib.sha256(b"").hexdigest()
    return near.join(subtree_totals(tree).withColumnRenamed("node", "_sum"),
                     F.col("node") == F.col("_sum")) \
        .join(ends_digest(ends), F.col("node") == F.col("_end"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
