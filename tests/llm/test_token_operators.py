"""Piece encoding, alignment of two tokenizers and the conversation trie."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesift.llm import conversation_trie, piece_codec, queries, token_alignment
from rolesift.llm.piece_codec import SPACE

SIGNS = [SPACE, " ", "  ", "\n", " \n", "a", "b", "the", "ing", "é", "日", "本", "0", "1", "😀",
         "\t", "\r", ";", "{", "\0", "<s>", "<0x0A>", "<|endoftext|>", "er", "in", "'s", "-",
         "=", "//", "　", "한", "ß", "word", "</s>"]


def awkward(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS[k % 2:]) for _ in range(rng.randint(0, 16)))
            for k in range(n)]


def by_rows(df):
    return Counter(tuple(r) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- piece codec

def test_backtracking_gives_the_librarys_ids():
    codec = piece_codec.piece_ids(piece_codec.VOCABULARY)
    library = piece_codec.library(piece_codec.VOCABULARY)
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/"
    texts = awkward(4000) + [
        "".join(rng.choice(letters) for _ in range(60_000)), "日本語한국어" * 4000, "x" * 20_000,
        " " * 3001, "=" * 5000, "aaab" * 5000, "\n" * 77]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in codec.encode(texts)]
    assert got == library.encode(texts)


def test_tokens_merge_to_themselves_and_neighbours_stay_apart():
    codes = piece_codec.piece_ids(piece_codec.VOCABULARY).codes
    for text in ["▁unbelievably", "▁internationalization", "xxxxxxx", "▁▁▁▁▁▁▁", "q\r\rq"]:
        tokens = codes.tokens(text, codes.longest(text))
        assert tokens == codes.merge(list(text))
        assert all(codes.apart(a, b) for a, b in zip(tokens, tokens[1:]))


def test_texts_are_not_cut_where_a_vocabulary_forbids_it():
    codec = piece_codec.PieceIds()
    library = piece_codec.library(piece_codec.VOCABULARY)
    codec.codes.cuttable = False
    texts = awkward(300, seed=9)
    assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] \
        == library.encode(texts)


def test_pair_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_codec, "PAIR_ENTRIES", 50)
    codes = piece_codec.MergeCodes()
    for text in awkward(200, seed=4):
        escaped = text.replace(" ", SPACE)
        codes.tokens(escaped, codes.longest(escaped))
    assert len(codes.pairs) <= 50


def test_round_trip_of_a_table(docs, texts, empty):
    library = piece_codec.library(piece_codec.VOCABULARY)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "") + [library.eos_id()]
        want[(i, tuple(ids), library.decode(ids))] += 1
    got = piece_codec.round_trip(docs)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert Counter((r[0], tuple(r[1]), r[2]) for r in got.collect()) == want
    assert piece_codec.round_trip(empty).count() == 0


def test_piece_query(spark, docs, texts, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = piece_codec.library(piece_codec.VOCABULARY)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "") + [library.eos_id()]
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))] += 1
    assert by_rows(queries.op13_piece_codec(spark, str(tmp_path))) == want


# ---------------------------------------------------------------- alignment

def test_galloping_finds_the_common_values():
    rng = random.Random(6)
    for _ in range(400):
        a, b = (sorted(rng.sample(range(120), rng.randint(0, 60))) for _ in range(2))
        pairs = token_alignment.common_ends(a, b)
        assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == sorted({*a} & {*b})


def test_overlaps_are_rank_differences():
    assert token_alignment.overlaps([(1, 0), (2, 3)]) == [(0, 2, 0, 1), (2, 3, 1, 4)]


def aligned(text):
    """Groups and linked pairs of one text, from both libraries and plain sets."""
    work = token_alignment.aligner(token_alignment.BYTE_VOCABULARY,
                                   token_alignment.PIECE_VOCABULARY)
    if not text:
        return None
    a = work.a.library.encode(" " + text, add_special_tokens=False).ids
    b = work.b.encode(text)
    sides = [[work.a.bytes[i] for i in a], [work.b_bytes[i] for i in b]]
    if any(b"".join(side) != (" " + text).encode() for side in sides):
        return None
    a_ends, b_ends = ([*accumulate(map(len, side))] for side in sides)
    groups, links, low = [], [], 0
    for end in sorted({*a_ends} & {*b_ends}):
        groups.append(",".join(str(i) for i, e in zip(a, a_ends) if low < e <= end) + "|"
                      + ",".join(str(i) for i, e in zip(b, b_ends) if low < e <= end))
        links.append((a[a_ends.index(end)], b[b_ends.index(end)]))
        low = end
    return ";".join(groups), len(a), len(b), links


def test_byte_signs_cover_every_byte_once():
    assert sorted(token_alignment.byte_signs().values()) == list(range(256))


def test_aligned_pieces_against_whole_texts():
    work = token_alignment.aligner(token_alignment.BYTE_VOCABULARY,
                                   token_alignment.PIECE_VOCABULARY)
    for text in awkward(3000, seed=7):
        parts = work.align_all([text])[0]
        want = aligned(text)
        if None in parts or not parts:
            assert want is None
        else:
            assert (";".join(p[0] for p in parts), sum(p[1] for p in parts),
                    sum(p[2] for p in parts), sum(p[3] for p in parts)) == (
                *want[:3], len(want[3]))


@pytest.mark.parametrize("share", [token_alignment.HOT_SHARE, 20])
def test_link_statistics_against_brute_force(spark, tmp_path, monkeypatch, share):
    """With the smaller share both joins carry rows."""
    monkeypatch.setattr(token_alignment, "HOT_SHARE", share)
    rng = random.Random(8)
    words = ["the", "licence", "naïve", "don't", "x", "日本", "\n", "int()", "  ", "Zürich"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), "x")
            for i in range(60)]
    rows += [(100, ""), (101, None), (102, "a▁b"), (103, "\nline"), (None, "the x"),
             (104, "y" * 30_000), (3, rows[3][1]), (105, "\n"), (106, "<|endoftext|> <s>")]
    rows = [(r[0], r[1], "x") for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(4) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    found = [aligned(t) for _, t, _ in rows]
    counts = Counter(p for f in found if f for p in f[3])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = Counter()
    for (i, _, _), f in zip(rows, found):
        if f is None:
            want[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        n = len(f[3])
        want[(i, f[1], f[2], n, n, sum(counts[p] == highest[p[1]] for p in f[3]),
              sum(counts[p] for p in f[3]), sha(f[0]))] += 1
    assert by_rows(queries.op11_token_alignment(spark, str(tmp_path))) == want


def test_alignment_of_an_empty_table(empty):
    assert token_alignment.link_statistics(empty).count() == 0


# ---------------------------------------------------------------- conversation trie

TALK = "conv_id long, turn long, role string, text string, node string, depth long"


def tried(rows):
    """Nodes of the trie over dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        key = ()
        members[key].append(c)
        for d, turn in enumerate(turns, 1):
            key = (key, turn)
            members[key].append(c)
        ends[key].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for key in members:
        if key:
            children[key[0]] += 1
    for key in sorted(members, key=depth_of, reverse=True):
        words = len(re.findall(conversation_trie.WORD, key[1][1])) if key else 0
        leaves[key] += children[key] == 0
        saved[key] += (len(members[key]) - 1) * words
        if key:
            leaves[key[0]] += leaves[key]
            saved[key[0]] += saved[key]
    return Counter((min(m), depth_of(k), min(members[k[0]]) if k else None, len(m), children[k],
                    leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k])))))
                   for k, m in members.items())


def depth_of(key):
    n = 0
    while key:
        key, n = key[0], n + 1
    return n


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TALK).repartition(5)


def chatter(seed=3):
    """Ordinary, copied, nested, very long and awkward conversations."""
    rng = random.Random(seed)
    rows = []
    for c in range(130):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]),
                         rng.choice(["yes", "no then", " a  b\tc", ""]) * rng.randint(1, 2)))
    for k in range(60):                                # nested prefixes of one conversation
        rows += [(1000 + 20 * k, t, "user", f"step {t}") for t in range(k + 1)]
    for c in (5000, 5001, 5003):                       # more turns than one bucket holds
        rows += [(c, t, "user", f"long {t} of it") for t in range(1, 620 + c % 3)]
    rows += [(5020, None, "user", "x"), (5020, None, "bot", "x"), (5020, 3, None, None),
             (5020, 3, None, None), (5020, -5, "user", "before"), (-7, 0, "user", "minus"),
             (-7, 1, "user", "minus"), (-20, 1, "user", "block"), (-20, 2, "user", "block"),
             (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(7000 + i, t, "user", "same words here") for i in range(300) for t in range(4)]
    rng.shuffle(rows)
    return rows


def test_trie_against_whole_prefixes(spark, tmp_path):
    rows = chatter()
    talk(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_rows(queries.op12_conversation_trie(spark, str(tmp_path))) == tried(rows)


@pytest.mark.parametrize("bucket, share", [(2, 3), (5, 10_000)])
def test_trie_with_small_buckets_and_wide_parents(spark, monkeypatch, bucket, share):
    monkeypatch.setattr(conversation_trie, "BUCKET", bucket)
    monkeypatch.setattr(conversation_trie, "HOT_SHARE", share)
    rows = [r for r in chatter(5) if not r[0] or r[0] < 1400]
    rows += [(9000, t, "user", f"t{t}") for t in range(40)]
    assert by_rows(conversation_trie.trie(talk(spark, rows))) == tried(rows)


def test_trie_of_no_conversation(spark):
    assert conversation_trie.trie(talk(spark, [])).count() == 0
    assert conversation_trie.trie(talk(spark, [(None, 1, "user", "x")])).count() == 0


def test_trie_of_a_turnless_conversation(spark):
    """One own turn, all of it before the shared ones of a block that is absent."""
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = conversation_trie.trie(talk(spark, [(conv, 1, "user", "x")])).collect()
    assert [tuple(r) for r in got] == [(conv, 0, None, 1, 0, 1, 0, sha(str(conv)))]


def test_ends_are_joined_across_batches(spark):
    ends = spark.range(25_000).select(
        F.struct((F.col("id") % 2).alias("a"), F.lit(1).cast("long").alias("b")).alias("node"),
        F.col("id").alias("conv_id"))
    got = {r[0]["a"]: r[1] for r in conversation_trie.ends_digest(ends).collect()}
    assert got == {k: sha(",".join(map(str, range(k, 25_000, 2)))) for k in (0, 1)}
