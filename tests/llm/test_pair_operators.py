"""License scan, decontamination, line dedup, archives, Jaccard join and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rolesift.llm import decontaminate, jaccard, licenses, line_dedup, warc
from rolesift.llm.common import read_blobs
from tests.llm.conftest import sentence

NOTICE = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.",
          "MIT": "Released under the MIT License."}


def find_component(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


# ---------------------------------------------------------------- licences

def test_nearest_directory_speaks(spark):
    files = [("LICENSE", NOTICE["MIT"]), ("a/x.c", "plain text"), ("a/b/LICENSE", "intro\n"
             + NOTICE["Apache-2.0"]), ("a/b/c/d/y.c", "code"), ("a/b/z.c", "/* "
             + NOTICE["MIT"] + " */"), ("ab/q.c", None), ("a/bb/r.c", ""), (None, "text"),
             (None, NOTICE["MIT"]), ("a/x.c", "plain text"), ("e/n.c", "licence to kill " * 50)]
    df = spark.createDataFrame(files, "path string, text string").withColumn("licence", F.lit(1))
    got = {(r["path"], r["licence"], r["how"], r["licence_dir"]) for r in
           licenses.scan(df).collect()}
    assert got == {
        ("LICENSE", "MIT", "notice", None), ("a/x.c", "MIT", "inherited", ""),
        ("a/b/LICENSE", "Apache-2.0", "notice", None),
        ("a/b/c/d/y.c", "Apache-2.0", "inherited", "a/b"), ("a/b/z.c", "MIT", "notice", None),
        ("ab/q.c", "MIT", "inherited", ""), ("a/bb/r.c", "MIT", "inherited", ""),
        (None, "MIT", "notice", None), (None, None, "none", None),
        ("e/n.c", "MIT", "inherited", "")}
    assert licenses.scan(df).count() == len(files)
    assert licenses.scan(df.limit(0)).count() == 0


def test_each_template_finds_itself(spark):
    rows = [(f"{n}-{k}.txt", t) for n, ts in licenses.TEMPLATES.items() for k, t in enumerate(ts)]
    files = spark.createDataFrame(rows, "path string, text string")
    found = {r["path"]: r["licence"] for r in licenses.scan_notices(files).collect()}
    marked = [p for p, t in rows if re.search(licenses.MARKER, t)]
    assert len(marked) == len(rows) and found == {p: p.rsplit("-", 1)[0] for p in marked}


# ---------------------------------------------------------------- decontamination

def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch),
                          h[i - 1, j] + gap, h[i, j - 1] + gap)
            best = max(best, h[i, j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        assert decontaminate.local_score(a, b, decontaminate.Rule())[0] == smith_waterman(a, b)


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(11)
    items = [sentence(rng, 30) for _ in range(6)] + ["two words", None, ""]
    words = [t.split() for t in items[:6]]
    edited = words[1][:]
    for k in (4, 11, 19, 26):
        edited[k] = "changed"
    gone = words[2][:9] + words[2][12:]
    moved = words[3][:14] + ["some", "more", "words"] + words[3][14:]
    upper = re.sub("[a-z]", lambda m: m[0].upper(), items[0])
    bodies = {10: upper, 11: " ".join(edited), 12: "; ".join(gone), 13: " ".join(moved),
              14: " ".join(words[4][:8]), 15: sentence(rng, 20), 17: "only two, Words!", 19: " Two words! ",
              18: " ".join([sentence(rng, 9000), items[0], sentence(rng, 9000)])}
    rows = [(i, f"{sentence(rng, 40)}\n{b}\n{sentence(rng, 40)}") for i, b in bodies.items()]
    rows += [(100 + i, sentence(rng, 120)) for i in range(40)] + [(1, None), (2, ""), (None, None)]
    rows += [(500 + i, f"{sentence(rng, 10)} {items[5]}") for i in range(60)]  # a hot passage
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows],
                                 "doc_id long, text string, score double").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_edited_copies_are_found_and_clean_documents_left(leaks):
    docs, items = leaks
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in
             decontaminate.find(docs, items).collect()}
    assert set(found) == {(10, 0), (11, 1), (12, 2), (13, 3), (18, 0), (19, 6),
                          *((500 + i, 5) for i in range(60))}
    assert found[10, 0] == 1 and found[18, 0] == 1 and 0.7 < found[11, 1] < 1
    small = decontaminate.Rule(block_words=40)
    assert {(r["doc_id"], r["item_id"]) for r in
            decontaminate.find(docs, items, small).collect()} == set(found)
    kept = decontaminate.clean(docs, items, small)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len({d for d, _ in found})


def test_every_pair_that_a_full_alignment_finds(leaks):
    """Without seeds: each whole text against each item."""
    docs, items = leaks
    words = lambda t: [w.lower() for w in re.findall(
        r"[^\x20\x09-\x0D\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", t or "")]
    rule, want = decontaminate.Rule(), {}
    number = defaultdict(lambda: len(number))
    code = lambda t: np.array([number[w] for w in words(t)], np.int64)
    for d in docs.filter("doc_id < 505").collect():
        for i in items.filter("item_id < 6").collect():
            item = code(i["text"])
            raw, _ = decontaminate.local_score(item, code(d["text"]), rule)
            if raw >= rule.threshold * rule.match * len(item):
                want[d["doc_id"], i["item_id"]] = round(raw / (rule.match * len(item)), 6)
    found = decontaminate.find(docs.filter("doc_id < 505"), items.filter("item_id < 6"))
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in found.collect()} == want


def test_an_excerpt_of_a_long_item_and_ties(spark):
    rng = random.Random(13)
    item = sentence(rng, 400).split()
    rows = [(1, f"{sentence(rng, 80)} {' '.join(item[120:270])} {sentence(rng, 80)}"),
            (2, f"{sentence(rng, 80)} {' '.join(item[:30])} {sentence(rng, 80)}"),
            (1, f"{sentence(rng, 80)} {' '.join(item[120:270])} {sentence(rng, 80)}"),
            (None, " ".join(item[300:360]))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item)), (8, " ".join(item))],
                                  "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, items).collect())
    assert got == Counter({(1, 9): 4, (1, 8): 4, (None, 9): 2, (None, 8): 2})
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {2}


def test_no_items_and_no_documents(leaks):
    docs, items = leaks
    assert decontaminate.find(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.find(docs.limit(0), items).count() == 0


# ---------------------------------------------------------------- line dedup

def spans_of(text):
    """Line spans of the rule, from its description: chunks between marks, windows of 50 words."""
    signed = lambda h: h - (h >> 63 << 64)
    held = text.split("\n")
    words = [len(re.findall(r"[^ \t\n\x0b\f\r]+", x)) for x in held]
    codes = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in held]
    out, begin = set(), 0
    for i in range(len(held)):
        h = 42
        for c in codes[max(i - 1, 0):i + 1]:
            h = xxhash.xxh64(struct.pack("<q", c), seed=h).intdigest()
        if signed(h) % 3 == 0 or i == len(held) - 1:
            if i + 1 - begin >= 2 and any(words[begin:i + 1]):
                out.add((begin, i + 1))
            begin = i + 1
    at = [i for i, n in enumerate(words) if n]
    for step in (1, -1):
        for k in range(len(at)):
            total = 0
            for j in range(k, len(at) if step > 0 else -1, step):
                total += words[at[j]]
                if total >= 50:
                    out.add((min(at[k], at[j]), max(at[k], at[j]) + 1))
                    break
    return out


def without_repeats(rows):
    order = lambda i, t: (i is None, i or 0, signed_hash(t))
    places = defaultdict(list)
    for i, t in {r for r in rows if r[1] is not None}:
        for a, b in spans_of(t):
            places["\n".join(t.split("\n")[a:b])].append((order(i, t), a, b, (i, t)))
    dead = defaultdict(set)
    for found in places.values():
        first = min(found)
        for f in found:
            if f[:2] != first[:2]:
                dead[f[3]] |= set(range(f[1], f[2]))
    return [(i, t if t is None else "\n".join(
        x for k, x in enumerate(t.split("\n")) if k not in dead[(i, t)])) for i, t in rows]


def signed_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (h >> 63 << 64)


def test_removed_passages_against_brute_force(docs, texts):
    out = line_dedup.remove(docs)
    assert out.columns == docs.columns
    want = without_repeats(texts)
    assert Counter(map(tuple, out.select("doc_id", "text").collect())) == Counter(want)
    assert sum(a != b for a, b in zip(texts, want)) >= 7


def test_rows_without_or_with_shared_ids_keep_their_own_lines(spark):
    rng = random.Random(11)
    passage = "\n".join(sentence(rng, 30) for _ in range(4))
    own = [sentence(rng, 60) for _ in range(7)]
    rows = [(1, f"{own[0]}\n{passage}"), (None, f"{passage}\n{own[1]}\n{own[2]}"),
            (None, f"{own[3]}\n{own[4]}\n{passage}"), (None, own[5]), (1, f"{passage}\n{own[6]}"),
            (None, None), (None, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, line_dedup.remove(docs).collect()))
    assert got == Counter(without_repeats(rows))
    left = " ".join(t or "" for _, t in got)
    assert all(x in left for x in own) and sum(passage in (t or "") for _, t in got) == 1


def test_boundaries_resist_shifts(spark):
    rng = random.Random(1)
    shared = [sentence(rng, 8) for _ in range(40)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["new", *shared])),
            (3, "\n".join([*shared[:20], "new", *shared[20:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: len(r["text"].split("\n")) for r in line_dedup.remove(docs).collect()}
    assert left[1] == 40 and left[2] < 16 and left[3] < 20


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_a_passage_goes_whole_between_other_lines(spark, size):
    rng = random.Random(size)
    own = lambda: [sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
    rows, want = [], []
    for k in range(25):
        passage = [sentence(rng, 55 // size + rng.randint(1, 9)) for _ in range(size)]
        if size > 2:
            passage[-1] = "end of it"
            passage[0] += sentence(rng, 55)
        for i in (2 * k, 2 * k + 1):
            before, after = own(), own()
            rows.append((i, "\n".join(before + passage + after)))
            want.append((i, "\n".join(before + passage * (i % 2 == 0) + after)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, line_dedup.remove(docs).collect())) == want


def test_line_dedup_of_nothing(empty):
    assert line_dedup.remove(empty).collect() == []


# ---------------------------------------------------------------- archives

def records(*payloads):
    return [warc.ArcRecord(f"http://x/{i}", "20010203040506", "",
                           b"HTTP/1.1 200 OK\r\nX-Record-Key: %d\r\n\r\n" % i + p)
            for i, p in enumerate(payloads)]


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_parses_by_declared_length(version):
    payloads = [b"", b"a\n\nhttp://fake 0.0.0.0 20000101000000 text/html 3\nabc", b"\xff\x00\r\n" * 9]
    data = warc.write_arc("f.arc", version, records(*payloads))
    for image in (data, gzip.compress(data)):
        got = [r for _, r in warc.parse_arc(image)]
        assert [r.split()[1] for r in got] == payloads and {r.version for r in got} == {version}
        assert [r.key() for r in got] == [0, 1, 2]
    for broken in (data[:-20], data.replace(b"20010203040506", b"2001 0203"), b"no arc\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


def test_dates():
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.iso_date("200102") == "2001-02-01T00:00:00Z"
    assert warc.iso_date("-") == "1970-01-01T00:00:00Z"


def test_binary_archives_round_trip(spark, tmp_path):
    payloads = [bytes(range(256)) * 40, b"\x1f\x8b\x00", bytes(range(256)) * 40, b""]
    arcs = spark.createDataFrame(
        [("f.arc", bytearray(warc.write_arc("f.arc", "2", records(*payloads))))],
        "path string, content binary")
    path = str(tmp_path / "warc")
    warc.convert(arcs, path)
    got = {r["key"]: r for r in warc.read_archives(spark, path).collect()}
    sha = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    assert [(got[i]["payload_bytes"], got[i]["payload_digest"]) for i in range(4)] \
        == [(len(p), sha(p)) for p in payloads]
    assert [got[i]["record_type"] for i in range(4)] == ["response", "response", "revisit",
                                                         "response"]
    assert got[2]["refers_to"] == 0 and got[0]["warc_date"] == "2001-02-03T04:05:06Z"
    assert len({r["record_id"] for r in got.values()}) == 4
    files = read_blobs(spark, path).collect()
    assert sum(gzip.decompress(bytes(f["content"])).count(b"WARC-Type: response")
               for f in files) == 3


def test_pages_with_awkward_rows(spark):
    rows = [(5, "http://a b", "x"), (2, None, "x"), (9, "u", None), (3, "u", ""), (7, "u", "y"),
            (7, "u", "x"), (None, "u", "x"), (None, "v", "z"), (2, None, "x"),
            (11, "u", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows],
                                  "page_id long, url string, html string, original int")
    got = sorted(((r["key"], r["payload_bytes"], r["record_type"], r["refers_to"])
                  for r in warc.pages_round_trip(pages).collect()), key=repr)
    assert got == sorted([
        (5, 1, "revisit", 2), (2, 1, "response", None), (2, 1, "response", None),
        (9, 0, "revisit", 3), (3, 0, "response", None), (7, 1, "response", None),
        (7, 1, "revisit", 2), (None, 1, "revisit", 2), (None, 1, "response", None),
        (11, 600_000, "response", None)], key=repr)
    assert warc.pages_round_trip(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- Jaccard join

def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else \
        {tuple(w)} - {()}


def components_of(rows, n, percent):
    """Documents, known by id and text, to their sets and components."""
    sets = {r: shingles(r[1], n) for r in rows}
    known = [*sets]
    pairs = [(a, b) for k, a in enumerate(known) for b in known[:k] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    number = {r: k for k, r in enumerate(known)}
    comp = find_component([(number[a], number[b]) for a, b in pairs], range(len(known)))
    return sets, {r: comp[k] for r, k in number.items()}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_components_against_all_pairs(docs, texts, n, percent):
    sets, comp = components_of(texts, n, percent)
    members = defaultdict(list)
    for r, k in comp.items():
        members[k].append(r)
    name = {k: min((i for i, _ in m if i is not None), default=None) for k, m in members.items()}
    rule = jaccard.Rule(n=n, percent=percent, frequent_least=2)
    got = Counter(map(tuple, jaccard.join(docs, rule).collect()))
    assert got == Counter((r[0], len(sets[r]), name[comp[r]]) for r in texts)
    if n == 5:
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns
        rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
        assert len(rows) == len(members) and sorted(comp[r] for r in rows) == sorted(members)
        assert all(r[0] == name[comp[r]] for r in rows)


def test_unrelated_rows_without_ids_all_stay(spark):
    rng = random.Random(12)
    own = [sentence(rng, 60) for _ in range(5)]
    rows = [(None, own[0]), (None, own[1]), (None, own[2]), (2, own[3]), (2, own[4]),
            (None, own[2]), (2, own[4]), (7, own[0]), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, jaccard.join(docs, jaccard.Rule(n=5, percent=80)).collect()))
    assert got == Counter([(None, 56, 7), (7, 56, 7), (None, 56, None), (None, 56, None),
                           (None, 56, None), (2, 56, 2), (2, 56, 2), (2, 56, 2), (None, 0, None),
                           (None, 0, None)])
    kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
    assert sorted(kept, key=repr) == sorted(
        [(7, own[0]), (None, own[1]), (None, own[2]), (2, own[3]), (2, own[4]), (None, None),
         (None, "")], key=repr)


def test_chain_of_copies_is_one_component(spark):
    rng = random.Random(4)
    words = sentence(rng, 60).split()
    rows = []
    for i in range(40):  # each differs from the next by one word, the ends by all
        rows.append((i, " ".join(words)))
        words[i] = f"new{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["component_id"] for r in jaccard.join(docs).collect()} == {0}


def test_jaccard_of_nothing(empty):
    assert jaccard.join(empty).collect() == [] and jaccard.keep_one(empty).collect() == []


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(8)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (45, 2))]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    nodes = {x for a, b in pairs for x in (a, b) if a != b}
    want = find_component(pairs, range(60))
    assert {k: got.get(k, k) for k in nodes} == {k: want[k] for k in nodes}


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    leak = docs.filter("doc_id = 9").first()["text"]
    spark.createDataFrame([(0, " ".join(leak.split()[:25])), (1, None)],
                          "item_id long, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage, ids = docs, {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        ids[name] = {r["doc_id"] for r in stage.select("doc_id").collect()}
    assert set(range(30)) <= ids["quality_rules"] and not {400, 401, 408} & ids["quality_rules"]
    assert ids["line_dedup"] == ids["quality_rules"]
    assert ids["jaccard_join"] & {0, 100, 104, 108} == {0}
    assert ids["decontamination"] == ids["jaccard_join"] - {9}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id.dropna()) == {i for i in ids["decontamination"] if i is not None}
