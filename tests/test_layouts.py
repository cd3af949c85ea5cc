"""Substring joins, the stored gram index, bucketed tables and index tables."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalog import bindings as B
from catalog.layout_queries import bucketed, bucketed_join
from rolesift.operators import layouts as L
from rolesift.operators import substrings as SS

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_substrings_against_every_pair(spark):
    rng = random.Random(1)
    letters = "abcé 日😀."
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
             for i in range(150)]
    texts += [(None, "abc abc"), (200, None), (201, ""), (1, "zz abc"), (202, "ab" * 20_000)]
    phrases = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(300)}
    phrases |= {"never here", "abab", "zz"}
    got = SS.substring_matches(
        spark.createDataFrame(texts, "id long, t string"),
        spark.createDataFrame([(p,) for p in phrases] + [("zz",), (None,)], "phrase string"),
        "id", "t")
    want = {(i, p) for i, t in texts if t for p in phrases if p in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_substrings_of_empty_tables(spark):
    texts = spark.createDataFrame([(1, "abc")], "id long, t string")
    words = spark.createDataFrame([("b",)], "phrase string")
    assert SS.substring_matches(texts, words.limit(0), "id", "t").count() == 0
    assert SS.substring_matches(texts.limit(0), words, "id", "t").count() == 0
    with pytest.raises(ValueError):
        SS.substring_matches(texts, spark.createDataFrame([("",)], "phrase string"), "id", "t")


def test_substring_counts_by_ranges_without_shuffled_pairs(spark, monkeypatch):
    monkeypatch.setattr(SS, "HELD_PHRASES", 40)
    monkeypatch.setattr(SS, "BLOCK", 50)
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abé 😀") for _ in range(rng.randint(0, 40))))
             for i in range(90)] + [(7, "ab abab"), (500, None)]
    phrases = {"".join(rng.choice("abé 😀") for _ in range(rng.randint(1, 7))) for _ in range(200)}
    df = SS.substring_counts(spark.createDataFrame(texts, "id long, t string"),
                             spark.createDataFrame([(p,) for p in phrases], "phrase string"),
                             "id", "t")
    want = {p: [i for i, t in texts if t and p in t] for p in phrases}
    assert {tuple(r) for r in df.select("phrase", "texts", "first").collect()} == {
        (p, len(i), min(i)) for p, i in want.items() if i}
    # Counts combine below the only shuffle of a range.
    text = plan(df)
    assert "Union" in text and "Join" not in text
    assert text.count("Exchange") == text.count("partial_count")


def test_a_dictionary_of_any_size_reads_the_texts_once(spark, monkeypatch):
    monkeypatch.setattr(SS, "HELD_PHRASES", 30)
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcd") for _ in range(80))) for i in range(60)]
    phrases = {t[k:k + 1 + k % 9] for _, t in texts for k in range(0, 70, 7)}
    assert len(phrases) > 10 * SS.HELD_PHRASES
    rows = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for find in (SS.substring_counts, SS.substring_matches):
        df = find(spark.createDataFrame(texts, "id long, t string"), rows, "id", "t")
        assert plan(df).count("MapInArrow") == 1
        n = df.agg(F.sum("texts")).first()[0] if "texts" in df.columns else df.count()
        assert n == sum(p in t for _, t in texts for p in phrases)


@pytest.mark.parametrize("letters", ["ab", "abé\0 😀", "".join(map(chr, range(0x4E00, 0x4F40)))])
@pytest.mark.parametrize("kept", [64, 3])
def test_runs_of_texts_equal_sets_of_runs(monkeypatch, letters, kept):
    """Also where different runs have one hash, of which ``kept`` bits are left."""
    of, mask = SS.Windows.of, np.uint64((1 << 64) - (1 << 64 - kept))
    monkeypatch.setattr(SS.Windows, "of", lambda self, n: of(self, n) & mask)
    monkeypatch.setattr(SS, "BLOCK", 100)
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    texts[3:3] = ["", texts[0], "a" * 300, "a\0b"]
    sizes = [1, 2, 3, 8, 11, 20]
    got = {}
    for runs, count, rows in SS._met(texts, SS.Bits(sizes, np.full(8, 255, np.uint8))):
        ends = np.cumsum(count).tolist()
        for run, low, high in zip(runs.to_pylist(), [0, *ends], ends, strict=False):
            assert run not in got
            got[run] = rows[low:high].tolist()
    want = {}
    for k, text in enumerate(texts):
        for run in {text[i:i + n] for n in sizes for i in range(len(text) - n + 1)}:
            want.setdefault(run, []).append(k)
    assert got == want


def test_a_handful_of_phrases_is_matched_where_texts_are_read(spark):
    rows = [(i, f"lead ({i}) of vp") for i in range(50)] + [(3, "of zz"), (None, "of"), (60, None)]
    df = SS.substring_matches(spark.createDataFrame(rows, "id long, t string"),
                              spark.createDataFrame([(" of ",), ("of",), ("3)",), (None,)],
                                                    "phrase string"), "id", "t")
    assert "Join" not in plan(df)
    assert sorted(map(str, df.collect())) == sorted(str(Row(id=i, phrase=p)) for i, p in {
        (i, p) for i, t in rows if t for p in (" of ", "of", "3)") if p in t})


def test_substring_join_is_an_equality_join(spark):
    df = SS.substring_matches(
        B.table(spark, DIR, "documents"),
        spark.createDataFrame([("tion",), ("the ",), ("x",)], "phrase string"), "doc_id", "text")
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    rows = [(i, f"posting {i} of company{i % 7} in town{i % 50}") for i in range(3000)]
    rows += [(5000, None), (5001, ""), (None, "posting without id town7x"), (5002, "ab")]
    df = spark.createDataFrame(rows, "job int, hay string")
    SS.build_gram_index(df, "job", F.col("hay"), root, parts=32, files=2)
    return root, rows


@pytest.mark.parametrize("needle", ["town49", "posting 12", "g 2999 of", "absent", "ab", "", "7x",
                                    "in town7"])
def test_index_search_equals_a_scan(spark, index, needle):
    root, rows = index
    got = sorted((str(r["id"]), r["text"]) for r in
                 SS.search_gram_index(spark, root, needle, parts=32).collect())
    assert got == sorted((str(i), t or "") for i, t in rows if needle in (t or ""))


def test_index_search_reads_few_folders(spark, index):
    root, _ = index
    df = SS.search_gram_index(spark, root, "g 2999 of", parts=32)
    text = plan(df)
    assert text.count("dynamicpruning") >= 1 and "part#" in text
    lists = spark.read.parquet(f"{root}/grams")
    assert lists.where("part IN (1, 2)").count() < lists.count() / 4


def test_gram_lists_equal_sets_of_grams():
    rng = random.Random(4)
    texts = ["", "ab", "abcabc", "new york\nnew", "\U0001F600\u00e9x\0y" * 2] + [
        "".join(rng.choices("ab \u4e2d\U0001F600", k=rng.randint(0, 30))) for _ in range(300)]
    texts.append("".join(chr(0x100 + i) for i in range(20_000)))
    for q in (1, 2, 3, 7):
        got = dict()
        found, ends, places = SS._gram_lists(texts, q)
        for gram, low, high in zip(found, [0, *ends], ends):
            got[gram] = places[low:high].tolist()
        want = {}
        for n, text in enumerate(texts):
            for gram in {text[i:i + q] for i in range(len(text) - q + 1)}:
                want.setdefault(gram, []).append(n)
        assert got == want


def test_index_shuffles_lists_and_not_entries(spark, index):
    root, rows = index
    lists = spark.read.parquet(f"{root}/grams")
    entries = sum(len({t[i:i + 3] for i in range(len(t) - 2)}) for _, t in rows if t)
    assert lists.agg(F.sum(F.size("places"))).first()[0] == entries and "id" not in lists.columns
    assert lists.count() < entries / 2


def scanned(df, metric="numFiles"):
    """A metric of the scan after the query has run."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply(metric).value()


def test_bucketed_tables_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = bucketed_join(spark, DIR)
        text = plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert df.count() == B.postings(spark, DIR).count()


def test_a_lookup_reads_one_bucket(spark):
    table = bucketed(spark, B.companies(spark, DIR), "company_name_normalized")
    df = table.where("company_name_normalized = 'customer#000000042'")
    whole = scanned(table, "numOutputRows")
    assert 0 < scanned(df, "numOutputRows") < whole / 4 and df.count() == 1


def test_index_reads_are_pruned(spark, tmp_path):
    rows = B.postings(spark, DIR).withColumns({
        "score": (F.col("k") % 101).cast("int"), "track": F.concat(F.lit("T"), F.col("k") % 3),
        "score_posted": F.format_string("%04d#x", (F.col("k") % 101).cast("int"))})
    total = rows.count()
    for index in L.LAYOUTS:
        L.write_index(rows, index, f"{tmp_path}/{index}")
        stored = L.read_index(spark, index, f"{tmp_path}/{index}")
        assert stored.count() == total
        layout = L.LAYOUTS[index]
        assert set(stored.columns) == {*L.project_index(rows, index).columns, *layout.folders}
    everything = scanned(spark.read.parquet(f"{tmp_path}/company"))
    one = spark.read.parquet(f"{tmp_path}/company").where("part = 3")
    assert scanned(one) < everything / 8
    one = spark.read.parquet(f"{tmp_path}/source").where("of_source = 'lever' AND year >= 1999")
    assert scanned(one) < scanned(spark.read.parquet(f"{tmp_path}/source")) / 2
    text = plan(L.by_status(spark, f"{tmp_path}/score", "active", after=("0050#x", "k")))
    assert "of_status" in text.split("PartitionFilters")[1] \
        and "LessThanOrEqual(score_posted" in text


def test_index_pages_follow_each_other(spark, tmp_path):
    rows = B.postings(spark, DIR).withColumns({
        "score": F.lit(1), "track": F.lit("T"),
        "score_posted": F.format_string("%04d#x", (F.col("k") % 5).cast("int"))})
    L.write_index(rows, "track", f"{tmp_path}/t")
    seen, after = [], None
    while page := L.by_track(spark, f"{tmp_path}/t", "T", 400, after).collect():
        seen += [r["job_id"] for r in page]
        after = (page[-1]["score_posted"], page[-1]["job_id"])
    assert len(seen) == len(set(seen)) == rows.count()
