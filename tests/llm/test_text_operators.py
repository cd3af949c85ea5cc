"""Quality rules, token counts, token files, packing and language-model scores."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolesift.llm import packing, pseudo_lm, quality, token_counts, token_files
from rolesift.llm.common import Words
from rolesift.llm.tokens import SpacedIds, spaced_ids, tokenizer

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ids_of(text):
    return np.array(tokenizer(BYTE).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def base_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    held = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(held) - len(set(held)), len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(i, 1, 0) for i in range(20)] + [(400, 0, 0), (401, 0, 1), (None, 1, 0)],
        "doc_id long, quality int, toxic int")


def test_word_hashes_equal_only_for_equal_words():
    words = [f"w{i}" for i in range(5000)] + ["ab", "ba", "a", "b"]
    text = " ".join(words)
    w = Words(pa.array([text, None, "", text]))
    assert np.diff(w.first).tolist() == [len(words), 0, 0, len(words)]
    assert len(np.unique(w.hash)) == len(words)
    assert (w.hash[:len(words)] == w.hash[len(words):]).all()


def test_words_of_a_sliced_column_with_nulls():
    column = pa.array(["x y", None, "y  z\t", "", "q"]).slice(1)
    w = Words(column)
    assert np.diff(w.first).tolist() == [0, 2, 0, 1]


def test_quality_measures_and_ratio(docs, texts, labels):
    rules = quality.Rules(buckets=256)
    model = quality.fit(docs, labels, rules)
    got = rows_of(quality.score(docs, model, rules), "doc_id", "n_words", "word_chars",
                  "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *base_measures(t)) for i, t in texts), key=repr)

    raw, good = Counter(), Counter()
    trusted = set(range(20))
    for i, t in texts:
        w = Words(pa.array([t], pa.string()))
        bucket, _ = quality.features(w, rules)
        raw.update(bucket.tolist())
        good.update(bucket.tolist() if i in trusted else [])
    for i, t in texts[:5]:
        bucket, _ = quality.features(Words(pa.array([t])), rules)
        want = np.mean([np.log((good[b] + 1) / (sum(good.values()) + 256))
                        - np.log((raw[b] + 1) / (sum(raw.values()) + 256)) for b in bucket])
        assert quality.measure(pa.array([t]), model, rules)[-1][0].as_py() == pytest.approx(want)
    kept = {r["doc_id"] for r in quality.keep(docs, model, rules).collect()}
    assert trusted <= kept and not kept & {400, 401, 402, 403, 408}
    assert quality.keep(docs, model, rules).columns == docs.columns


def test_quality_threshold_rejects_labelled_bad_documents(spark):
    rng = np.random.default_rng(2)
    text = lambda a, b, n: " ".join(f"w{k}" for k in rng.integers(a, b, n))
    rows = [(i, text(0, 12, 80)) for i in range(200)]
    rows += [(200 + i, f"{text(0, 12, 80)} {text(12, 52, 8)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(
        [(i, int(i < 200), int(i % 40 == 0 and i >= 200)) for i in range(240) if i % 2 == 0],
        "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep(docs, quality.fit(docs, marks)).collect()}
    assert set(range(0, 200, 2)) <= kept and not kept & set(range(200, 240, 2))


def test_quality_threshold_keeps_the_share_and_uses_the_gap():
    trusted = np.arange(2000) / 1000
    find = quality.threshold
    assert find(trusted, np.array([-3.0, -1.0])) == pytest.approx((0.002 - 1) / 2)
    assert find(trusted, np.array([0.5])) == pytest.approx(0.002)
    assert find(trusted, np.empty(0)) == pytest.approx(0.002 - 0.25)


def test_quality_model_is_fitted_to_all_labelled_documents(spark):
    n = 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", """array_join(transform(sequence(0, 24),
        j -> concat('w', (id * (j + 3) + j * j) % 997)), ' ') AS text""")
    ids = spark.range(n)
    trusted = ids.selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    # All documents are trusted, so both multinomials are one.
    assert not quality.fit(docs, trusted).ratio.any()

    every = docs.unionAll(docs.selectExpr("doc_id + 100000", "concat(text, ' bad', doc_id % 50)"))
    marks = trusted.unionAll(ids.selectExpr("id + 100000", "0", "0"))
    model = quality.fit(every, marks)
    got = quality.score(every, model).filter("NOT base_failed").toPandas()
    own = got.doc_id < 100_000
    assert len(got) == 2 * n
    assert model.threshold == quality.threshold(got.llr[own].to_numpy(), got.llr[~own].to_numpy())


@pytest.mark.parametrize("scale", [1.0, 1e-12])
def test_place_in_sorted_scores(spark, scale):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), rng.normal(size=3000) * 1e-9,
                             np.full(500, -0.25), [1e6, -1e6, 0.0]]) * scale
    df = spark.createDataFrame([(float(v),) for v in values], "llr double").repartition(3)
    for k in (0, 6, 1500, 3000, 3300, len(values) - 1):
        assert quality.nth(df, k) == np.sort(values)[k]


def test_quality_without_rows(empty, docs, labels):
    model = quality.fit(empty, labels)
    assert quality.score(empty, model).count() == 0 and quality.keep(empty, model).count() == 0
    model = quality.fit(docs, labels.limit(0))
    assert not model.ratio.any() and quality.keep(docs, model).count() > 0


def test_token_counts_match_the_library(docs, texts):
    library = tokenizer(WORD)
    got = rows_of(token_counts.count_texts(docs, limit=100), "doc_id", "n_bytes", "n_tokens",
                  "over_limit")
    want = []
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)


def test_every_prefix_has_its_exact_count(texts):
    library, counter = tokenizer(WORD), token_counts.counter(WORD)
    for text in [t for _, t in texts[:3]] + ["a  b\n\n c ", "it's <|endoftext|>x", "İß éa", ""]:
        found = counter.prefixes([text])[0]
        true = [len(library.encode(text[:k], add_special_tokens=False))
                for k in range(len(text) + 1)]
        assert [found.at(k) for k in range(len(text) + 1)] == true
        for budget in (0, 1, 5, 1000):
            assert found.longest(budget) == max(k for k, n in enumerate(true) if n <= budget)


def test_prefixes_of_awkward_texts():
    """Accents that compose, characters that normalise to two, cut special strings."""
    library, counter = tokenizer(WORD), token_counts.counter(WORD)
    rng = random.Random(2)
    signs = ["a", "B", "the", "é", "e\u0301", "日", "0", "😀", "!", "!!", "'", "'s", "'re", "=",
             "<|endoftext|>", "<|", "|>", "\t", "\n", " ", "  ", "İ", "한", "\u1112", "\u1161",
             "\u11ab", "\u0338", "xxxxx", "\xa0", "'ll"]
    for n in range(600):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) * (1 + 7 * (n % 5 == 0))
        found = counter.prefixes([text])[0]
        true = [len(library.encode(text[:k], add_special_tokens=False))
                for k in range(len(text) + 1)]
        assert [found.at(k) for k in range(len(text) + 1)] == true, text
        for budget in (0, 1, 3, 7, 20):
            assert found.longest(budget) == max(k for k, c in enumerate(true) if c <= budget)


@pytest.mark.parametrize("part", ["ab3", "日本語中文", "=", "é", "qZ9/+"])
def test_long_texts_without_spaces_are_cut_in_time(part):
    library, counter = tokenizer(WORD), token_counts.counter(WORD)
    text = part * (100_000 // len(part))
    found = counter.prefixes([text])[0]
    start = time.process_time()
    n = found.longest(2048)
    assert time.process_time() - start < 10          # every prefix alone took minutes
    count = lambda k: len(library.encode(text[:k], add_special_tokens=False))
    assert count(n) <= 2048 and (n == len(text) or count(n + 1) > 2048)


def test_pieces_give_the_ids_of_whole_texts(texts):
    odd = ["", " ", "  a", "a  b c", "a <|endoftext|> b", "\n\n a \n b", "tab\t x y", "ends  ",
           "a  b c", "a\x1c b \x1d c", "e ́x y"] + [t or "" for _, t in texts]
    for text, ids in zip(odd, spaced_ids(BYTE).encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1].tolist()


def test_words_are_encoded_once_whatever_closes_them(monkeypatch):
    class Counting:
        def __init__(self, library):
            self.library, self.words = library, 0

        def encode_batch_fast(self, texts, **options):
            self.words += sum(len(t.split()) for t in texts)
            return self.library.encode_batch_fast(texts, **options)

    monkeypatch.setattr("rolesift.llm.tokens.CACHE_ENTRIES", 500)
    words = [f"w{chr(97 + i % 26)}{'xyz'[i % 3]}{i}" for i in range(300)]
    closed = [w + end for end in ("", ",", ".", "$$$", "?!") for w in words]
    odd = ["...", "don't.", "²,", "漢.", "a<|endoftext|>.", "é;x:", "$", "a  b.", "\nb,", "_."]
    texts = [" ".join(["head", *closed]), " ".join(["head.", *odd, *closed[::7]]), None, "",
             "x\ny, z.\nw!", *odd]
    encoder = SpacedIds(BYTE)
    encoder.library = counting = Counting(encoder.library)
    for _ in range(3):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1].tolist()
        texts.reverse()
        assert counting.words < 3 * len(words)      # each with each end were five times as many


def test_token_files_round_trip(docs, texts):
    start, want = 0, []
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None,
                                             r[1] or "")):
        ids = ids_of(t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = rows_of(token_files.round_trip(docs, shard_tokens=2000), "doc_id", "start", "n_tokens",
                  "ids_crc32")
    assert got == sorted(want, key=repr)


def test_token_files_of_nothing(empty):
    assert token_files.round_trip(empty).count() == 0


def test_codes_give_any_id_without_decoding():
    ids = np.random.default_rng(1).choice([3, 200, 300, 70_000, 2**31, 2**32 - 1], 3000)
    codes = token_files.Codes.frombytes(memoryview(token_files.Codes.of(ids).tobytes()))
    assert len(codes) == 3000 and len(codes.levels) == 4
    assert [codes[i] for i in range(0, 3000, 7)] == ids[::7].tolist()
    for a, b in [(0, 3000), (511, 513), (1000, 1000), (2999, 3000)]:
        assert codes.range(a, b).tolist() == ids[a:b].tolist()
    assert len(token_files.Codes.of(np.empty(0, np.uint32))) == 0


def test_packing_covers_every_id_once(docs, texts):
    rule = packing.Packing(capacity=64, grain=4)
    got = packing.pack(docs, rule).toPandas()
    want = Counter()
    for i, t in texts:
        ids = ids_of(t)
        for at in range(0, len(ids), 64):
            part = ids[at:at + 64]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32,
                    r.doc_tokens) for r in got.itertuples()) == want
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows.length.cumsum() - rows.length == rows.offset).all()
        assert rows.length.sum() <= 64
    assert got.sequence_id.nunique() * 64 <= got.length.sum() * 1.08 + 64


def test_packing_nothing(empty):
    assert packing.pack(empty).count() == 0


def test_column_generation_reaches_the_bound():
    histogram = {c: 40 + 13 * c % 29 for c in range(1, 33)}
    plan = packing.plan(histogram, 32)
    used = Counter()
    for sizes, counts, times in plan:
        assert (sizes * counts).sum() <= 32
        for c, n in zip(sizes.tolist(), counts.tolist()):
            used[c] += n * times
    assert used == histogram
    least = sum(c * n for c, n in histogram.items()) / 32
    assert sum(times for *_, times in plan) <= least * 1.03 + 2
    assert packing.plan({}, 32) == []


def test_language_model_beats_word_frequencies(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(x for k in rng.integers(0, 12, 60) for x in (f"a{k}", f"b{k}", f"c{k}"))
             for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(2)
    held, net = docs.filter("doc_id % 4 = 0"), pseudo_lm.Network(own_ids=36, hashed_ids=4, mask=2,
                                                                batch=32, rounds=4)
    model = pseudo_lm.train(docs.filter("doc_id % 4 <> 0"), net)
    mean = pseudo_lm.score(held, model).agg(F.avg("mean_log_prob")).first()[0]
    assert mean > -0.6 * np.log(36)  # equally frequent words: -log 36 without context


def test_language_model_scores_follow_the_definition(docs, empty):
    net = pseudo_lm.Network(own_ids=20, hashed_ids=6, width=4)
    model = pseudo_lm.train(docs, net)
    rows = [r for r in pseudo_lm.score(docs, model).collect() if r["doc_id"] in (3, 400, 401)]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        words = Words(pa.array([text[r["doc_id"]]], pa.string()), lower=True)
        ids, total = model.encode(words).tolist(), 0.0
        for i, t in enumerate(ids):
            around = [ids[j] if 0 <= j < len(ids) else net.size for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(model.params[1] + sum(model.params[0][k][a] for k, a in enumerate(around)))
            z = h @ model.params[2] + model.params[3]
            total += z[t] - np.log(np.exp(z).sum())
        assert r["log_likelihood"] == pytest.approx(total, abs=1e-2) and r["n_words"] == len(ids)
    assert pseudo_lm.score(empty, pseudo_lm.train(empty, net)).count() == 0


@pytest.mark.parametrize("rounds,mask", [(2, 8), (3, 8), (1, 4), (4, 4)])
def test_the_rounds_predict_every_position_once(texts, rounds, mask):
    net = pseudo_lm.Network(own_ids=20, hashed_ids=6, width=4, rounds=rounds, mask=mask)
    words = Words(pa.array([t for _, t in texts], pa.string()), lower=True)
    model = pseudo_lm.Model(net, np.empty(0, np.uint64), np.empty(0, int),
                            [np.zeros(s) for s in net.shapes])
    seen = []
    for turn in range(rounds):
        trainer = pseudo_lm.Trainer(model, turn)
        trainer.step = lambda: None
        trainer.add(words)
        seen += [a for around, target in trainer.held
                 for a in np.vstack([around, target]).T.tolist()]
    ids = model.encode(words)
    want = np.vstack([model.contexts(ids, words), ids]).T.tolist()
    assert sorted(seen) == sorted(want)


@pytest.mark.parametrize("share", [1e-6, 5e-3])
def test_word_probabilities_sum_to_one(docs, texts, share):
    net = pseudo_lm.Network(own_ids=20, hashed_ids=6, width=4, rounds=1, listed_share=share)
    counts = pseudo_lm.word_counts(docs)
    model = pseudo_lm.train(docs, net, counts=counts)
    words = pseudo_lm.lexicon(counts, model)
    every = Words(pa.array([" ".join(t or "" for _, t in texts)]), lower=True)
    _, at, n = np.unique(every.hash, return_index=True, return_counts=True)
    ids = model.encode(every)
    p = np.exp(words.within(every, ids, net.own_ids))[at]
    assert (p[ids[at] < 20] == 1).all()
    for k in range(20, 26):
        mine = ids[at] == k
        new = np.exp(words.rest[k - 20])
        assert p[mine].sum() + new == pytest.approx(1) and new <= p[mine].min() + 1e-12
        if share < 1e-4:
            assert p[mine] == pytest.approx(n[mine] / (n[mine].sum() + 1))
    known = docs.filter("doc_id = 3")
    odd = known.withColumn("text", F.lit(" ".join(f"zq{k}" for k in range(50))))
    means = [pseudo_lm.score(x, model, within=words).first()["mean_log_prob"] for x in (known, odd)]
    assert means[0] > means[1]


def test_gradients_are_those_of_the_loss():
    net = pseudo_lm.Network(own_ids=5, hashed_ids=2, width=3)
    rng = np.random.default_rng(0)
    params = [rng.normal(0, 0.5, s) for s in net.shapes]
    around, target = rng.integers(0, 8, (4, 50)), rng.integers(0, 7, 50)
    loss = lambda: -pseudo_lm.log_probs(params, around, target).mean()
    for p, g in zip(params, pseudo_lm.gradients(params, around, target)):
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-6
        up = loss()
        p[at] -= 2e-6
        down = loss()
        p[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[at], abs=1e-5)
