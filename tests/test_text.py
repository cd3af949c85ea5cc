import random

from pyspark.sql import functions as F

from rolesift.config.model import ScoringConfig, function_titles
from rolesift.functions import text as X

PHRASES = ["vp", "vp analyst", "svp", "contract", "contractor", "contract-to-hire", "a", "ab",
           "abc", "b c", "501(c)(3)", "10x", "lgbtq+", "50% coding", "c"]


def brute(text, phrases):
    return {p for p in phrases if p in text}


def random_texts(n=300):
    rng = random.Random(7)
    parts = PHRASES + [" ", "x", "abcab", "con", "tract", "(c)", "+", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_find_phrases_equals_brute_force(values):
    texts = random_texts()
    got = values("t string", [(t,) for t in texts], X.find_phrases(F.col("t"), PHRASES))
    for t, found in zip(texts, got):
        assert set(found) == brute(t, PHRASES), t
        assert len(found) == len(set(found))


def test_large_lists_agree_with_small_ones(values):
    texts = random_texts(100) + [None]
    many = PHRASES + [f"zz{i}" for i in range(40)]
    got = values("t string", [(t,) for t in texts], X.any_of(F.col("t"), many),
                 X.count_of(F.col("t"), many),
                 X.first_phrase(F.col("t"), many),
                 X.any_of(X.Found(X.find_phrases(F.col("t"), many)), PHRASES[:3]))
    for t, (hit, n, first, some) in zip(texts, got):
        want = [p for p in many if t is not None and p in t]
        assert hit == bool(want)
        assert n == len(set(want))
        assert first == (want[0] if want else None)
        assert some == any(t is not None and p in t for p in PHRASES[:3])


def test_longest_phrase_is_word_bounded_and_leftmost_longest(values):
    phrases = ["senior engineer", "machine learning engineer", "engineer", "data science",
               "data science manager", "ml engineer"]
    titles = ["senior engineering manager", "senior machine learning engineer",
              "data science manager, growth", "reengineer", "ml engineer / engineer", ""]
    want = ["", "machine learning engineer", "data science manager", "", "ml engineer", ""]
    rows = [(t,) for t in titles]
    assert values("t string", rows, X.longest_phrase(F.col("t"), phrases)) == want
    assert values("t string", rows, X.longest_phrase_ngrams(F.col("t"), phrases)) == want


def test_buckets_keep_configuration_order(values):
    buckets = {"late": ["b"], "early": ["a"], "none": ["q"]}
    got = values("t string", [("ab",), ("a",), ("",)], X.which_of(F.col("t"), buckets),
                 X.first_of(F.col("t"), buckets))
    assert got == [(["late", "early"], "late"), (["early"], "early"), ([], None)]


def test_dilution_needs_a_prefix_before_the_phrase(values):
    rows = [("associate 3d design director",), ("design director",), ("design director, visual ",),
            ("lead design director",)]
    got = values("t string", rows, X.is_diluted(F.col("t"), F.lit("design director"),
                                                ["associate ", "3d ", "visual "]))
    assert got == [True, False, False, False]


def test_patterns_stop_at_line_feeds_only(values):
    rows = [("hybrid in nyc",), ("hybrid\nnyc",), ("HYBRID\rNYC",), (None,)]
    assert values("t string", rows, X.any_pattern(F.col("t"), [r"\bhybrid\b.*\bnyc\b"])) == \
        [True, False, True, False]


def test_build_text_variants(values):
    got = values("a string, b string", [("A", None), ("", "B"), (None, None)],
                 X.build_text(F.col("a"), F.col("b")),
                 X.build_text(F.col("a"), F.col("b"), keep_empty=True))
    assert got == [("a", "a "), ("b", " b"), ("", " ")]


def test_function_titles_follow_the_rule():
    titles = function_titles(["x", "y"], ["r"], ["z", "x r"])
    assert titles == ["x r", "y r", "z"]
    assert "software engineer" in ScoringConfig().function_titles
