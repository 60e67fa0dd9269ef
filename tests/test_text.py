"""Text primitives and signals against fixed expectations and golden values."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillsight.functions import lexicon, text as tx
from quillsight.operators import text_signals as ts, verdicts
from quillsight.operators.text_pass import read_texts


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(("text", "n"), [("Hello world", 2), ("Hello, world!", 2), ("one-two-three", 1), ("it's a test", 3), ("", 0)])
def test_token_counts(spark, text, n):
    assert len(one(spark, text, tx.tokenize)) == n


def test_tokens(spark):
    words = one(spark, "COVID-19 is affecting B2B and B2C markets in 2024", tx.tokenize)
    assert {"COVID-19", "B2B", "B2C"} <= set(words) and "2024" not in words
    assert one(spark, "I saw a bird and x marks the spot 123 456", tx.tokenize) == "I saw a bird and marks the spot".split()
    assert one(spark, "It’s café naïve résumé", tx.tokenize) == ["It's", "café", "naïve", "résumé"]


@pytest.mark.parametrize(("text", "n"), [("Hello. World.", 2), ("Hello! World?", 2), ("One sentence", 1), ("First. Second! Third?", 3), ("", 0)])
def test_sentences(spark, text, n):
    assert len(one(spark, text, tx.split_sentences)) == n


@pytest.mark.parametrize(("text", "yes"), [("123", True), ("0", True), ("", False), ("abc", False), ("12a", False), ("a12", False), ("1.5", False)])
def test_numeric(spark, text, yes):
    assert one(spark, text, tx.is_numeric) is yes


def test_common_words(spark):
    rows = spark.createDataFrame([(w,) for w in "the a is are and but it for algorithm quantum serendipity xylophone ephemeral".split()], "w string")
    assert [r.x for r in rows.select(tx.is_common_word(F.col("w")).alias("x")).collect()] == [True] * 8 + [False] * 5


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("hello", 2), ("beautiful", 3), ("university", 5), ("a", 1), ("the", 1), ("syllable", 2), ("agree", 1), ("tree", 1), ("state-of-the-art", 5), ("", 0)])
def test_syllables(spark, word, n):
    assert one(spark, word, tx.syllables) == n


GOLDEN = {
    "Hello world": (0.4, 2, 1),
    "": (0.4, 0, 0),
    "!!! ??? ... ---": (0.3965, 0, 1),
    "Hello world. This is a test. One two three.": (0.355566894605, 9, 3),
}


def test_golden_scores(spark):
    rows = spark.createDataFrame([(t,) for t in GOLDEN], "text string")
    got = {r.text: r for r in ts.analyze_text(rows).collect()}
    for text, (score, words, sentences) in GOLDEN.items():
        assert got[text].ai_score == pytest.approx(score, abs=1e-9)
        assert (got[text].word_count, got[text].sentence_count) == (words, sentences)


def test_clashing_columns_nulls_and_long_texts(spark):
    rows = spark.createDataFrame([(None, 9.0), ("word and other words. " * 5000, 9.0), ("word", 9.0), ("word", 9.0)], "text string, ai_score double")
    got = ts.analyze_text(rows).collect()
    assert len(got) == 4
    for r in got:
        assert all(0 <= r[name] <= 1 for name in (*lexicon.SIGNALS, "ai_score"))
    assert ts.analyze_text(rows.limit(0)).count() == 0


PIECES = st.sampled_from([
    "The", "the", "cat", "COVID-19", "it’s", "isn't", "42", "x", "a", "I", "Straße", "ΟΔΟΣ", "İzmir", "résumé", "state-of-the-art", "agree", "syllables", "walked", "however", "I cannot provide", "²", "名前",
    ".", ". ", "! ", "?\n", "... ", ", ", "; ", "—", "“", "\u00a0", "\u2028", "\t", " ", " ", "$", "_", "'", "-", "🙂",
])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=120).map("".join), min_size=1, max_size=30))
def test_the_pass_equals_the_columns(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    parts = ts.with_parts(rows)
    columns = {**ts.signal_columns(), **ts.stats_columns(), "detected_phrases": F.col("_found"), "bigrams": F.col("_bigrams"), "trigrams": F.col("_trigrams")}
    wanted = {r.i: r for r in parts.select("i", *[c.alias(n) for n, c in columns.items()]).collect()}
    for r in read_texts(rows, list(columns), keep=["i"]).collect():
        for name in columns:
            if name in ("bigrams", "trigrams"):
                assert tuple(r[name]) == pytest.approx(tuple(wanted[r.i][name]), abs=1e-9), (name, texts[r.i])
            else:
                assert r[name] == (pytest.approx(wanted[r.i][name], abs=1e-9) if isinstance(r[name], float) else wanted[r.i][name]), (name, texts[r.i])


def by_hand(words):
    """Entropy of bigrams and gap variation, the slow way."""
    low = [w.lower() for w in words]
    grams = [" ".join(p) for p in zip(low, low[1:], strict=False)]
    share = [grams.count(g) / len(grams) for g in set(grams)]
    return -sum(p * math.log2(p) for p in share), len(set(grams)), sum(1 for g in set(grams) if grams.count(g) > 1)


def test_entropy_by_hand(spark):
    text = "the cat sat on the mat and the cat ran to the mat where the cat sat"
    got = ts.with_parts(spark.createDataFrame([(text,)], "text string")).select("_bigrams").first()[0]
    entropy, kinds, repeated = by_hand(text.split())
    assert (got.kinds, got.repeated) == (kinds, repeated) and got.entropy == pytest.approx(entropy)


def test_phrases(spark):
    text = "As an AI, I cannot provide this. Furthermore, let me know if you want more."
    got = ts.with_parts(spark.createDataFrame([(text,)], "text string")).select("_found").first()[0]
    assert got == ["as an ai", "i cannot provide", "furthermore", "let me know if", "let me know if you"]
    assert len(lexicon.PHRASES) == 231 and sum(w for *_, w in lexicon.PHRASES) == pytest.approx(121.55)
    assert len(lexicon.CONTRACTIONS) == 37 and len(lexicon.COMMON_WORDS) == len(set(lexicon.COMMON_WORDS)) == 180


def test_presets(spark):
    assert all(sum(w) == pytest.approx(1) and len(w) == 10 for w in lexicon.PRESETS.values())
    assert lexicon.preset_weights("nonsense") == lexicon.PRESETS["balanced"]
    weighted = spark.range(1).select(ts.weighted_score([F.lit(0.3)] * 10, [0.0] * 10).alias("x")).first().x
    assert weighted == 1.0 or weighted == 0.0


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.5,), (0.25,), (0.9,)], "ai_score double")
    assert [(r.human, r.confidence, r.verdict) for r in verdicts.add_verdict(rows).collect()] == [(False, 0.0, "ai"), (True, 0.5, "human"), (False, 0.8, "ai")]


def test_confusion(spark):
    rows = spark.createDataFrame([("ai", "ai"), ("ai", "human"), ("human", "human"), ("human", "human")], "expected string, predicted string")
    got = verdicts.confusion(rows).first()
    assert (got.tp, got.tn, got.fp, got.fn, got.accuracy, got.precision, got.recall) == (1, 2, 0, 1, 75.0, 100.0, 50.0)
    assert got.f1 == pytest.approx(200 / 3)
    none = verdicts.confusion(rows.limit(0)).first()
    assert none.accuracy == none.f1 == 0.0


def test_detector_means(spark):
    rows = spark.createDataFrame([(1, "local", 0.4), (1, "hive", 0.9), (2, "local", 0.2), (2, "other", None), (3, "local", None)], "id long, detector string, score double")
    got = {r.id: (r.ai_score, r.detectors) for r in verdicts.aggregate_detectors(rows, ["id"]).collect()}
    assert got[1][0] == pytest.approx((0.4 + 0.9 * 1.2) / 2.2) and got[1][1] == ["hive", "local"]
    assert got[2] == (0.2, ["local"]) and got[3] == (0.5, [])
