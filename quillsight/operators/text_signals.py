"""Per-document text signals: 0 reads as human-made, 1 as machine-made; 0.5 where a text is too short to tell.

Every signal is computed within its row, so nothing is shuffled, whatever the size of the corpus. analyze_text reads each text once in an
Arrow pass (text_pass). The same signals stand here as column expressions over arrays of words and sentences, for use within larger expressions; Spark interprets
their lambdas, which costs about ten times as much. Tests hold both against each other, and the registered queries against SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, text as tx
from .text_pass import Reader, read_texts

STATS = (
    "char_count", "word_count", "sentence_count", "avg_sentence_len", "avg_word_len", "unique_words", "unique_ratio", "punctuation_count",
    "flesch_kincaid_grade", "gunning_fog_index",
)


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _text, _sentences, _by_sentence (words of each), _words and _lower. A null text is an empty one."""
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_sentences", tx.split_sentences(F.col("_text")))
    out = out.withColumn("_by_sentence", F.transform("_sentences", tx.tokenize))
    out = out.withColumn("_words", F.flatten("_by_sentence"))
    return out.withColumn("_lower", F.transform("_words", tx.lower))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def stats_columns() -> dict[str, Column]:
    words, n_words, n_sentences = F.col("_words"), F.size("_words"), F.size("_sentences")
    n_unique = F.size(F.array_distinct("_lower"))
    n_bytes = _total(F.transform(words, F.octet_length))
    n_syllables = _total(F.transform(words, tx.syllables))
    return {
        "char_count": F.octet_length("_text").cast("long"),
        "word_count": n_words.cast("long"),
        "sentence_count": n_sentences.cast("long"),
        "avg_sentence_len": tx.ratio(n_words, n_sentences),
        "avg_word_len": tx.ratio(n_bytes, n_words),
        "unique_words": n_unique.cast("long"),
        "unique_ratio": tx.ratio(n_unique, n_words),
        "punctuation_count": F.regexp_count(F.col("_text"), F.lit(r"\p{P}")).cast("long"),
        "flesch_kincaid_grade": tx.grade_of(n_words, n_sentences, n_syllables),
        "gunning_fog_index": tx.fog_of(n_words, n_sentences, F.size(F.filter(words, tx.is_complex))),
    }


def _low_variation(values: Column, scale: float) -> Column:
    return 1.0 - F.least(tx.variation(values) / scale, F.lit(1.0))


def sentence_variance() -> Column:
    return F.when(F.size("_sentences") < 3, F.lit(0.5)).otherwise(_low_variation(F.transform("_by_sentence", F.size), 0.5))


def vocabulary_richness(common: Sequence[str] = lexicon.COMMON_WORDS) -> Column:
    unique = F.array_distinct("_lower")
    rare = F.filter(unique, lambda w: ~w.isin(*common) & (F.octet_length(w) > 3))
    spread = 1.0 - F.least(tx.ratio(F.size(unique), F.size("_lower")) / 0.6, F.lit(1.0))
    value = tx.clamp(spread * 0.6 + (1.0 - tx.ratio(F.size(rare), F.size(unique))) * 0.4)
    return F.when(F.size("_words") < 10, F.lit(0.5)).otherwise(value)


def burstiness(common: Sequence[str] = lexicon.COMMON_WORDS) -> Column:
    """Mean variation of the gaps between occurrences of content words, from one pass over (word, place) in order."""
    placed = F.transform("_lower", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    content = F.array_sort(F.filter(placed, lambda x: (F.octet_length(x.w) > 4) & ~x.w.isin(*common)))
    long = lambda c: c.cast("long")
    start = F.struct(
        F.lit(None).cast("string").alias("w"), F.lit(0).alias("i"), long(F.lit(0)).alias("n"), long(F.lit(0)).alias("s"), long(F.lit(0)).alias("q"),
        F.lit(0.0).alias("sum"), F.lit(0).alias("kinds"),
    )
    own = lambda a: F.when(a.n > 0, F.sqrt((a.n * a.q - a.s * a.s).cast("double")) / a.s).otherwise(F.lit(0.0))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(a.w == x.w, F.lit(False))
        gap = long(x.i - a.i)
        return F.struct(
            x.w.alias("w"), x.i.alias("i"),
            F.when(same, a.n + 1).otherwise(long(F.lit(0))).alias("n"),
            F.when(same, a.s + gap).otherwise(long(F.lit(0))).alias("s"),
            F.when(same, a.q + gap * gap).otherwise(long(F.lit(0))).alias("q"),
            F.when(same, a["sum"]).otherwise(a["sum"] + own(a)).alias("sum"),
            F.when(same, a.kinds).otherwise(a.kinds + F.when(a.n > 0, 1).otherwise(0)).alias("kinds"),
        )

    mean = F.aggregate(content, start, step, lambda a: tx.ratio(a["sum"] + own(a), a.kinds + F.when(a.n > 0, 1).otherwise(0)))
    repeats = F.size(content) > F.size(F.array_distinct(F.transform(content, lambda x: x.w)))
    return F.when((F.size("_words") < 20) | ~repeats, F.lit(0.5)).otherwise(1.0 - F.least(mean / 1.5, F.lit(1.0)))


def punctuation_variety() -> Column:
    marks = tx.punctuation(F.col("_text"))
    kinds = F.array_distinct(marks)
    varied = F.size(F.array_intersect(kinds, F.array(*[F.lit(c) for c in "!?;:-—()\"'"])))
    value = 1.0 - (F.size(kinds) / 8.0 * 0.5 + varied / 5.0 * 0.5)
    return F.when(F.size(marks) < 5, F.lit(0.5)).otherwise(tx.clamp(value))


def phrases_found(phrases: Sequence[tuple] = lexicon.PHRASES, low: Column | None = None) -> Column:
    """Patterns that the lower-cased text contains, in the table's order."""
    low = F.col("_low_text") if low is None else low
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(pattern)), F.lit(pattern)) for _, _, pattern, _ in phrases]))


def phrase_score(found: Column, phrases: Sequence[tuple] = lexicon.PHRASES) -> Column:
    weights = F.create_map(*[F.lit(x) for _, _, pattern, weight in phrases for x in (pattern, weight)])
    total = F.aggregate(found, F.lit(0.0), lambda a, p: a + F.element_at(weights, p))
    hundreds = F.size("_words") / 100.0
    dense = F.when(F.size("_words") == 0, F.lit(1.0)).otherwise(F.least(F.try_divide(total, hundreds), F.lit(1.0)))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(dense)


def word_length_variance() -> Column:
    return F.when(F.size("_words") < 10, F.lit(0.5)).otherwise(_low_variation(F.transform("_words", F.octet_length), 0.6))


def contractions_usage(listed: Sequence[str] = lexicon.CONTRACTIONS) -> Column:
    rate = F.try_divide(tx.count_substrings(F.col("_low_text"), listed).cast("double"), F.size("_words") / 100.0)
    return F.when(F.size("_words") < 20, F.lit(0.5)).otherwise(1.0 - F.least(rate / 3.0, F.lit(1.0)))


def repetition_score() -> Column:
    starts = F.transform(F.filter("_by_sentence", lambda w: F.size(w) >= 2), lambda w: tx.lower(F.concat_ws(" ", w[0], w[1])))
    repeated = F.size(starts) - F.size(F.array_distinct(starts))
    return F.when(F.size("_sentences") < 3, F.lit(0.5)).otherwise(F.least(tx.ratio(repeated, F.size("_sentences")) * 2, F.lit(1.0)))


def sentence_facts() -> Column:
    """Per sentence: words, syllables, and whether anything remains of it when it is split again."""
    return F.zip_with(
        "_sentences", "_by_sentence",
        lambda s, words: F.struct(
            F.size(words).alias("words"), _total(F.transform(words, tx.syllables)).alias("syllables"),
            F.when(F.regexp_replace(F.regexp_replace(s, r"[.!?]+$", ""), tx.OUTER_SPACE, "") != "", 1).otherwise(0).alias("alive"),
        ),
    )


def readability_variance() -> Column:
    """Variation of the reading grades of groups of two sentences (three beyond ten sentences); uses _facts."""
    n = F.size("_facts")
    step = F.when(n > 10, 3).otherwise(2)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda i: F.slice(F.col("_facts"), i + 1, step))
    part = lambda g, name: _total(F.transform(g, lambda x: x[name]))
    grades = F.filter(F.transform(groups, lambda g: tx.grade_of(part(g, "words"), part(g, "alive"), part(g, "syllables"))), lambda x: x > 0)
    mean = F.aggregate(grades, F.lit(0.0), lambda a, x: a + x) / F.size(grades)
    spread = F.transform(F.array(F.struct(grades.alias("g"), F.when(F.size(grades) > 0, mean).alias("m"))), lambda a: F.sqrt(F.aggregate(a.g, F.lit(0.0), lambda s, x: s + (x - a.m) * (x - a.m)) / F.size(a.g)) / a.m)[0]
    value = F.when(F.size(grades) < 2, F.lit(0.5)).otherwise(1.0 - F.least(spread / 0.3, F.lit(1.0)))
    return F.when(n < 4, F.lit(0.5)).otherwise(value)


def ngrams(n: int) -> Column:
    """Sorted n-grams of the lower-cased words."""
    low = F.col("_lower")
    count = F.greatest(F.size(low) - (n - 1), F.lit(0))
    out = F.slice(low, 1, count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(low, k + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_sort(out)


def ngram_uniformity() -> Column:
    """Uses _bigrams and _trigrams, each struct(entropy, kinds, repeated)."""
    both = [F.col("_bigrams"), F.col("_trigrams")]
    even = [F.when(g.kinds > 1, F.try_divide(g.entropy, F.log2(g.kinds.cast("double")))).otherwise(F.lit(0.0)) for g in both]
    again = [tx.ratio(g.repeated, g.kinds) for g in both]
    value = (even[0] + even[1]) / 2 * (1.0 - (again[0] + again[1]) / 2 * 0.5)
    return F.when(F.size("_words") < 15, F.lit(0.5)).otherwise(tx.clamp(value))


def with_parts(docs: DataFrame, text: str = "text", phrases: Sequence[tuple] = lexicon.PHRASES) -> DataFrame:
    """with_words, and the intermediate columns that several signals or their parts use. Those that aren't used are pruned."""
    out = with_words(docs, text).withColumn("_low_text", tx.lower(F.col("_text")))
    for n, name in ((2, "_bigrams"), (3, "_trigrams")):
        out = out.withColumn(name, tx.entropy_of_runs(ngrams(n), F.size("_lower") - (n - 1)))
    return out.withColumn("_facts", sentence_facts()).withColumn("_found", phrases_found(phrases))


def signal_columns(phrases: Sequence[tuple] = lexicon.PHRASES, common: Sequence[str] = lexicon.COMMON_WORDS, contractions: Sequence[str] = lexicon.CONTRACTIONS) -> dict[str, Column]:
    return {
        "sentence_variance": sentence_variance(),
        "vocabulary_richness": vocabulary_richness(common),
        "burstiness": burstiness(common),
        "punctuation_variety": punctuation_variety(),
        "phrase_score": phrase_score(F.col("_found"), phrases),
        "word_length_variance": word_length_variance(),
        "contractions_usage": contractions_usage(contractions),
        "repetition_score": repetition_score(),
        "readability_variance": readability_variance(),
        "ngram_uniformity": ngram_uniformity(),
    }


def weighted_score(signals: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean in [0, 1]; plain sum where the weights sum to 0."""
    total = F.lit(0.0)
    for signal, weight in zip(signals, weights, strict=True):
        total = total + signal * F.lit(float(weight))
    whole = 0.0
    for weight in weights:
        whole += weight
    return tx.clamp(total / whole if whole > 0 else total)


def analyze_text(docs: DataFrame, text: str = "text", weights: Sequence[float] | None = None, preset: str = "balanced", phrases: Sequence[tuple] = lexicon.PHRASES) -> DataFrame:
    """docs with the ten signals, the statistics, detected_phrases and ai_score as columns."""
    weights = lexicon.preset_weights(preset) if weights is None else weights
    own = [c for c in docs.columns if c not in {*lexicon.SIGNALS, *STATS, "detected_phrases", "ai_score"}]
    out = read_texts(docs, (*lexicon.SIGNALS, *STATS, "detected_phrases"), text, lambda: Reader(phrases), own)
    return out.withColumn("ai_score", weighted_score([F.col(name) for name in lexicon.SIGNALS], weights))


def verdict_columns(score: Column) -> dict[str, Column]:
    """human: below 0.5; confidence: twice the distance from 0.5."""
    return {"human": score < 0.5, "confidence": F.abs(score - 0.5) * 2, "verdict": F.when(score < 0.5, "human").otherwise("ai")}
