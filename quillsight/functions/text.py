"""Text primitives: Column -> Column, built from JVM-side functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import lexicon

WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
SENTENCE_END = r"[.!?]+[\t\n\f\r ]+"
OUTER_SPACE = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$"
TYPOGRAPHIC, PLAIN = "’‘“”—–", "''\"\"--"


def normalize(text: Column) -> Column:
    """Typographic quotes and dashes to plain ones."""
    return F.translate(text, TYPOGRAPHIC, PLAIN)


def lower(text: Column) -> Column:
    """Lower case by single characters: final sigma and dotted capital I have no special forms."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def is_numeric(word: Column) -> Column:
    return F.coalesce(word.rlike(r"^\p{Nd}+$"), F.lit(False))


def tokenize(text: Column) -> Column:
    """Words in order; numbers and single bytes other than i and a are left out."""
    found = F.regexp_extract_all(normalize(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.rlike(r"^\p{Nd}+$") & ((F.octet_length(w) > 1) | F.lower(w).isin("i", "a")))


def split_sentences(text: Column) -> Column:
    pieces = F.split(text, SENTENCE_END, -1)
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, OUTER_SPACE, "")), lambda s: s != "")


def is_common_word(word: Column, common: Sequence[str] = lexicon.COMMON_WORDS) -> Column:
    return lower(word).isin(*common)


def syllables(word: Column) -> Column:
    """Runs of vowels, less one for a final e if there are several; 1 at least, 0 for an empty word."""
    low = lower(word)
    runs = F.regexp_count(low, F.lit("[aeiouy]+"))
    return F.when(word == "", 0).otherwise(F.greatest(F.lit(1), runs - F.when(low.endswith("e") & (runs > 1), 1).otherwise(0)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def grade_of(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch-Kincaid grade in [0, 18]; 0 without words or sentences."""
    grade = ratio(n_words, n_sentences) * 0.39 + ratio(n_syllables, n_words) * 11.8 - 15.59
    return F.when((n_words == 0) | (n_sentences == 0), F.lit(0.0)).otherwise(clamp(grade, 0.0, 18.0))


def fog_of(n_words: Column, n_sentences: Column, n_complex: Column) -> Column:
    """Gunning fog index in [0, 20]; 0 without words or sentences."""
    fog = (ratio(n_words, n_sentences) + ratio(n_complex, n_words) * 100) * 0.4
    return F.when((n_words == 0) | (n_sentences == 0), F.lit(0.0)).otherwise(clamp(fog, 0.0, 20.0))


def is_complex(word: Column) -> Column:
    low = lower(word)
    return (syllables(word) >= 3) & ~low.endswith("ed") & ~low.endswith("es") & ~low.endswith("ing")


def flesch_kincaid(text: Column) -> Column:
    words = tokenize(text)
    return grade_of(F.size(words), F.size(split_sentences(text)), F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, b: a + b))


def gunning_fog(text: Column) -> Column:
    words = tokenize(text)
    return fog_of(F.size(words), F.size(split_sentences(text)), F.size(F.filter(words, is_complex)))


def variation(values: Column) -> Column:
    """Population standard deviation over mean of an array of integers, from exact sums; 0 where the mean is 0."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(values, zero, lambda a, x: F.struct((a.n + 1).alias("n"), (a.s + x).alias("s"), (a.q + x.cast("long") * x).alias("q")))
    return F.transform(F.array(sums), lambda a: F.when(a.s == 0, F.lit(0.0)).otherwise(F.sqrt((a.n * a.q - a.s * a.s).cast("double")) / a.s))[0]


def entropy_of_runs(ordered: Column, total: Column) -> Column:
    """From a sorted array: struct(entropy in bits, number of distinct values, number of those that repeat), in one pass."""
    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0).alias("kinds"), F.lit(0).alias("repeated")
    )
    weigh = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(a.last == x, F.lit(False))
        return F.struct(
            x.alias("last"),
            F.when(same, a.run + 1).otherwise(1).alias("run"),
            F.when(same, a["sum"]).otherwise(a["sum"] + weigh(a.run)).alias("sum"),
            F.when(same, a.kinds).otherwise(a.kinds + 1).alias("kinds"),
            F.when(same & (a.run == 1), a.repeated + 1).otherwise(a.repeated).alias("repeated"),
        )

    n = total.cast("double")
    return F.aggregate(
        ordered, start, step,
        lambda a: F.struct(
            F.when(n > 0, F.log2(n) - (a["sum"] + weigh(a.run)) / n).otherwise(F.lit(0.0)).alias("entropy"), a.kinds.alias("kinds"), a.repeated.alias("repeated")
        ),
    )


def punctuation(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{P}"), F.lit(0))


def count_substrings(text: Column, listed: Sequence[str]) -> Column:
    """Non-overlapping occurrences of each string, summed."""
    total = F.lit(0)
    for item in listed:
        total = total + F.floor((F.length(text) - F.length(F.replace(text, F.lit(item), F.lit("")))) / len(item))
    return total
