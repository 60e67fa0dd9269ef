"""The text signals in one pass over Arrow batches: what text_signals says as column expressions, about ten times as fast.

Array functions with lambdas are interpreted row by row in the JVM; here, words are split, counted and looked up by C code, and what a
word is like (syllables, bytes, whether it is common) is worked out once per distinct word of a task. Nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import log2, sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import lexicon

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*")
_SENTENCE_END = re.compile(r"[.!?]+[\t\n\f\r ]+")
_VOWELS = re.compile(r"[aeiouy]+")
_PLAIN = str.maketrans("’‘“”—–", "''\"\"--")
_SPACE = "\t\n\x0b\f\r \x85" + "".join(chr(c) for c in range(0x3001) if unicodedata.category(chr(c))[0] == "Z")
_VARIED = frozenset("!?;:-—()\"'")
#: Distinct words that a task remembers.
_MOST_WORDS = 500_000


def lower(text: str) -> str:
    """Lower case by single characters: final sigma and dotted capital I have no special forms."""
    return text.lower() if text.isascii() else text.replace("Σ", "σ").replace("İ", "i").lower()


def words_of(sentence: str) -> list[str]:
    """Words in order; numbers and single bytes other than i and a are left out."""
    if sentence.isascii():
        found = _ASCII_WORD.findall(sentence)
    else:
        found = _WORD.findall(sentence.translate(_PLAIN))
    return [w for w in found if not w.isdecimal() and (len(w) > 1 or not w.isascii() or w in "iaIA")]


def sentences_of(text: str) -> list[str]:
    return [s for s in (x.strip(_SPACE) for x in _SENTENCE_END.split(text)) if s]


def syllables(low: str) -> int:
    runs = len(_VOWELS.findall(low))
    return max(1, runs - (runs > 1 and low.endswith("e")))


def clamp(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return max(low, min(high, x))


def _grade(n_words: int, n_sentences: int, n_syllables: int) -> float:
    if not n_words or not n_sentences:
        return 0.0
    return clamp(n_words / n_sentences * 0.39 + n_syllables / n_words * 11.8 - 15.59, 0.0, 18.0)


def _variation(n: int, total: int, squares: int) -> float:
    """Population standard deviation over mean, from exact sums."""
    return sqrt(n * squares - total * total) / total if total else 0.0


class Grams(NamedTuple):
    """Entropy in bits, number of distinct n-grams, number of those that repeat."""

    entropy: float = 0.0
    kinds: int = 0
    repeated: int = 0


def grams(low: Sequence, n: int) -> Grams:
    total = len(low) - n + 1
    if total <= 0:
        return Grams()
    counts = Counter(zip(*(low[k:] for k in range(n)), strict=False))
    several = [c for c in counts.values() if c > 1]
    return Grams(log2(total) - sum(c * log2(c) for c in several) / total, len(counts), len(several))


class _Known(dict):
    """Word: lower case, syllables, bytes, whether three syllables count as complex, content word (not common and over 4 bytes), rare (over 3)."""

    def __init__(self, common: frozenset[str]):
        self.common = common

    def __missing__(self, word: str) -> tuple[str, int, int, bool, bool, bool]:
        low = lower(word)
        n = syllables(low)
        # the lower-cased word's bytes decide on content and rarity
        size = len(low.encode("utf-8", "surrogatepass"))
        new = low not in self.common
        self[word] = out = (low, n, len(word.encode("utf-8", "surrogatepass")), n >= 3 and not low.endswith(("ed", "es", "ing")), new and size > 4, new and size > 3)
        return out


class _Sizes(dict):
    def __init__(self, known: _Known):
        self.known = known

    def __missing__(self, word: str) -> int:
        self[word] = out = self.known[word][1]
        return out


class Reader:
    """Reads texts; tables are parameters."""

    def __init__(self, phrases: Sequence[tuple] = lexicon.PHRASES, common: Sequence[str] = lexicon.COMMON_WORDS, contractions: Sequence[str] = lexicon.CONTRACTIONS):
        self.phrases = [(pattern, float(weight)) for _, _, pattern, weight in phrases]
        self.contractions = list(contractions)
        # one pass for all patterns where that package is there, else one search for each
        self.automaton = None
        if ahocorasick is not None and self.phrases:
            self.automaton = ahocorasick.Automaton()
            for pattern, _ in self.phrases:
                self.automaton.add_word(pattern, pattern)
            self.automaton.make_automaton()
        self.common = frozenset(common)
        self.marks: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known = _Known(self.common)
        self.sizes = _Sizes(self.known)

    def punctuation(self, text: str) -> dict[str, int]:
        """Each punctuation character of the text with its count."""
        out = {}
        for c in set(text):
            if c not in self.marks:
                self.marks[c] = unicodedata.category(c)[0] == "P"
            if self.marks[c]:
                out[c] = text.count(c)
        return out

    def burstiness(self, low: list[str], content: set[str]) -> float:
        """Mean variation of the gaps between occurrences of content words."""
        last: dict[str, int] = {}
        gaps: dict[str, list[int]] = {}
        for i, w in enumerate(low):
            if w in content:
                if w in last:
                    gap = i - last[w]
                    own = gaps.get(w)
                    if own is None:
                        gaps[w] = [1, gap, gap * gap]
                    else:
                        own[0] += 1
                        own[1] += gap
                        own[2] += gap * gap
                last[w] = i
        if not gaps:
            return 0.5
        return 1.0 - min(sum(_variation(*g) for g in gaps.values()) / len(gaps) / 1.5, 1.0)

    def read(self, text: str | None) -> dict:
        text = text or ""
        if len(self.known) > _MOST_WORDS:
            self.forget()
        sentences = sentences_of(text)
        by_sentence = [words_of(s) for s in sentences]
        words = [w for own in by_sentence for w in own]
        known, sizes = self.known, self.sizes
        counts = Counter(words)
        facts = [(known[w], c) for w, c in counts.items()]
        low_of = {w: known[w][0] for w in counts}
        low = [low_of[w] for w in words]
        low_text = lower(text)
        n, n_sentences = len(words), len(sentences)
        tokens = Counter(low)
        unique = tokens.keys()
        n_bytes = sum(f[2] * c for f, c in facts)
        n_syllables = sum(f[1] * c for f, c in facts)
        n_complex = sum(c for f, c in facts if f[3])
        rare = len({f[0] for f, _ in facts if f[5]})
        marks = self.punctuation(text)
        if self.automaton is None:
            found = [(pattern, weight) for pattern, weight in self.phrases if pattern in low_text]
        else:
            hits = {pattern for _, pattern in self.automaton.iter(low_text)}
            found = [(pattern, weight) for pattern, weight in self.phrases if pattern in hits] if hits else []
        two, three = grams(low, 2), grams(low, 3)
        syllables_of = [sum(map(sizes.__getitem__, own)) for own in by_sentence]
        out = {
            "char_count": len(text.encode("utf-8", "surrogatepass")), "word_count": n, "sentence_count": n_sentences,
            "avg_sentence_len": n / n_sentences if n_sentences else 0.0, "avg_word_len": n_bytes / n if n else 0.0,
            "unique_words": len(unique), "unique_ratio": len(unique) / n if n else 0.0, "punctuation_count": sum(marks.values()),
            "flesch_kincaid_grade": _grade(n, n_sentences, n_syllables),
            "gunning_fog_index": clamp((n / n_sentences + n_complex / n * 100) * 0.4, 0.0, 20.0) if n and n_sentences else 0.0,
            "detected_phrases": [pattern for pattern, _ in found],
            "bigrams": two._asdict(), "trigrams": three._asdict(), "token_counts": tokens.items(),
            **dict.fromkeys(lexicon.SIGNALS, 0.5),
        }
        if n_sentences >= 3:
            lengths = [len(own) for own in by_sentence]
            out["sentence_variance"] = 1.0 - min(_variation(n_sentences, n, sum(x * x for x in lengths)) / 0.5, 1.0)
            starts = [lower(f"{own[0]} {own[1]}") for own in by_sentence if len(own) >= 2]
            out["repetition_score"] = min((len(starts) - len(set(starts))) / n_sentences * 2, 1.0)
        if n_sentences >= 4:
            out["readability_variance"] = self._grades(sentences, by_sentence, syllables_of)
        if n >= 10:
            out["vocabulary_richness"] = clamp((1.0 - min(len(unique) / n / 0.6, 1.0)) * 0.6 + (1.0 - rare / len(unique)) * 0.4)
            out["word_length_variance"] = 1.0 - min(_variation(n, n_bytes, sum(f[2] * f[2] * c for f, c in facts)) / 0.6, 1.0)
        if n >= 15:
            even = [g.entropy / log2(g.kinds) if g.kinds > 1 else 0.0 for g in (two, three)]
            again = [g.repeated / g.kinds for g in (two, three)]
            out["ngram_uniformity"] = clamp((even[0] + even[1]) / 2 * (1.0 - (again[0] + again[1]) / 2 * 0.5))
        if n >= 20:
            out["burstiness"] = self.burstiness(low, {f[0] for f, _ in facts if f[4]})
            out["contractions_usage"] = 1.0 - min(sum(map(low_text.count, self.contractions)) / (n / 100.0) / 3.0, 1.0)
        if sum(marks.values()) >= 5:
            out["punctuation_variety"] = clamp(1.0 - (len(marks) / 8.0 * 0.5 + len(_VARIED & marks.keys()) / 5.0 * 0.5))
        out["phrase_score"] = 0.0
        if found:
            out["phrase_score"] = min(sum(weight for _, weight in found) / (n / 100.0), 1.0) if n else 1.0
        return out

    @staticmethod
    def _grades(sentences: list[str], by_sentence: list[list[str]], syllables_of: list[int]) -> float:
        """Variation of the reading grades of groups of two sentences (three beyond ten sentences)."""
        step = 3 if len(sentences) > 10 else 2
        grades = []
        for i in range(0, len(sentences), step):
            alive = sum(1 for s in sentences[i : i + step] if s.rstrip(".!?").strip(_SPACE))
            grade = _grade(sum(map(len, by_sentence[i : i + step])), alive, sum(syllables_of[i : i + step]))
            if grade > 0:
                grades.append(grade)
        if len(grades) < 2:
            return 0.5
        mean = sum(grades) / len(grades)
        return 1.0 - min(sqrt(sum((g - mean) * (g - mean) for g in grades) / len(grades)) / mean / 0.3, 1.0)


_GRAMS = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("kinds", T.LongType()), T.StructField("repeated", T.LongType())])
#: What a pass can return, by name.
FIELDS: dict[str, T.DataType] = {
    **dict.fromkeys(lexicon.SIGNALS, T.DoubleType()),
    "char_count": T.LongType(), "word_count": T.LongType(), "sentence_count": T.LongType(), "avg_sentence_len": T.DoubleType(), "avg_word_len": T.DoubleType(),
    "unique_words": T.LongType(), "unique_ratio": T.DoubleType(), "punctuation_count": T.LongType(), "flesch_kincaid_grade": T.DoubleType(), "gunning_fog_index": T.DoubleType(),
    "detected_phrases": T.ArrayType(T.StringType()), "bigrams": _GRAMS, "trigrams": _GRAMS, "token_counts": T.MapType(T.StringType(), T.LongType()),
}
_ARROW = {T.DoubleType(): pa.float64(), T.LongType(): pa.int64(), T.ArrayType(T.StringType()): pa.list_(pa.string()), FIELDS["token_counts"]: pa.map_(pa.string(), pa.int64()), _GRAMS: pa.struct([("entropy", pa.float64()), ("kinds", pa.int64()), ("repeated", pa.int64())])}


def read_texts(docs: DataFrame, wanted: Sequence[str], text: str = "text", reader: Callable[[], Reader] = Reader, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns of docs to keep (all by default), and the wanted FIELDS of each row's text, whose names must not be among them.

    A null text is an empty one. Rows stay in their partitions; repeated rows give repeated results; no rows give no rows.
    """
    keep = list(docs.columns) if keep is None else list(keep)
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(name, FIELDS[name]) for name in wanted)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found: list[list] = [[] for _ in wanted]
            for i in range(batch.num_rows):
                row = own.read(texts[i].as_py())
                for column, name in zip(found, wanted, strict=True):
                    column.append(list(row[name]) if name == "token_counts" else row[name])
            columns = [*batch.columns[:-1], *(pa.array(c, _ARROW[FIELDS[name]]) for c, name in zip(found, wanted, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("the text")).mapInArrow(run, schema)
