"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ALNUM, Members, materialize, mix, remainder_of_id, text_runs, word_hash, words_in

#: Words of the hand-made transducers, in English, German, French and Spanish. Insults are learned; these start the list.
INSULTS = (
    "idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown imbecile dumb filth vermin "
    "dummkopf trottel abschaum versager widerlich erbärmlich crétin abruti minable ordure répugnant imbécil estúpido basura inútil patético asqueroso"
).split()
THREATS = "kill hurt destroy beat stab shoot töten umbringen vernichten verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = (
    "you your yours yourself u they them he she him her everyone people du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
    "ils elles tú tu te ti usted ustedes vosotros ellos ellas eres"
).split()
NEGATIONS = "not no never isn aren wasn don doesn didn nobody without nicht kein keine keinen niemals nie ohne pas jamais ni sans nunca jamás ningún sin".split()
REPORTS = (
    "said says say wrote writes called calls quoted quotes quote according claimed claims alleged reported reportedly sagte sagt schrieb nannte "
    "zitierte laut dit disait écrit appelé selon prétend dijo dice escribió llamó según afirma"
).split()

#: Prefix lengths, in bytes, for which the insult transducer can learn an arc; 0 stands for the whole word.
STEMS = (4, 5, 6, 7, 8)
#: What a match can be read as, and what its weight is multiplied by.
KINDS = ("plain", "targeted", "negated", "reported", "threat")
_FACTOR = (1.0, 1.25, 0.4, 0.6, 1.0)
_THREAT = 3.0
#: Of a text: 1, its strongest clause, its strongest match, the sum, the sum per hundred words, and the sum of each kind.
N_FEATURES = 5 + len(KINDS)

#: The transducers' alphabet: other words, the end of a clause, the three contexts, then insults and threats with their marks.
OTHER, CLAUSE_END, TARGET, NEGATION, REPORT, INSULT = range(6)
NEGATED, REPORTED, AIMED = 1, 2, 4
THREAT = INSULT + 8
SYMBOLS = THREAT + 8


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted finite-state transducer: from (state, symbol) the next state, the symbol put out, and a weight to multiply by."""

    next: np.ndarray
    out: np.ndarray
    weight: np.ndarray

    @cached_property
    def after_others(self) -> np.ndarray:
        """The state after so many other words (columns); beyond the last column it stays as it is."""
        columns = [np.arange(len(self.next))]
        while len(columns) < 2 or not np.array_equal(columns[-1], columns[-2]):
            columns.append(self.next[columns[-1], OTHER])
        return np.stack(columns, axis=1)

    def run(self, symbols: np.ndarray, others: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and weight of every symbol. others: how many other words stand before it in its clause; starts: where clauses begin.

        All clauses are read at once, symbol by symbol.
        """
        out, weight = np.zeros_like(symbols), np.ones(len(symbols))
        skip = np.minimum(others, self.after_others.shape[1] - 1)
        sizes = np.diff(np.append(starts, len(symbols)))
        order = np.argsort(-sizes, kind="stable")
        longest, state = sizes[order], np.zeros(len(starts), dtype=np.int64)
        for k in range(int(longest[0]) if len(longest) else 0):
            n = int(np.searchsorted(-longest, -k, side="left"))
            at = starts[order[:n]] + k
            here, x = self.after_others[state[:n], skip[at]], symbols[at]
            out[at], weight[at], state[:n] = self.out[here, x], self.weight[here, x], self.next[here, x]
        return out, weight


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that puts the first one's output through the second, with the pairs of states that can be reached."""
    names = {(0, 0): 0}
    rows = []
    for a, b in (todo := [(0, 0)]):
        middle = first.out[a]
        ahead = list(zip(first.next[a].tolist(), second.next[b, middle].tolist(), strict=True))
        for pair in ahead:
            if pair not in names:
                names[pair] = len(names)
                todo.append(pair)
        rows.append(([names[pair] for pair in ahead], second.out[b, middle], first.weight[a] * second.weight[b, middle]))
    return Transducer(*(np.array(x) for x in zip(*rows, strict=True)))


def scope(trigger: int, words: int | None, mark: int) -> Transducer:
    """Marks insults and threats that stand within so many words after the trigger in its clause (None: anywhere after it). Its state is the words left."""
    n = 1 if words is None else words
    state, symbol = np.meshgrid(np.arange(n + 1), np.arange(SYMBOLS), indexing="ij")
    left = state if words is None else np.maximum(state - 1, 0)
    ahead = np.where(symbol == trigger, n, np.where(symbol == CLAUSE_END, 0, left))
    out = np.where((symbol >= INSULT) & (state > 0), ((symbol - INSULT) | mark) + INSULT, symbol)
    return Transducer(ahead, out, np.ones(out.shape))


def reading() -> Transducer:
    """Puts out 1 + the kind of a marked insult or threat, else 0: negation comes before report, report before a target. A threat needs a target, and nothing else."""
    out, weight = np.zeros((1, SYMBOLS), dtype=np.int64), np.ones((1, SYMBOLS))
    for marks in range(8):
        kind = "negated" if marks & NEGATED else "reported" if marks & REPORTED else "targeted" if marks & AIMED else "plain"
        out[0, INSULT + marks] = 1 + KINDS.index(kind)
        if kind == "targeted":
            out[0, THREAT + marks] = 1 + KINDS.index("threat")
    weight[0] = np.where(out[0] > 0, np.array(_FACTOR)[out[0] - 1], 1.0)
    return Transducer(np.zeros_like(out), out, weight)


#: Read from a clause's beginning: negation, reported speech, a target before. Then, from its end: a target after, and the reading.
FORWARD = reduce(compose, (scope(NEGATION, 3, NEGATED), scope(REPORT, None, REPORTED), scope(TARGET, 6, AIMED)))
BACKWARD = compose(scope(TARGET, 3, AIMED), reading())


@dataclass(frozen=True)
class Grammar:
    """Arcs of the insult transducer (hash of a word or stem: weight and significance), and what a document's matches weigh together."""

    arcs: dict[int, tuple[float, float]]
    weights: tuple[float, ...]


class Matches(NamedTuple):
    """The matches of a run of texts, in order: word, text, clause, kind and weight of each; and each clause's first and last word."""

    word: np.ndarray
    text: np.ndarray
    clause: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray


class Matcher:
    """Puts words through the lexical arcs, and the clauses with an insult or a threat through the composed transducers."""

    def __init__(self, arcs: dict[int, tuple[float, float]]):
        self.insults = Members(np.array(list(arcs), dtype=np.uint64))
        self.arcs = np.array([arcs[k] for k in self.insults.keys.tolist()]).reshape(-1, 2)
        symbols: dict[int, int] = {}
        for symbol, listed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            for word in listed:
                symbols.setdefault(word_hash(word.encode()), symbol)
        self.contexts = Members(np.array(list(symbols), dtype=np.uint64))
        self.symbols = np.array([symbols[h] for h in self.contexts.keys.tolist()])

    def _symbols(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of every word, and what an insult or a threat weighs; of several arcs that fit a word the most significant one counts."""
        symbols, strength = np.zeros(len(words.hash), dtype=np.int64), np.zeros(len(words.hash))
        at, which = self.contexts.find(words.hash)
        symbols[at] = self.symbols[which]
        strength[at] = _THREAT
        found = [self.insults.find(hashes) for hashes in (words.hash, *words.prefixes.values())]
        at, which = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.arcs[which, 0], self.arcs[which, 1], at))
        symbols[at] = INSULT
        strength[at[order]] = self.arcs[which[order], 0]
        return symbols, strength

    def matches(self, words) -> Matches:
        symbols, strength = self._symbols(words)
        hits = np.flatnonzero(symbols >= INSULT)
        if not len(hits):
            none = np.empty(0, dtype=np.int64)
            return Matches(none, none, none, none, np.empty(0), none, none)
        stops = np.concatenate(([0], np.cumsum(_STOP[words.bytes], dtype=np.int32)))
        ends = (words.text[1:] != words.text[:-1]) | (stops[words.start[1:]] > stops[words.end[:-1]])
        clause = np.concatenate(([0], np.cumsum(ends)))
        events = np.flatnonzero((symbols > 0) & np.isin(clause, clause[hits]))
        own = clause[events]
        fresh = np.concatenate(([True], own[1:] != own[:-1]))
        firsts = np.concatenate(([0], np.flatnonzero(ends) + 1))
        lasts = np.append(firsts[1:], len(clause)) - 1
        before = np.where(fresh, firsts[own], np.concatenate(([0], events[:-1] + 1)))
        after = np.where(np.append(fresh[1:], True), lasts[own], np.append(events[1:] - 1, 0))
        marked, one = FORWARD.run(symbols[events], events - before, np.flatnonzero(fresh))
        last = np.flatnonzero(np.append(fresh[1:], True))
        kinds, two = BACKWARD.run(marked[::-1], (after - events)[::-1], (len(events) - 1 - last)[::-1])
        kinds, weight = kinds[::-1] - 1, strength[events] * one * two[::-1]
        found = np.flatnonzero(kinds >= 0)
        return Matches(events[found], words.text[events[found]], own[found], kinds[found], weight[found], firsts, lasts)

    def features(self, column: pa.Array) -> Iterator[tuple[np.ndarray, object, Matches]]:
        """Per run of texts: a row of features for each, its words and matches."""
        for first, last, raw, offsets in text_runs(column):
            n = last - first
            words = words_in(raw, offsets, ALNUM, STEMS)
            found = self.matches(words)
            out = np.zeros((n, N_FEATURES))
            out[:, 0] = 1.0
            if len(found.word):
                clauses, at = np.unique(found.clause, return_inverse=True)
                of_clause = np.bincount(at, weights=found.weight)
                np.maximum.at(out[:, 1], words.text[found.firsts[clauses]], of_clause)
                np.maximum.at(out[:, 2], found.text, found.weight)
                out[:, 3] = np.bincount(found.text, weights=found.weight, minlength=n)
                out[:, 4] = 100 * out[:, 3] / np.maximum(20, np.bincount(words.text, minlength=n))
                out[:, 5:] = np.bincount(found.text * len(KINDS) + found.kind, weights=found.weight, minlength=n * len(KINDS)).reshape(n, -1)
            out[:, 1:] = np.log1p(out[:, 1:])
            yield out, words, found


_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?;:,()\n\"")] = True


def _score(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Distinct training texts with their label: of the labelled rows outside the held-out fold, the `most` with the smallest hash of their id."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(remainder_of_id(F.col("l_id")) != 0).orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("l_id"))
    return texts.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)))


def _count_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of texts, its words and stems with the number of texts that hold them: by fold, others and toxic ones."""
    for batch in batches:
        group = 2 * np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(1)).astype(np.int64)
        for first, last, raw, offsets in text_runs(batch.column(0)):
            words = words_in(raw, offsets, ALNUM, STEMS)
            keys, sides = [], []
            for hashes in (words.hash, *words.prefixes.values()):
                _, once = np.unique(mix(hashes ^ mix(words.text.astype(np.uint64))), return_index=True)
                once = once[hashes[once] != 0]
                keys.append(hashes[once])
                sides.append(group[first + words.text[once]])
            keys, sides = np.concatenate(keys), np.concatenate(sides)
            distinct, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse * 4 + sides, minlength=4 * len(distinct)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *(pa.array(counts[:, g]) for g in range(4))], names=["key", *_GROUPS])


_GROUPS = ("other_0", "toxic_0", "other_1", "toxic_1")


def _best_arcs(counts: DataFrame, a, b, n_toxic: int, n_other: int, most: int, least_texts: int) -> dict[int, tuple[float, float]]:
    """The words and stems that tell toxic texts best. a, b: in how many toxic and other texts each occurs."""
    arcs = {word_hash(w.encode()): (2.0, 0.0) for w in INSULTS}
    if not n_toxic or not n_other:
        return arcs
    a, b = a.cast("double"), b.cast("double")
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_other - b + 0.5))
    unsure = F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    share = n_toxic / (n_toxic + n_other)
    gain = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    rows = counts.where(a >= least_texts).select("key", (odds - unsure).alias("weight"), gain.alias("gain")).where("gain > 12 AND weight > 1.5")
    for row in rows.orderBy(F.desc("gain"), "key").limit(most).collect():
        arcs[row["key"] % (1 << 64)] = (min(6.0, float(row["weight"])), float(row["gain"]))
    return arcs


def learn_grammar(docs: DataFrame, labels: DataFrame, most_labelled: int = 40_000, most_arcs: int = 1024, least_texts: int = 4) -> Grammar:
    """Learn the insult arcs, and by cross-fitting what matches weigh, from a bounded sample of labelled texts.

    most_labelled bounds the sample (a classifier's training set; the only sample taken). An arc is a word or stem that at least
    least_texts toxic texts hold, with high log odds (less their standard error) and a high likelihood ratio; the
    most_arcs with the highest ratio are kept, beside the hand-made list. Where several arcs fit a word, the most significant one
    counts. The weights of matches come from a logistic regression in which each half of the sample is read with arcs learned on the other.
    Labels without an id or a value are ignored, of several for one id the largest counts; rows of docs that share an id share its label; without
    labels of both kinds only the hand-made list is used.
    """
    sample = materialize(_labelled(docs, labels, most_labelled), "labelled")
    sizes = {(int(r["fold"]), r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = lambda toxic, *folds: sum(sizes.get((fold, toxic), 0) for fold in folds)
    rows = sample.select("text", "toxic", F.col("fold").cast("int").alias("fold")).mapInArrow(_count_arcs, "key long, " + ", ".join(f"{g} long" for g in _GROUPS))
    counts = materialize(rows.groupBy("key").agg(*[F.sum(g).alias(g) for g in _GROUPS]).where(f"toxic_0 + toxic_1 >= {least_texts}"), "arc-counts")
    by_fold = [_best_arcs(counts, F.col(f"toxic_{k}"), F.col(f"other_{k}"), n(1, k), n(0, k), most_arcs, least_texts) for k in (0, 1)]
    arcs = _best_arcs(counts, F.col("toxic_0") + F.col("toxic_1"), F.col("other_0") + F.col("other_1"), n(1, 0, 1), n(0, 0, 1), most_arcs, least_texts)
    weights = np.zeros(N_FEATURES)
    weights[:2] = -3.0, 3.0
    if n(1, 0, 1) and n(0, 0, 1):

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = [Matcher(by_fold[1]), Matcher(by_fold[0])]
            for batch in batches:
                folds = np.asarray(batch.column(2))
                x = np.zeros((batch.num_rows, N_FEATURES))
                for fold, matcher in enumerate(matchers):
                    mine = np.flatnonzero(folds == fold)
                    if len(mine):
                        x[mine] = np.concatenate([own for own, _, _ in matcher.features(batch.column(0).take(pa.array(mine)))])
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

        rows = sample.select("text", "toxic", F.col("fold").cast("int").alias("fold")).mapInArrow(gather, "toxic int, x array<double>").toArrow()
        x = np.array(rows.column("x").to_pylist())
        order = np.lexsort((*x.T, rows.column("toxic").to_numpy()))
        weights = _logistic(x[order], rows.column("toxic").to_numpy().astype(float)[order])
    return Grammar(arcs, tuple(float(w) for w in weights))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Ridge logistic regression; weights of matches are held at zero or above, so that a match never lowers a score.

    Projected Newton steps: a weight at zero that would fall takes no part in a step, and a step is halved until the loss falls.
    """
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-4
    bounded = np.arange(len(w)) > 0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = _score(x, w)
        gradient = x.T @ (p - y) + penalty * w
        free = np.flatnonzero(~(bounded & (w <= 0) & (gradient > 0)))
        hessian = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(penalty[free] + 1e-9)
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(hessian, gradient[free])
        size = 1.0
        while size > 1e-6:
            ahead = w - size * step
            ahead[bounded] = np.maximum(ahead[bounded], 0.0)
            if (new := loss(ahead)) < now:
                break
            size /= 2
        else:
            break
        done = now - new < 1e-9 * max(1.0, now)
        w, now = ahead, new
        if done:
            break
    return w


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_matches", T.LongType()), T.StructField("worst_clause", T.StringType()), T.StructField("worst_kind", T.StringType())])


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches, worst_clause, worst_kind for every row of docs (doc_id, text).

    Only the text is scored. Its matches are the readings of the grammar: an insult, plain, aimed at a target, negated or reported,
    or a threat with a target, each within one clause; worst_clause is the clause of the strongest one, A-Z lower-cased, the first among equals. Texts are not shuffled. Null and empty texts have no match and
    the score of such texts; repeated rows give repeated results; no rows give no rows; other columns are ignored.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(grammar.arcs), np.array(grammar.weights)
        for batch in batches:
            at = 0
            for x, words, found in matcher.features(batch.column(2)):
                n = len(x)
                s = _score(x, weights)
                worst, kinds = [None] * n, [None] * n
                order = np.lexsort((-found.word, found.weight, found.text))
                for j in order[np.append(found.text[order][1:] != found.text[order][:-1], True)].tolist() if len(order) else ():
                    i, lo, hi = int(found.text[j]), found.firsts[found.clause[j]], found.lasts[found.clause[j]]
                    worst[i] = words.bytes[words.start[lo] : words.end[hi]].tobytes().decode("utf-8", "replace")
                    kinds[i] = KINDS[found.kind[j]]
                counts = np.bincount(found.text, minlength=n)
                columns = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(counts, pa.int64()), pa.array(worst, pa.string()), pa.array(kinds, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)
                at += n

    return docs.select(F.col("doc_id").cast("long"), (remainder_of_id(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(score, SCHEMA)


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below 0.5. Null and empty texts have no match and the score of such texts;
    repeated rows fare alike; no rows give no rows; columns of any name pass through."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(grammar.arcs), np.array(grammar.weights)
        for batch in batches:
            parts = [_score(x, weights) < 0.5 for x, _, _ in matcher.features(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=bool)))

    return docs.mapInArrow(keep, docs.schema)
