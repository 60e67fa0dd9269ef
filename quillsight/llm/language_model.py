"""LM scoring: a two-level log-bilinear model (classes, then words) trained in numpy with noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import SPACED, Members, Words, materialize, remainder_of_id, text_runs, words_in

#: Classes: the end of a text, the most frequent tokens alone (more with a larger vocabulary), and the rest by shape.
FREQUENT, MOST_FREQUENT, SHAPES = 95, 191, 64
CLASSES = 1 + FREQUENT + SHAPES
#: Tokens seen so often, among the HEAD most frequent, have vectors of their own.
LEAST_SEEN = 5
#: After about so many tokens a task puts its 32-bit counts out.
MOST_COUNTED = 2_000_000_000
#: Stands for the end of a text among the token hashes.
END = 0x656E64
#: So many tokens with the highest counts are sent to the executors; the counts of others are joined.
HEAD = 65_536


def _shapes(words: Words) -> np.ndarray:
    """A number for each token from its first two bytes and its last."""
    start, end = words.start, words.end
    first = words.bytes[start].astype(np.uint32)
    second = np.where(end - start > 1, words.bytes[np.minimum(start + 1, end - 1)], 0).astype(np.uint32)
    last = words.bytes[end - 1].astype(np.uint32)
    x = (first * np.uint32(65537) + second * np.uint32(257) + last) * np.uint32(2654435761)
    return ((x ^ (x >> np.uint32(15))) >> np.uint32(4)).astype(np.int64) % SHAPES


class Tokens:
    """The tokens of a run of texts: its words, and an end after each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = words_in(raw, offsets, SPACED)
        self.n_texts = len(offsets) - 1
        self.counts = np.bincount(words.text, minlength=self.n_texts) + 1
        self.ends = np.cumsum(self.counts) - 1
        place = np.arange(len(words.hash)) + words.text
        n = len(words.hash) + self.n_texts
        self.hash = np.full(n, END, dtype=np.uint64)
        self.hash[place] = words.hash
        self.shape = np.full(n, -1, dtype=np.int64)
        self.shape[place] = _shapes(words)
        self.text = np.repeat(np.arange(self.n_texts), self.counts)

    def classes(self, frequent: Members, ranks: np.ndarray) -> np.ndarray:
        """0 for an end, 1.. for frequent tokens, then by shape."""
        out = np.where(self.shape < 0, 0, self.shape + 1 + len(ranks))
        at, which = frequent.find(self.hash)
        out[at] = ranks[which]
        return out

    def contexts(self, classes: np.ndarray, n_classes: int) -> np.ndarray:
        """For each token, the number of the pair of classes before it; n_classes stands for what is before the text."""
        n = len(classes)
        one, two = np.full(n, n_classes), np.full(n, n_classes)
        one[1:] = classes[:-1]
        two[2:] = classes[:-2]
        begins = np.concatenate(([0], self.ends[:-1] + 1))
        one[begins] = n_classes
        two[begins] = n_classes
        two[np.minimum(begins + 1, n - 1)[self.counts > 1]] = n_classes
        return two * (n_classes + 1) + one


class Adam:
    """Adam steps on arrays in place, with a rate that falls to zero over `steps`."""

    def __init__(self, parameters: list[np.ndarray], rate: float, steps: int):
        self.parameters, self.rate, self.steps, self.step = parameters, rate, steps, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]

    def move(self, slopes: tuple[np.ndarray, ...]) -> None:
        self.step += 1
        speed = self.rate * min(1.0, 2 * (1 - self.step / (self.steps + 1)))
        for p, (mean, square), g in zip(self.parameters, self.moments, slopes, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p -= speed * (mean / (1 - 0.9**self.step)) / (np.sqrt(square / (1 - 0.99**self.step)) + 1e-8)


def _contrast(scores: np.ndarray, offset: np.ndarray, seen: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Slopes of the loss of noise-contrastive estimation for counts `seen` and expected noise counts; nothing is drawn."""
    odds = 1 / (1 + np.exp(-np.clip(scores - offset, -30, 30)))
    return odds * (seen + noise) - seen


@dataclass(frozen=True)
class LogBilinear:
    """score(w | u, v) = (weights_1 * r_v + weights_2 * r_u) . q_w + bias_w over classes."""

    context: np.ndarray
    target: np.ndarray
    position: np.ndarray
    bias: np.ndarray

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each class u: scores (natural) after all pairs u, v, and the logarithms of their sums."""
        one = self.context * self.position[0]
        two = self.context * self.position[1]
        for u in range(len(self.context)):
            scores = ((one + two[u]) @ self.target.T + self.bias).astype(np.float64)
            top = scores.max(axis=1, keepdims=True)
            yield scores, top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))

    def log10_table(self) -> np.ndarray:
        """log10 p(class | two classes before), for every context at once: matrix products, then normalisation."""
        return np.concatenate([scores - norm for scores, norm in self._blocks()]) / np.log(10)

    def norms(self) -> np.ndarray:
        """The natural logarithm of the sum over classes, for every context."""
        return np.concatenate([norm[:, 0] for _, norm in self._blocks()])

    def log10(self, contexts: np.ndarray, classes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """log10 p(class | context) of single tokens."""
        u, v = contexts // len(self.context), contexts % len(self.context)
        predicted = self.position[0] * self.context[v] + self.position[1] * self.context[u]
        return (np.einsum("ij,ij->i", predicted, self.target[classes]) + self.bias[classes] - norms[contexts]) / np.log(10)


def train(
    codes: np.ndarray, counts: np.ndarray, dimensions: int = 32, steps: int | None = None, batch: int = 1024, noise_ratio: int = 16, rate: float = 0.04, seed: int = 5, classes: int = CLASSES, epochs: int = 12
) -> LogBilinear:
    """Noise-contrastive estimation on trigram counts of classes (code = context * classes + class), in order of their codes.

    Every epoch reads all codes with their counts, a batch of contexts with all classes at a time. Noise comes from the classes'
    frequencies; its expected counts are taken instead of draws, so nothing is sampled. The scores' normaliser is taken as 1 in training.
    steps: stop after so many batches.
    """
    random = np.random.default_rng(seed)
    context = random.normal(0, 0.1, (classes + 1, dimensions)).astype(np.float32)
    target = random.normal(0, 0.1, (classes, dimensions)).astype(np.float32)
    position = np.ones((2, dimensions), dtype=np.float32)
    position[1] = 0.5
    if not len(codes):
        return LogBilinear(context, target * 0, position, np.zeros(classes, dtype=np.float32))
    noise = np.bincount(codes % classes, weights=counts, minlength=classes) + 0.5
    noise /= noise.sum()
    bias = np.log(noise).astype(np.float32)
    offset = np.log(noise_ratio * noise).astype(np.float32)
    contexts = codes // classes
    fresh = np.concatenate(([True], contexts[1:] != contexts[:-1]))
    pairs, row = contexts[fresh], (np.cumsum(fresh) - 1).astype(np.int32)
    del contexts, fresh
    place = random.permutation(len(pairs)).astype(np.int32)
    row = place[row]
    order = np.argsort(row, kind="stable")
    pairs = pairs[np.argsort(place)]
    row, column, weight = row[order], (codes % classes).astype(np.int32)[order], counts[order].astype(np.float32)
    del order
    firsts = np.arange(0, len(pairs), batch)
    cuts = np.searchsorted(row, np.append(firsts, len(pairs)))
    mean = float(counts.sum()) / len(firsts)
    epochs = max(epochs, -(-60 // len(firsts)))
    steps = epochs * len(firsts) if steps is None else steps
    adam = Adam([context, target, position, bias], rate, steps)
    expected = (noise_ratio * noise).astype(np.float32)
    while adam.step < steps:
        for b in random.permutation(len(firsts))[: steps - adam.step].tolist():
            lo, hi = cuts[b], cuts[b + 1]
            own = pairs[firsts[b] : firsts[b] + batch]
            seen = np.zeros((len(own), classes), dtype=np.float32)
            seen[row[lo:hi] - firsts[b], column[lo:hi]] = weight[lo:hi]
            u, v = own // (classes + 1), own % (classes + 1)
            predicted = position[0] * context[v] + position[1] * context[u]
            slope = _contrast(predicted @ target.T + bias, offset, seen, seen.sum(axis=1, keepdims=True) * expected) / np.float32(mean)
            to_predicted = slope @ target
            at_context = np.zeros_like(context)
            np.add.at(at_context, v, to_predicted * position[0])
            np.add.at(at_context, u, to_predicted * position[1])
            adam.move((at_context, slope.T @ predicted, np.stack([(to_predicted * context[v]).sum(axis=0), (to_predicted * context[u]).sum(axis=0)]), slope.sum(axis=0)))
    return LogBilinear(context, target, position, bias)


@dataclass(frozen=True)
class WordModel:
    """score(w | v) = r_v . q_w + bias_w over the words of a shape class; words are numbered class by class from `firsts`.

    The last word of a class stands for all tokens of its shape that have no vector.
    """

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    firsts: np.ndarray
    norms: np.ndarray

    def log10(self, before: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        return (np.einsum("ij,ij->i", self.context[before], self.target[words]) + self.bias[words] - self.norms[shapes, before]) / np.log(10)


def train_words(before: np.ndarray, words: np.ndarray, counts: np.ndarray, firsts: np.ndarray, classes: int, dimensions: int = 32, epochs: int = 12, noise_ratio: int = 16, rate: float = 0.03, prior: float = 2.0, seed: int = 6) -> WordModel:
    """The same estimation for words within their classes, from all counts of (class before, word).

    A batch is a class with all its words and all classes before. `prior` draws the vectors of words with few counts to zero.
    """
    random = np.random.default_rng(seed)
    n = int(firsts[-1])
    context = random.normal(0, 0.3, (classes + 1, dimensions)).astype(np.float32)
    target = np.zeros((n, dimensions), dtype=np.float32)
    totals = np.bincount(words, weights=counts, minlength=n) + 0.5
    shape = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    noise = (totals / np.bincount(shape, weights=totals, minlength=len(firsts) - 1)[shape]).astype(np.float32)
    bias = np.log(noise)
    order = np.argsort(words, kind="stable")
    before, words, weight = before[order], words[order], counts[order].astype(np.float32)
    cuts = np.searchsorted(words, firsts)
    used = [c for c in range(len(firsts) - 1) if firsts[c + 1] - firsts[c] > 1 and cuts[c + 1] > cuts[c]]
    steps = epochs * len(used)
    adam = Adam([context], rate, steps)
    own = {c: Adam([target[firsts[c] : firsts[c + 1]], bias[firsts[c] : firsts[c + 1]]], rate, epochs) for c in used}
    for _ in range(epochs):
        for c in random.permutation(used).astype(int).tolist():
            lo, hi = cuts[c], cuts[c + 1]
            q, b = own[c].parameters
            share = noise[firsts[c] : firsts[c + 1]]
            seen = np.zeros((classes + 1, len(q)), dtype=np.float32)
            seen[before[lo:hi], words[lo:hi] - firsts[c]] = weight[lo:hi]
            slope = _contrast(context @ q.T + b, np.log(noise_ratio * share), seen, seen.sum(axis=1, keepdims=True) * (noise_ratio * share))
            at_context, at_words, at_bias = slope @ q, slope.T @ context, slope.sum(axis=0)
            adam.move((at_context / weight[lo:hi].sum(),))
            own[c].move((at_words + np.float32(prior) * q, at_bias))
    norms = np.zeros((len(firsts) - 1, classes + 1))
    for c in range(len(firsts) - 1):
        scores = (context @ target[firsts[c] : firsts[c + 1]].T + bias[firsts[c] : firsts[c + 1]]).astype(np.float64)
        top = scores.max(axis=1, keepdims=True)
        norms[c] = (top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[:, 0]
    return WordModel(context, target, bias, firsts, norms)


_COUNTS = "token long, shape int, n long"


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, shapes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, first, inverse = np.unique(tokens, return_index=True, return_inverse=True)
        return distinct, shapes[first], np.bincount(inverse, weights=counts).astype(np.int64)

    def out() -> pa.RecordBatch:
        tokens, shapes, counts = merged()
        return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(shapes, pa.int32()), pa.array(counts)], names=["token", "shape", "n"])

    for batch in batches:
        for _, _, raw, offsets in text_runs(batch.column(0)):
            tokens = Tokens(raw, offsets)
            distinct, first, counts = np.unique(tokens.hash, return_index=True, return_counts=True)
            held.append((distinct, tokens.shape[first], counts))
            size += len(distinct)
            if size > 1_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 600_000:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def _log(counts: np.ndarray) -> np.ndarray:
    return np.log10(counts + 0.5)


_SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("model", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ]
)


@dataclass(frozen=True)
class Vocabulary:
    """Which class a token belongs to, and which word it is within a shape class: words are numbered class by class, the last of each is its other tokens."""

    frequent: Members
    ranks: np.ndarray
    known: Members
    numbers: np.ndarray
    firsts: np.ndarray

    @staticmethod
    def of(tokens: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
        """From the most frequent tokens in order of their counts; and the rows of those that are classes or words of their own."""
        real = np.flatnonzero(tokens != END)
        n_words = int((counts[real] >= LEAST_SEEN).sum())
        n_frequent = min(max(FREQUENT, int(n_words**0.5)), MOST_FREQUENT)
        names = tokens[real[:n_frequent]]
        words = real[n_frequent:n_words]
        words = words[np.argsort(shapes[words], kind="stable")]
        firsts = np.searchsorted(shapes[words], np.arange(SHAPES + 1)) + np.arange(SHAPES + 1)
        numbers = np.arange(len(words)) + shapes[words]
        order = np.argsort(tokens[words], kind="stable")
        own = Vocabulary(Members(names), np.argsort(names, kind="stable") + 1, Members(tokens[words]), numbers[order], firsts)
        return own, np.concatenate((real[:n_frequent], words))

    @property
    def first_shape(self) -> int:
        return 1 + len(self.ranks)

    @property
    def n_classes(self) -> int:
        return self.first_shape + SHAPES

    def read(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class and context of every token; and of those in shape classes their places, word numbers, and whether the word is its class's other."""
        classes = tokens.classes(self.frequent, self.ranks)
        contexts = tokens.contexts(classes, self.n_classes)
        at = np.flatnonzero(classes >= self.first_shape)
        words = self.firsts[1:][classes[at] - self.first_shape] - 1
        mine, which = self.known.find(tokens.hash[at])
        words[mine] = self.numbers[which]
        rest = np.ones(len(at), dtype=bool)
        rest[mine] = False
        return classes, contexts, at, words, rest


@dataclass(frozen=True)
class Model:
    """Both levels, and the logarithms by which the tokens without vectors share what is left to them."""

    vocabulary: Vocabulary
    classes: LogBilinear
    norms: np.ndarray
    words: WordModel
    shares: np.ndarray
    head: Members
    head_logs: np.ndarray
    n_train: int
    n_distinct: int

    def log10(self, tokens: Tokens, part: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 p of every token but for the counts of rare ones, log10 (c + 0.5) of every token in the head (0 for others), and the places of the others.

        Rare tokens are other words of their classes: their own log10 (c + 0.5) is to be added.
        """
        classes, contexts, at, words, rest = self.vocabulary.read(tokens)
        shapes = classes[at] - self.vocabulary.first_shape
        gain = np.empty(len(classes))
        for lo in range(0, len(classes), part):
            here = slice(lo, lo + part)
            gain[here] = self.classes.log10(contexts[here], classes[here], self.norms)
        for lo in range(0, len(at), part):
            here = slice(lo, lo + part)
            gain[at[here]] += self.words.log10(contexts[at[here]] % (self.vocabulary.n_classes + 1), words[here], shapes[here])
        others = at[rest]
        gain[others] -= self.shares[shapes[rest]]
        found, which = self.head.find(tokens.hash)
        logs = np.zeros(len(classes))
        logs[found] = self.head_logs[which]
        gain[others] += logs[others]
        rare = np.ones(len(classes), dtype=bool)
        rare[found] = False
        return gain, logs, np.flatnonzero(rare)


def learn_model(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all training rows (column text, binary), and the counts of all tokens (token, shape, n)."""
    counts = materialize(training.select("text").mapInArrow(_count_tokens, _COUNTS).groupBy("token").agg(F.max("shape").alias("shape"), F.sum("n").alias("n")), "token-counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).toArrow()
    column = lambda name, kind: top.column(name).to_numpy().astype(kind) if top.num_rows else np.empty(0, dtype=kind)
    tokens, n, shapes = column("token", np.int64).view(np.uint64), column("n", np.int64), column("shape", np.int32)
    vocabulary, apart = Vocabulary.of(tokens, n, shapes)
    n_classes = vocabulary.n_classes
    left = np.zeros(SHAPES)
    for r in counts.where("shape >= 0").groupBy("shape").agg((F.sum("n") + 0.5 * F.count(F.lit(1))).alias("total")).collect():
        left[r["shape"]] = float(r["total"])
    left -= np.bincount(shapes[apart], weights=n[apart] + 0.5, minlength=SHAPES)
    size = (n_classes + 1) ** 2 * n_classes

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of at most MOST_COUNTED tokens, then they are put out and begin anew; they are summed as 64-bit numbers
        seen = np.zeros(size, dtype=np.uint32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, inverse = np.unique(keys, return_inverse=True)
            return distinct, np.bincount(inverse, weights=times, minlength=len(distinct)).astype(np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            codes = np.flatnonzero(seen)
            # pairs of a class and a word are numbered beyond the trigrams
            for keys, times in [(codes, seen[codes])] + [(x + size, k) for x, k in ([merged()] if held else [])]:
                for at in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000], pa.int64()), pa.array(times[at : at + 100_000].astype(np.int64))], names=["code", "n"])

        n_tokens = 0
        for batch in batches:
            for _, _, raw, offsets in text_runs(batch.column(0)):
                classes, contexts, at, words, _ = vocabulary.read(Tokens(raw, offsets))
                codes, times = np.unique(contexts * n_classes + classes, return_counts=True)
                seen[codes] += times.astype(np.uint32)
                held.append(np.unique(words * (n_classes + 1) + contexts[at] % (n_classes + 1), return_counts=True))
                if sum(len(x) for x, _ in held) > 3_000_000:
                    held = [merged()]
                n_tokens += len(classes)
                if n_tokens > MOST_COUNTED:
                    yield from counted()
                    seen[:], held, n_tokens = 0, [], 0
        yield from counted()

    gathered = materialize(training.select("text").mapInArrow(grams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "grams")

    def collected(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = part.toArrow()
        codes, times = rows.column("code").to_numpy(), rows.column("n").to_numpy()
        del rows
        order = np.argsort(codes)
        return codes[order], times[order]

    classes = train(*collected(gathered.where(F.col("code") < size)), classes=n_classes)
    codes, times = collected(gathered.where(F.col("code") >= size))
    codes = codes - size
    words = train_words(codes % (n_classes + 1), codes // (n_classes + 1), times, vocabulary.firsts, n_classes)
    order = np.argsort(tokens)
    model = Model(vocabulary, classes, classes.norms(), words, np.log10(left + 0.5), Members(tokens), _log(n[order]), int(totals["n"] or 0), int(totals["v"]))
    return model, counts


def score_texts(docs: DataFrame, modulus: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are runs of anything but ASCII white space, A-Z lower-cased, and one end per text. Rows whose
    crc32(doc_id as text) modulo `modulus` is held_out are scored but not learned from. base_score is the smoothed unigram
    log10 probability, score that of the model: p(token) = p(class | classes of the two tokens before) * p(token | class).

    The first factor is a log-bilinear model over classes: the end, the most frequent tokens alone (95 to 191, as the square root of the
    vocabulary), and 64 classes of all others by first and last letters. The second is a log-bilinear model of the words within a class after the class before: each of the
    65,536 most frequent tokens that are seen 5 times or more has a vector, and one word stands for all other tokens of the class, which share its
    probability as (c + 0.5) / (sum of c + 0.5, + 0.5 for unknown tokens), with c over all training tokens. So the probabilities of all known
    tokens and of one unknown token per class sum to 1. Both are trained on the counts of all training rows, in full epochs without draws.

    Counts are kept by 64-bit hash of the token (two of n distinct tokens share one with odds n * n / 2**65). The 65,536 most
    frequent are sent to the executors; the others' counts are joined to the documents' rare tokens, so hot tokens are never shuffled by
    document. Texts are read three times and never shuffled. Null texts are empty and have an end only; a null
    doc_id counts as empty text; repeated rows are learned from and scored each; no rows give no rows; other columns are ignored.
    """
    fold = remainder_of_id(F.col("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), (fold % modulus == held_out).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    model, counts = learn_model(texts.where("NOT held_out").select("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, offsets in text_runs(batch.column(2)):
                tokens = Tokens(raw, offsets)
                n = tokens.n_texts
                gain, logs, rare = model.log10(tokens)
                known = tokens.counts - np.bincount(tokens.text[rare], minlength=n)
                order = rare[np.lexsort((tokens.hash[rare], tokens.text[rare]))]
                h, t = tokens.hash[order], tokens.text[order]
                fresh = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))) if len(h) else np.empty(0, dtype=np.int64)
                times = np.diff(np.concatenate((fresh, [len(h)])))
                cuts = pa.array(np.searchsorted(t[fresh], np.arange(n + 1)).astype(np.int32))
                columns = [
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(tokens.counts, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(np.bincount(tokens.text, weights=logs, minlength=n)), pa.array(np.bincount(tokens.text, weights=gain, minlength=n)),
                    pa.ListArray.from_arrays(cuts, pa.array(h[fresh].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_SCORED.names)

    scored = materialize(texts.mapInArrow(score, _SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5))
    added = (
        rare.join(counts.select("token", "n"), "token", "left").groupBy("row")
        .agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    weight = float(np.log10(model.n_train + 0.5 * (model.n_distinct + 1)))
    return scored.drop("rare", "times").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.n_train).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(weight)).alias("base_score"), (F.col("model") + more).alias("score"),
    )
