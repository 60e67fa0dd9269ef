"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ALNUM, Members, text_runs, words_in

BLOCKS = 8
_BLOCK_VALUES = np.arange(256, dtype=np.uint8)
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's words; a shorter text is one shingle."""
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - k + 1 + j]
    return out


def _weights(hashes: np.ndarray, k: int) -> np.ndarray:
    """A shingle weighs as much as it has different words, so that repeated words count little."""
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.ones(n)
    for j in range(1, k):
        out += np.logical_and.reduce([hashes[j : j + n] != hashes[i : i + n] for i in range(j)])
    return out


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((mixed ^ (mixed >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash fingerprints as 8 bytes each, from rows of 64 weighted sums."""
    return np.packbits(sums > 0, axis=1)


def weighted_similarity(a: Counter, a_weights: dict[int, float], b: Counter, b_weights: dict[int, float]) -> float:
    """Weighted Jaccard similarity of two multisets of shingles; a shingle in both has one weight."""
    both = sum(min(n, b[s]) * a_weights[s] for s, n in a.items() if s in b)
    return both / (sum(n * a_weights[s] for s, n in a.items()) + sum(n * b_weights[s] for s, n in b.items()) - both)


def _fingerprint_sums(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Prefix sums of the weighted signs: a window's sums are the difference of two rows."""
    sums = np.zeros((len(shingles) + 1, 64))
    np.cumsum(_signs(shingles) * weights[:, None], axis=0, out=sums[1:])
    return sums


class HammingIndex:
    """Fingerprints of 8 bytes by each of their bytes. Two that differ in `radius` bits at most have a byte that differs in radius // 8 at most.

    For every block and value there is a bit for each fingerprint, set if its block differs from the value in no more bits than that.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        reach = radius // BLOCKS
        self.blocks = np.stack([np.packbits(_POPCOUNT[_BLOCK_VALUES[:, None] ^ prints[None, :, b]] <= reach, axis=1) for b in range(BLOCKS)])

    def near(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (row of wanted, row of the fingerprints) within the radius."""
        found = np.bitwise_or.reduce([self.blocks[b][wanted[:, b]] for b in range(BLOCKS)])
        rows, own = np.nonzero(np.unpackbits(found, axis=1, count=len(self.prints)))
        close = _POPCOUNT[wanted[rows] ^ self.prints[own]].sum(axis=1) <= self.radius
        return rows[close], own[close]


@dataclass
class BenchmarkIndex:
    """Items by length, each length with an index of its fingerprints; and the shingles of all items, which tell windows that hold no item."""

    items: list[tuple[int, bytes]]
    k: int = 5
    similarity: float = 0.8
    radius: int = 23

    def __post_init__(self) -> None:
        self.words = [words_in(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), ALNUM).hash for _, text in self.items]
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w):
                by_length[len(w)].append(i)
        self.by_length = dict(sorted(by_length.items()))
        self.index: dict[int, HammingIndex] = {}
        self.totals = np.zeros(len(self.items))
        self.least: dict[int, float] = {}
        keys: dict[int, list[np.ndarray]] = defaultdict(list)
        for n, own in self.by_length.items():
            prints = np.empty((len(own), BLOCKS), dtype=np.uint8)
            for row, i in enumerate(own):
                shingles, weights = _shingles(self.words[i], self.k), _weights(self.words[i], self.k)
                self.totals[i] = weights.sum()
                prints[row] = _fingerprints(_fingerprint_sums(shingles, weights)[-1:])[0]
                keys[min(self.k, n)].append(shingles)
            self.index[n] = HammingIndex(prints, self.radius)
            self.least[n] = float(self.totals[own].min())
        # items of fewer than k words are one shingle of their own length
        self.members = {size: Members(np.concatenate(own)) for size, own in sorted(keys.items())}
        self.counted: dict[int, tuple[Counter, dict[int, float]]] = {}

    def _similarity(self, shingles: np.ndarray, weights: np.ndarray, i: int) -> float:
        """Of a window and item i, exactly."""
        if i not in self.counted:
            if len(self.counted) > 10_000:
                self.counted.clear()
            own = _shingles(self.words[i], self.k).tolist()
            self.counted[i] = Counter(own), dict(zip(own, _weights(self.words[i], self.k).tolist(), strict=True))
        own = shingles.tolist()
        return weighted_similarity(Counter(own), dict(zip(own, weights.tolist(), strict=True)), *self.counted[i])

    def in_text(self, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item row, first word, windows, similarity) of the items that a text holds."""
        found: dict[int, tuple[float, int, int]] = {}
        for size, members in self.members.items():
            if len(hashes) < size:
                continue
            shingles, weights = _shingles(hashes, size), _weights(hashes, size)
            known = np.zeros(len(shingles))
            at, _ = members.find(shingles)
            if not len(at):
                continue
            known[at] = weights[at]
            known, every = (np.concatenate(([0.0], np.cumsum(x))) for x in (known, weights))
            for n, index in self.index.items():
                if min(self.k, n) != size:
                    continue
                # a document shorter than the item is one window
                width = min(n, len(hashes)) - size + 1
                # what a window shares with an item is known, and must be this share of the window's and of the item's weight
                if known[-1] < self.similarity * self.least[n] - 1e-9:
                    continue
                held = known[width:] - known[:-width]
                starts = np.flatnonzero(held >= self.similarity * np.maximum(every[width:] - every[:-width], self.least[n]) - 1e-9)
                if len(starts):
                    self._search(n, index, starts, width, shingles, weights, known, every, found)
        return [(i, p, windows, s) for i, (s, p, windows) in sorted(found.items())]

    def _search(self, n: int, index: HammingIndex, starts: np.ndarray, width: int, shingles: np.ndarray, weights: np.ndarray, known: np.ndarray, every: np.ndarray, found: dict) -> None:
        """Look up the windows' fingerprints among the items of n words, and check what is within the radius."""
        items = np.array(self.by_length[n])
        share = self.similarity / (1 + self.similarity)
        while len(starts):
            # windows of a stretch share prefix sums; a stretch has a bounded length
            first, size = int(starts[0]), int(np.searchsorted(starts, starts[0] + _STRETCH))
            here, starts = starts[:size], starts[size:]
            last = int(here[-1]) + width
            sums = _fingerprint_sums(shingles[first:last], weights[first:last])
            prints = _fingerprints(sums[here - first + width] - sums[here - first])
            rows, own = index.near(prints)
            at, own = here[rows], items[own]
            # both sides' weights bound what they can share
            able = known[at + width] - known[at] >= share * (every[at + width] - every[at] + self.totals[own]) - 1e-9
            for p, i in zip(at[able].tolist(), own[able].tolist(), strict=True):
                s = self._similarity(shingles[p : p + width], weights[p : p + width], i)
                if s >= self.similarity - 1e-12:
                    best, where, windows = found.get(i, (0.0, 0, 0))
                    found[i] = (s, p, windows + 1) if s > best else (best, where, windows + 1)

    def in_column(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """(row, items found) of the texts that hold any."""
        for first, _, raw, offsets in text_runs(column):
            words = words_in(raw, offsets, ALNUM)
            touched = []
            for size, members in self.members.items():
                hashes, whole = _raw_shingles(words, size)
                at, _ = members.find(hashes)
                touched.append(words.text[at[whole[at]]])
            for text in np.unique(np.concatenate(touched)).tolist() if touched else ():
                lo, hi = np.searchsorted(words.text, [text, text + 1])
                if found := self.in_text(words.hash[lo:hi]):
                    yield first + text, found


#: Windows that begin within so many words of each other are fingerprinted together.
_STRETCH = 4096


def _raw_shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(words.hash)
    if n < k:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    return _shingles(words.hash, k), words.text[: n - k + 1] == words.text[k - 1 :]


def benchmark_items(benchmark: DataFrame, most_bytes: int = 8 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of at most most_bytes of text (one item more where a single one is longer).

    Each block is one pass over the documents. Its index is built once, on the driver, and takes about ten times the block's bytes (80 MB), so what is sent to
    the executors has a bound at any size of the benchmark.
    """
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct().sort("item_id", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


LEAKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("n_windows", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 23, k: int = 5, most_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, first_word, n_windows, similarity: one row per document and benchmark item that it holds.

    Words are runs of letters and digits, A-Z lower-cased. A window as long as an item (in words) has a 64-bit SimHash of its weighted
    k-word shingles. Fingerprints are cut into 8 blocks; within radius 23 at least one block differs in two
    bits at most, so the block index of the items of that length gives every fingerprint within the radius. Those items are
    checked exactly: the weighted Jaccard similarity of window and item must reach `similarity`. A shingle weighs
    as much as it has different words. Only windows are fingerprinted of whose weight that share lies in shingles that occur in any item at all; others can't
    reach it, whichever the item. A document shorter than an item is one window: a
    benchmark item without a few words is a leak too. first_word is the best window's, the first among equals; n_windows counts the windows.

    Texts are read once per block of benchmark items and never shuffled. Null and empty texts hold nothing; items without words
    are ignored; items shorter than k words are one shingle; equal items are all reported; repeated rows give repeated
    results; empty tables give no rows; other columns are ignored.
    """
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for items in benchmark_items(benchmark, most_bytes):

        def search(batches: Iterator[pa.RecordBatch], index=BenchmarkIndex(items, k, similarity, radius)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[row].as_py(), index.items[i][0], p, windows, s) for row, found in index.in_column(batch.column(1)) for i, p, windows, s in found]
                columns = list(zip(*rows, strict=True)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=LEAKS.names)

        out = out.unionAll(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(search, LEAKS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 23, k: int = 5, most_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item. Nothing is shuffled.

    Null and empty texts hold nothing and stay; repeated rows fare alike; empty tables take nothing away; columns of any name pass through. See find_leaks.
    """
    for items in benchmark_items(benchmark, most_bytes):

        def clean(batches: Iterator[pa.RecordBatch], index=BenchmarkIndex(items, k, similarity, radius)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _ in index.in_column(batch.column("text")):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
