"""Helpers shared by the corpus operators: tables, shared storage, and word hashing over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import new_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch, at most, while a table is written: by default 10,000 rows of up to 64 MB meet in one.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made within send batches of at most BATCH_ROWS and BATCH_BYTES to Python, or fewer if the session says so; then the settings are as before."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        before[key] = spark.conf.get(key, None)
        own = before[key] or "0"
        spark.conf.set(key, str(min(int(own), most)) if own.isdigit() and int(own) > 0 else str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors. sources.shared.remove_tables cleans up."""
    spark = df.sparkSession
    path = new_table(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df needs."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def remainder_of_id(column: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- words of many texts at once -------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words that end only at ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words made of ASCII letters and digits and of everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_SEGMENT = 1 << 21
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            tables.append(np.multiply.accumulate(row))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words(NamedTuple):
    """Words of a run of texts. bytes: the texts, A-Z lower-cased; text: each word's row in the run."""

    bytes: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefixes: dict[int, np.ndarray]

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def text_runs(column: pa.Array, most: int = _SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, last row + 1, bytes, offsets. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary()).cast(pa.large_binary())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_in(raw: np.ndarray, offsets: np.ndarray, members: np.ndarray, prefix_lengths: tuple[int, ...] = ()) -> Words:
    """Find and hash the words of a run. Long runs are hashed in segments, so memory follows the words, not 8 x bytes."""
    lowered = _LOWER[raw]
    n = len(lowered)
    inside = members[lowered]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    del inside, before, after, edge
    hashes = np.empty(len(start), dtype=np.uint64)
    prefixes = {k: np.zeros(len(start), dtype=np.uint64) for k in prefix_lengths}
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + _SEGMENT, side="right")))
        at, to = start[first], end[last - 1]
        power, inverse = _power_tables(to - at)
        sums = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(_BYTE[lowered[at:to]] * power[: to - at], out=sums[1:])
        s, e = start[first:last] - at, end[first:last] - at
        hashes[first:last] = mix((sums[e] - sums[s]) * inverse[s])
        for k, out in prefixes.items():
            long = e - s > k
            cut = np.where(long, s + k, s)
            out[first:last] = np.where(long, mix(((sums[cut] - sums[s]) * inverse[s]) ^ np.uint64(k * 0x5851F42D4C957F2D % (1 << 64))), np.uint64(0))
        first = last
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(lowered, offsets, text, start, end, hashes, prefixes)


def word_hash(word: bytes) -> int:
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(words_in(raw, np.array([0, len(raw)]), np.ones(256, dtype=bool)).hash[0])


def shingle_hashes(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k consecutive words that begin at each word, and whether they stay in one text."""
    n = len(words.hash)
    if n < k:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words.hash[j : n - k + 1 + j]
    return mix(out), words.text[: n - k + 1] == words.text[k - 1 :]


def common_subsequence(a: np.ndarray, b: np.ndarray, lower: int | None = None, upper: int | None = None, block: int = 512) -> np.ndarray:
    """For each item of a its place in b in a longest common subsequence of both, or -1.

    lower, upper: only the band of places from i - lower to i + upper is looked at for item i of a. A row of the table is
    one integer of a bit per place in the band; a zero marks a place where the length grows. Rows are kept for one block of items at a time, and
    computed again from the block's first row on the way back, so memory is linear.
    """
    n, m = len(a), len(b)
    out = np.full(n, -1, dtype=np.int64)
    if not n or not m:
        return out
    lower, upper = (n if lower is None else lower), (m if upper is None else upper)
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    froms, tos = np.searchsorted(ordered, a), np.searchsorted(ordered, a, side="right")

    def window(first: int) -> tuple[int, int]:
        lo = min(m, max(0, first - lower))
        return lo, max(lo, min(m, first + block + upper))

    def masks(first: int, last: int, lo: int, hi: int) -> list[int]:
        known: dict[int, int] = {}
        held = []
        for i in range(first, last):
            f, t = int(froms[i]), int(tos[i])
            if f == t:
                held.append(0)
                continue
            if f not in known:
                places = order[f:t]
                places = places[np.searchsorted(places, lo) : np.searchsorted(places, hi)] - lo
                if len(places) < 16:
                    known[f] = sum(1 << p for p in places.tolist())
                else:
                    bits = np.zeros(hi - lo, dtype=np.uint8)
                    bits[places] = 1
                    known[f] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            held.append(known[f])
        return held

    def rows(first: int, last: int, lo: int, hi: int, row: int) -> list[int]:
        every = (1 << (hi - lo)) - 1
        out = []
        for mask in masks(first, last, lo, hi):
            if mask:
                match = row & mask
                row = ((row + match) | (row - match)) & every
            out.append(row)
        return out

    begins = list(range(0, n, block))
    stored, row, before = [], 0, (0, 0)
    for first in begins:
        lo, hi = window(first)
        row >>= lo - before[0]
        row |= ((1 << (hi - lo)) - 1) & ~((1 << max(0, before[1] - lo)) - 1)
        stored.append(row)
        before = lo, hi
        if first != begins[-1]:
            row = rows(first, first + block, lo, hi, row)[-1]
    j = m - 1
    for first, begin in zip(reversed(begins), reversed(stored), strict=True):
        last = min(n, first + block)
        lo, hi = window(first)
        held = [begin, *rows(first, last, lo, hi, begin)]
        at = min(j, hi - 1) - lo
        for i in range(last - 1, first - 1, -1):
            if at < 0:
                break
            at = (~held[i - first + 1] & ((1 << (at + 1)) - 1)).bit_length() - 1
            # a growth that the row before has at the same place isn't this item's
            if at >= 0 and held[i - first] >> at & 1:
                out[i] = at + lo
                at -= 1
        j = min(j, at + lo) if at >= 0 else min(j, lo - 1)
    return out


class Members:
    """A set of 64-bit hashes with a fast first test."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, dtype=np.uint64))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` of members, and which key (by rank) each is."""
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        if not len(self.keys) or not len(maybe):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        rank = np.searchsorted(self.keys, hashes[maybe])
        rank[rank == len(self.keys)] = 0
        real = self.keys[rank] == hashes[maybe]
        return maybe[real], rank[real]
