"""Near-duplicates by order MinHash, with candidates verified by banded alignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import ALNUM, common_subsequence, fresh, materialize, mix, shingle_hashes, small_batches, text_runs, words_in
from .components import extended

SHINGLE = 5
SKETCHES = 24
PER_SKETCH = 4
#: Texts of at most SHORT shingles have sketches of two as well, and those of fewer than LONG only these. A text of fewer than LONG is
#: as similar as 0.8 to none of more than SHORT, so every such pair has sketches of one kind.
PER_SHORT, LONG, SHORT = 2, 40, 50
#: All pairs of a bucket of at most so many nodes are looked at.
SMALL = 64
#: In a larger one, at most so many nodes at a time are each compared with all others.
LEADERS = 512
#: Members of a bucket are dealt to tasks in groups of about this size.
DEALT = 1024
#: Shingles are ordered by how often the slots occur that they fall in: 2**LEVEL_BITS numbers of one byte, at any size of the corpus.
LEVEL_BITS = 20
#: Bins of a signature, one byte each, to tell hopeless candidates without their texts.
BINS = 512
_BIN_BITS = 9

_AT = 28
_LOW = np.uint64((1 << _AT) - 1)
_GONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.default_rng(71).integers(1, 2**63, SKETCHES + 1, dtype=np.int64).astype(np.uint64)


def _reseeded(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (x ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _nodes(words, n_texts: int, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's word sequence; texts without words are named by their bytes."""
    counts = np.bincount(words.text, minlength=n_texts)
    place = np.arange(len(words.hash)) - np.repeat(np.cumsum(counts) - counts, counts)
    terms = mix(words.hash + mix(place.astype(np.uint64) + np.uint64(1)))
    names = np.zeros(n_texts, dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        names[full] = np.add.reduceat(terms, (np.cumsum(counts) - counts)[full])
    names = mix(names ^ counts.astype(np.uint64))
    for i in np.flatnonzero(counts == 0):
        names[i] = int.from_bytes(hashlib.md5(raw[offsets[i] : offsets[i + 1]].tobytes()).digest()[:8], "little")
    return names.view(np.int64)


def sketch_texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list, list]]:
    """Per run of texts: node, number of words, bands and signature (None for texts shorter than a shingle).

    Bands are one number for each sketch of each kind that a text has. A signature is BINS bytes, then four bytes of every band of either kind.
    """
    for first, last, raw, offsets in text_runs(column):
        n = last - first
        words = words_in(raw, offsets, ALNUM)
        nodes = _nodes(words, n, raw, offsets)
        n_words = np.bincount(words.text, minlength=n)
        bands: list = [None] * n
        signatures: list = [None] * n
        hashes, whole = shingle_hashes(words, SHINGLE)
        at = np.flatnonzero(whole)
        if len(at):
            text, hashes = words.text[at], hashes[at]
            # label repeated shingles of a text by occurrence
            key = mix(hashes + mix(text.astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            occurrence = np.empty(len(order), dtype=np.uint64)
            occurrence[order] = run
            labelled = mix(hashes + occurrence * np.uint64(0x632BE59BD9B4E019))
            starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            owners = text[starts]
            index = np.arange(len(at), dtype=np.uint64) & _LOW
            sizes = np.diff(np.append(starts, len(at)))
            kinds = [(PER_SHORT, sizes <= SHORT), (PER_SKETCH, sizes >= LONG)]
            tables = np.zeros((len(kinds), len(starts), SKETCHES), dtype=np.uint64)
            for j in range(SKETCHES):
                x = (_reseeded(labelled, _SEEDS[j]) & ~_LOW) | index
                picked, places = [], []
                for _ in range(PER_SKETCH):
                    least = np.minimum.reduceat(x, starts)
                    left = least != _GONE
                    place = np.where(left, (least - index[starts]) & _LOW, _LOW).astype(np.int64)
                    picked.append(least)
                    places.append(place)
                    x[(starts + place)[left]] = _GONE
                for kind, (size, _) in enumerate(kinds):
                    order = np.argsort(np.stack(places[:size]), axis=0, kind="stable")
                    value = np.full(len(starts), j + kind * SKETCHES, dtype=np.uint64)
                    for part in np.take_along_axis(np.stack(picked[:size]), order, axis=0):
                        value = mix(value * np.uint64(31) + (part >> np.uint64(_AT)))
                    tables[kind, :, j] = value
            # a shingle's bin and value are parts of one hash; of each bin the least hash stays
            rank = np.repeat(np.arange(len(starts), dtype=np.uint64), sizes)
            cells = np.sort((rank << np.uint64(36)) | (_reseeded(labelled, _SEEDS[SKETCHES]) >> np.uint64(28)))
            bins = cells >> np.uint64(36 - _BIN_BITS)
            least = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
            marks = np.zeros((len(starts), BINS), dtype=np.uint8)
            marks.reshape(-1)[bins[least].astype(np.int64)] = (cells[least] & np.uint64((1 << 36) - 1)) % np.uint64(255) + np.uint64(1)
            present = np.stack([own for _, own in kinds], axis=1)
            digests = ((tables >> np.uint64(32)).astype(np.uint32).transpose(1, 0, 2) * present[:, :, None]).reshape(len(starts), -1)
            for row, i in enumerate(owners.tolist()):
                bands[i] = tables[present[row], row].ravel().view(np.int64)
                signatures[i] = marks[row].tobytes() + digests[row].tobytes()
        yield nodes, n_words, bands, signatures


_SKETCHED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("marks", T.BinaryType()),
    ]
)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for nodes, n_words, bands, marks in sketch_texts(batch.column(1)):
            n = len(nodes)
            columns = [batch.column(0).slice(at, n), pa.array(nodes), pa.array(n_words, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_SKETCHED.names)
            at += n


_WORDS = T.StructType([T.StructField("node", T.LongType()), T.StructField("words", T.BinaryType())])


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in text_runs(batch.column(0)):
            words = words_in(raw, offsets, ALNUM)
            nodes = _nodes(words, len(offsets) - 1, raw, offsets)
            small = (words.hash >> np.uint64(32)).astype(np.uint32)
            cuts = np.searchsorted(words.text, np.arange(len(offsets)))
            lists = [small[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(lists, pa.binary())], names=_WORDS.names)


def _runs(a: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(a) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + a[j : len(a) - k + 1 + j].astype(np.uint64)
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two multisets of integers."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def align(a: np.ndarray, b: np.ndarray, most_edits: int) -> np.ndarray | None:
    """For each word of a, its place in b in an alignment with the fewest insertions and deletions, or -1.

    Only the band of diagonals within most_edits is looked at; None if that many edits don't do. Memory is linear in the texts.
    """
    n, m = len(a), len(b)
    out = np.full(n, -1, dtype=np.int64)
    low = min(n, m)
    differ = np.flatnonzero(a[:low] != b[:low])
    head = int(differ[0]) if len(differ) else low
    differ = np.flatnonzero(a[n - low + head :][::-1] != b[m - low + head :][::-1]) if low > head else np.empty(0, dtype=np.int64)
    tail = int(differ[0]) if len(differ) else low - head
    out[:head] = np.arange(head)
    if tail:
        out[n - tail :] = np.arange(m - tail, m)
    if abs(n - m) > most_edits:
        return None
    # within most_edits, an alignment leaves the diagonal by half of what the lengths don't need
    places = common_subsequence(a[head : n - tail], b[head : m - tail], (most_edits + n - m) // 2, (most_edits + m - n) // 2)
    found = places >= 0
    if n + m - 2 * (head + tail + int(found.sum())) > most_edits:
        return None
    out[head : n - tail][found] = places[found] + head
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = 0.8, k: int = SHINGLE) -> float:
    """Shared k-word shingles over all, counting those that lie in one equal run of the alignment; 0.0 if below least.

    It equals the Jaccard similarity of occurrence-labelled shingles where texts are edited in place, and falls below
    where passages change places.
    """
    if len(a) < k or len(b) < k:
        return 1.0 if np.array_equal(a, b) else 0.0
    every = len(a) + len(b) - 2 * (k - 1)
    needed = least / (1 + least) * every - 1e-9
    if _shared(_runs(a, k), _runs(b, k)) < needed:
        return 0.0
    # a word without partner spoils the shingle that begins there
    places = align(a, b, int(every * (1 - 2 * least / (1 + least)) + 1e-9) + 2 * (k - 1))
    if places is None:
        return 0.0
    joined = (places[:-1] >= 0) & (places[1:] == places[:-1] + 1)
    sums = np.concatenate(([0], np.cumsum(joined)))
    shared = int((sums[k - 1 :] - sums[: len(sums) - k + 1] == k - 1).sum())
    return shared / (every - shared) if shared >= needed else 0.0


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])


def _verifier(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, other = (batch.column(i) for i in range(4))
            rows = []
            for i in range(batch.num_rows):
                s = aligned_similarity(np.frombuffer(one[i].as_py(), dtype=np.uint32), np.frombuffer(other[i].as_py(), dtype=np.uint32), least)
                if s >= least:
                    rows.append((a[i].as_py(), b[i].as_py(), s))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=_LINKS.names)

    return verify


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Columns of the rows to compare; the first three make a group.
_DEALT = ("bucket", "block", "salt", "lead", "node", "n_words", "component", "at", "whole", "marks")


def hopeful(one: np.ndarray, other: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of signatures agree in enough bins for the similarity. size: shingles of both.

    The bins that either text fills are draws without replacement from the shingles of both; five standard errors are allowed for.
    """
    filled = ((one | other) != 0).sum(axis=1)
    same = ((one == other) & (one != 0)).sum(axis=1)
    every = size / (1 + least)
    slack = 5 * np.sqrt(least * (1 - least) * filled * np.maximum(0.0, 1 - filled / np.maximum(every, 1))) + 1
    return same >= least * filled - slack


def _compared(least: float, at_once: int = 8192):
    """Of each group, pairs of a leader and another node of another component whose lengths and signatures allow the similarity.

    Rows come sorted by group, leaders first. A group has few leaders and a bounded number of rows, so no more than one group and one batch are held.
    A pair may meet in many buckets. whole has a bit for each sketch whose bucket looks at all pairs that a node is in (of different components); of those buckets
    that two nodes share, only the first puts the pair out.
    """
    bit = np.int64(1) << np.arange(2 * SKETCHES, dtype=np.int64)

    def pairs(columns: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(columns["node"])
        marks, digests = columns["marks"][:, :BINS], np.ascontiguousarray(columns["marks"][:, BINS:]).view(np.uint32)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        leaders = np.bincount(group, weights=columns["lead"], minlength=len(starts)).astype(np.int64)
        partners = np.minimum(np.arange(n) - starts[group], leaders[group])
        ends = np.cumsum(partners)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - partners[first] + at_once, side="right")))
            count = partners[first:last]
            x = np.repeat(np.arange(first, last), count)
            y = starts[group[x]] + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            first = last
            sizes = columns["n_words"][x] - SHINGLE + 1, columns["n_words"][y] - SHINGLE + 1
            able = (columns["component"][x] != columns["component"][y]) & (np.minimum(*sizes) >= least * np.maximum(*sizes) - 1e-9)
            x, y, size = x[able], y[able], (sizes[0] + sizes[1])[able]
            able = hopeful(marks[x], marks[y], size, least)
            x, y = x[able], y[able]
            shared = (digests[x] == digests[y]) & ((columns["whole"][x] & columns["whole"][y])[:, None] & bit != 0)
            own = (columns["whole"][x] & bit[columns["at"][x]]) != 0
            able = ~own | (shared.argmax(axis=1) == columns["at"][x])
            a, b = columns["node"][x[able]], columns["node"][y[able]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=_PAIRS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _DEALT[:-1]}
            new["marks"] = np.frombuffer(b"".join(batch.column("marks").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            rows = new if held is None else {c: np.concatenate((held[c], new[c])) for c in _DEALT}
            changed = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in _DEALT[:3]])
            starts = np.concatenate(([0], np.flatnonzero(changed) + 1))
            last = starts[-1]
            if last:
                yield from pairs({c: rows[c][:last] for c in _DEALT}, starts[:-1])
            held = {c: rows[c][last:] for c in _DEALT}
        if held is not None:
            yield from pairs(held, np.array([0]))

    return run


def _dealt(here: DataFrame, marks: DataFrame, least: float, small: int, leaders: int) -> DataFrame:
    """The hopeful pairs a, b of the open buckets' rows: bucket, node, n_words, component, n (nodes of the bucket), rest (those outside of its
    largest component), top (that component), star (the node that meets the most), starred, part (whether it is one shingle's), inner (see
    _parts; all nodes of other buckets), inners (their number)."""
    name = F.xxhash64("node")
    few = F.col("inners") < F.col("rest")
    lead = F.when(F.col("n") <= small, True).when(~F.col("starred"), F.col("node") == F.col("star")).when(few, F.col("inner")).otherwise(F.col("component") != F.col("top"))
    n_lead = F.when(F.col("n") <= small, F.col("n")).when(~F.col("starred"), F.lit(1)).otherwise(F.least("inners", "rest"))
    blocks = F.ceil(n_lead / leaders).cast("int")
    salts = F.when(F.col("n") <= small, 1).otherwise(F.ceil(F.col("n") / DEALT)).cast("int")
    rows = (
        here.withColumn("lead", lead).withColumn("blocks", blocks).withColumn("salts", salts)
        .withColumn("own_block", F.pmod(F.shiftright(name, 20), F.col("blocks")).cast("int")).withColumn("own_salt", F.pmod(name, F.col("salts")).cast("int"))
    )
    complete = ((F.col("n") <= small) | F.col("starred")) & ~F.col("part") & (F.col("blocks") == 1)
    whole = rows.where(complete).groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("whole"))
    whole = F.coalesce("whole", F.lit(0).cast("long")), rows.join(whole, "node", "left").join(marks, "node")
    # leaders stand in every salt of their own block; everything else in its own salt of every (other) block
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    place = lambda block, salt, lead: F.struct(block.alias("block"), salt.alias("salt"), lead.alias("lead"))
    as_member = F.transform(F.filter(every("blocks"), lambda b: ~F.col("lead") | (b != F.col("own_block"))), lambda b: place(b, F.col("own_salt"), F.lit(False)))
    as_leader = F.transform(every("salts"), lambda s: place(F.col("own_block"), s, F.lit(True)))
    places = F.when(F.col("lead"), F.concat(as_leader, as_member)).otherwise(as_member)
    rows = whole[1].select("bucket", F.explode(places).alias("place"), "node", "n_words", "component", "at", F.when(complete, whole[0]).otherwise(F.lit(0).cast("long")).alias("whole"), "marks")
    rows = rows.select("bucket", "place.*", "node", "n_words", "component", "at", "whole", "marks")
    rows = rows.repartition("bucket", "block", "salt").sortWithinPartitions("bucket", "block", "salt", F.desc("lead"), "node")
    return rows.mapInArrow(_compared(least), _PAIRS).distinct()


#: Stands for a null doc_id.
_NO_ID = -(2**63)


def near_classes(docs: DataFrame, least: float = 0.8, small: int = SMALL, leaders: int = LEADERS) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per row of docs (doc_id, text); kept marks the one that stays.

    Words are runs of letters and digits, A-Z lower-cased; two texts are linked if the similarity of their five-word shingles (aligned_similarity) is
    0.8 or more. A class is a connected component of links; class_id is its smallest doc_id.

    1. Texts with the same words become one node. Each node gets 24 sketches; a sketch picks the four shingles with the
       smallest hash among the occurrence-labelled ones, and keeps them in text order. Two texts of similarity 0.8 share a
       sketch with probability about 0.41, so all 24 miss about 3 in a million such pairs (6 in a million at 40 shingles). Texts of at most 50 shingles
       also get 24 sketches of two, those of fewer than 40 only these; they miss less than one in a million.
    2. Nodes with an equal sketch share a bucket. All pairs of a bucket of at most 64 nodes are looked at. The members of a larger one are first compared
       with its leader, the node that meets the most others, as the middle of a group does. That leaves few outside of the bucket's
       largest component; then these are the leaders, and every pair of different components is looked at. The members of buckets where more than 512 are
       left get a part for each of their rarest shingles instead, and each part is treated as a bucket. Two of them as similar as 0.8 always share a part (see
       prefix), so none is lost. A bucket's members are dealt to tasks in groups of about 1,024 and looked at with at most 512 leaders; only a part may have more, which
       are dealt in blocks of 512. Parts of many texts that share their rarest shingles and yet aren't linked (the same passages in other orders) so take quadratic time.
    3. A look is at lengths and signatures (512 bins of one byte), in numpy; pairs which these rule out (less than one in a million wrongly) never become
       rows. The others are verified by alignment of their whole word lists, in linear memory.

    Texts of fewer than five words are linked only if their words are equal; texts without words only if their bytes
    are; null is empty. Of each class the row with the smallest doc_id is kept, among those the one whose words have the smallest hash; rows equal in both
    are all marked. A null doc_id counts as the smallest. No rows give no rows; other columns are ignored.
    """
    out, classes = _classes(docs, least, small, leaders)
    classes = classes.select(F.col("component").alias("c_component"), F.col("first.id").alias("class_id"), F.col("first.node").alias("first_node"), "class_size")
    named = out.join(classes, F.col("component") == F.col("c_component"))
    real = lambda c: F.when(F.col(c) == _NO_ID, F.lit(None)).otherwise(F.col(c))
    kept = (F.col("id") == F.col("class_id")) & (F.col("node") == F.col("first_node"))
    return named.select(real("id").alias("doc_id"), real("class_id").alias("class_id"), "class_size", kept.alias("kept"))


def _offset() -> Column:
    """The number of a text's first band: sketches of two shingles come first, if it has any."""
    return F.when((F.size("bands") == SKETCHES) & (F.col("n_words") - SHINGLE + 1 >= LONG), SKETCHES).otherwise(0)


def labelled_runs(words: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles of a list of words: two lists share as many as their multisets of shingles do."""
    runs = np.sort(_runs(words, SHINGLE))
    at = np.arange(len(runs))
    first = np.concatenate(([True], runs[1:] != runs[:-1]))
    return mix(runs + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)


_COUNTED = T.StructType([T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << LEVEL_BITS, dtype=np.int64)
    for batch in batches:
        for words in batch.column(0).to_pylist():
            np.add.at(counts, _slots(labelled_runs(np.frombuffer(words, dtype=np.uint32))), 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=_COUNTED.names)


def _levels(texts: DataFrame) -> np.ndarray:
    """For every slot, the binary logarithm of how many shingles of texts (words) fall in it."""
    levels = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    counted = texts.select("words").mapInArrow(_slot_counts, _COUNTED).groupBy("slot").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession):
        counted = counted.select(F.col("slot").cast("int"), F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    levels[counted["slot"].to_numpy()] = counted["level"].to_numpy()
    return levels


def prefix(hashes: np.ndarray, levels: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The first (labelled) shingles of a text in one order of all shingles, rare slots first; and how many of them are inner ones.

    Texts of x and y <= x shingles, as similar as least, share s >= least / (1 + least) * (x + y) of them, so s >= least * x and s >= 2 * least / (1 + least) * y.
    Of x - s + 1 first ones of the one and y - s + 1 of the other at least one is shared. So the larger text's prefix meets the inner part of the smaller
    one's, whatever the order.
    """
    ordered = hashes[np.lexsort((hashes, levels[_slots(hashes)]))]
    n = len(ordered)
    outer, inner = (n - int(np.ceil(share * n - 1e-6)) + 1 for share in (least, 2 * least / (1 + least)))
    return ordered[:outer], inner


_ENTRIES = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("node", T.LongType()), T.StructField("component", T.LongType()), T.StructField("inner", T.BooleanType())]
)


def _prefixes(levels: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [prefix(labelled_runs(np.frombuffer(words, dtype=np.uint32)), levels, least) for words in batch.column(2).to_pylist()]
            if not firsts:
                continue
            sizes = np.array([len(first) for first, _ in firsts])
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inner = place < np.repeat([n for _, n in firsts], sizes)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            buckets = np.concatenate([first for first, _ in firsts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(inner)], names=_ENTRIES.names)

    return run


def _parts(wide: DataFrame, words: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The nodes of wide dealt anew: a bucket for each shingle of the prefixes of several of them.

    Every two whose shingles are as similar as least share a bucket in which one of them is inner. Buckets without inner nodes, or of one component only, have
    nothing to look at, and of those with the same nodes one is enough.
    """
    members = wide.select("node", "n_words", "meets").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    texts = materialize(members.join(words, "node"), "wide-texts")
    entries = materialize(texts.select("node", "component", "words").mapInArrow(_prefixes(_levels(texts), least), _ENTRIES), "prefixes")
    groups = entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node", "inner")).alias("nodes"), F.bool_or("inner").alias("any"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    groups = materialize(groups.where("any AND low <> high").groupBy("size", "nodes").agg(F.min("bucket").alias("bucket")).select("bucket"), "parts")
    rows = entries.join(groups, "bucket").join(texts.select("node", "n_words", "meets"), "node")
    return rows.select("bucket", "node", "n_words", "meets", F.lit(0).alias("at"), F.lit(True).alias("part"), "inner", F.lit(False).alias("starred"))


def _classes(docs: DataFrame, least: float, small: int = SMALL, leaders: int = LEADERS) -> tuple[DataFrame, DataFrame]:
    """id, node, component of every row of docs; and component, first (id, node of the row that stays), class_size of every class."""
    none = F.lit(_NO_ID).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.col("text").cast("binary").alias("text"))
    sketched = materialize(keyed.mapInArrow(_sketch, _SKETCHED), "sketches")
    nodes = materialize(
        sketched.groupBy("node").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "nodes"
    )
    bands = nodes.where("bands IS NOT NULL")
    entries = bands.select("node", "n_words", _offset().alias("offset"), F.posexplode("bands").alias("at", "bucket")).withColumn("at", F.col("at") + F.col("offset")).drop("offset")
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = materialize(entries.join(sizes, "bucket"), "met")
    meets = materialize(met.groupBy("node").agg(F.sum("size").alias("meets")), "meets")
    marks = materialize(bands.join(meets.select("node"), "node", "left_semi").select("node", "marks"), "marks")
    words = _word_table(keyed, nodes, meets)
    open_ = met.join(meets, "node").select("bucket", "node", "n_words", "meets", "at", F.lit(False).alias("part"), F.lit(True).alias("inner"), F.lit(False).alias("starred"))
    columns = ("bucket", "node", "n_words", "meets", "at", "part", "inner")
    labels = None
    while True:
        component = F.col("node")
        if labels is not None:
            open_ = open_.join(labels, "node", "left")
            component = F.coalesce("component", "node")
        open_ = materialize(open_.withColumn("component", component), "members")
        parts = open_.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if("inner").alias("inners"), F.max(F.struct("meets", "node")).alias("star"))
        state = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("inners").alias("inners"), F.max(F.struct("n", "component")).alias("top"), F.max("star").alias("star"))
        state = state.where(F.col("n") > F.col("top.n")).select("bucket", "n", "inners", (F.col("n") - F.col("top.n")).alias("rest"), F.col("top.component").alias("top"), F.col("star.node").alias("star"))
        here = materialize(open_.join(state, "bucket"), "open-members")
        if here.isEmpty():
            break
        wide = F.col("starred") & (F.col("n") > small) & (F.col("rest") > leaders) & ~F.col("part")
        pairs = materialize(_dealt(here.where(~wide), marks, least, small, leaders), "pairs")
        joined = pairs.join(words.toDF("a", "a_words").hint("merge"), "a").join(words.toDF("b", "b_words").hint("merge"), "b").select("a", "b", "a_words", "b_words")
        labels = extended(labels, materialize(joined.mapInArrow(_verifier(least), _LINKS), "links"))
        open_ = here.where(~F.col("starred") & (F.col("n") > small)).select(*columns, F.lit(True).alias("starred"))
        rest = here.where(wide)
        if not rest.isEmpty():
            open_ = open_.unionAll(_parts(rest, words, labels, least))
    out = sketched.select("id", "node")
    if labels is not None:
        labels = labels.select(F.col("node").alias("l_node"), "component")
        out = out.join(labels, F.col("node") == F.col("l_node"), "left").select("id", "node", F.coalesce("component", "node").alias("component"))
    else:
        out = out.select("id", "node", F.col("node").alias("component"))
    # ids first within (component, node), so that the smallest pair is taken among few rows
    firsts = out.groupBy("component", "node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = firsts.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first"), F.sum("size").alias("class_size"))
    return out, materialize(classes, "near-classes")


#: Slots that say which ids may be among some: a broadcast table of 2**SLOT_BITS / 64 rows at most, at any size of the corpus.
SLOT_BITS = 24


def _slot(column: Column) -> Column:
    return F.xxhash64(column).bitwiseAND(F.lit((1 << SLOT_BITS) - 1).cast("long"))


def _may_hold(rows: DataFrame, id_: Column, ids: DataFrame, kept: bool) -> DataFrame:
    """The rows whose id_ falls in a slot of one of the ids (one column); or, if not kept, the others. Exact joins follow, so slots shared by chance cost only time."""
    high, bits = fresh(rows, "high", "bits")
    slot = _slot(F.col(ids.columns[0]))
    slots = ids.select(F.shiftright(slot, 6).alias(high), F.expr("1L").alias("one"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int").alias("low"))
    slots = materialize(slots.groupBy(high).agg(F.bit_or(F.expr("shiftleft(one, low)")).alias(bits)), "slots")
    mine = _slot(id_)
    hit = (F.shiftright(mine, 6) == F.col(high)) & (F.call_function("bit_get", F.col(bits), mine.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return rows.join(F.broadcast(slots), hit, "left_semi" if kept else "left_anti")


def _word_table(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, words of every wanted node, from one row each. Texts whose ids share no slot with a wanted one aren't shuffled."""
    wanted = wanted.select("node")
    ids = materialize(nodes.join(wanted, "node", "left_semi").select(F.col("id").alias("w_id"), F.col("node").alias("w_node")), "wanted-nodes")
    texts = _may_hold(keyed, F.col("id"), ids.select("w_id"), True).join(ids.select("w_id").distinct().hint("merge"), F.col("id") == F.col("w_id"), "left_semi")
    texts = texts.select("text").mapInArrow(_word_lists, _WORDS)
    return materialize(texts.join(ids.hint("merge"), F.col("node") == F.col("w_node"), "left_semi").dropDuplicates(["node"]).select("node", "words"), "word-lists")


def near_dedup(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that stay: exactly one for each class of near-duplicates.

    The row is found by doc_id and word hash together, so rows of other classes with the same or no doc_id stay as well; see near_classes
    for nulls, empty and short texts, ties and repeated rows. No rows give no rows; columns of any name pass through.
    """
    out, classes = _classes(docs, least)
    kept_id, kept_node, node = fresh(docs, "kept_id", "kept_node", "node")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long"))
    several = classes.where("class_size > 1")
    # a row alone in its class stays; only texts whose ids occur in larger classes are looked at again
    touched = materialize(out.join(several.select(F.col("component").alias("c_component")), F.col("component") == F.col("c_component"), "left_semi").select("id").distinct(), "touched")
    rest = _may_hold(docs, own, touched, False)
    kept = classes.select(F.col("first.id").alias(kept_id), F.col("first.node").alias(kept_node))
    schema = T.StructType([*docs.schema.fields, T.StructField(node, T.LongType())])
    place = docs.columns.index("text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, _, raw, offsets in text_runs(batch.column(place)):
                n = len(offsets) - 1
                nodes = pa.array(_nodes(words_in(raw, offsets, ALNUM), n, raw, offsets))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, nodes], names=schema.names)
                at += n

    rows = _may_hold(docs, own, touched, True).mapInArrow(named, schema)
    rows = rows.join(kept.hint("merge"), (own == F.col(kept_id)) & (F.col(node) == F.col(kept_node)), "left_semi")
    # rows equal in id and words belong to one class, so any of them may stand for it
    return rest.unionAll(rows.dropDuplicates(["doc_id", node]).drop(node))
