"""Near-duplicates against all pairs, alignment against a table, components against union-find."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quillsight.llm import near_dedup as nd
from quillsight.llm.components import components


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_alignment_is_a_longest_common_subsequence(a, b):
    places = nd.align(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), len(a) + len(b))
    matched = [(i, int(j)) for i, j in enumerate(places) if j >= 0]
    assert all(a[i] == b[j] for i, j in matched)
    assert all(p[1] < q[1] for p, q in zip(matched, matched[1:], strict=False))
    assert len(matched) == lcs(a, b)


def test_alignment_gives_up_beyond_the_band():
    a, b = np.arange(50, dtype=np.uint32), np.arange(100, 150, dtype=np.uint32)
    assert nd.align(a, b, 20) is None


def shingles(words):
    seen, out = Counter(), set()
    for i in range(len(words) - 4):
        g = tuple(words[i : i + 5])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[i] = f"edit{rng.randrange(10**6)}"
        elif kind < 0.8:
            del words[i]
        else:
            words.insert(i, f"new{rng.randrange(10**6)}")
    return words


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            texts.append(" ".join(edited(base, rng.randint(0, max(1, len(base) // 30)), rng)))
    hot = [rng.choice(vocabulary) for _ in range(120)]
    texts += [" ".join(edited(hot, rng.randint(0, 3), rng)) for _ in range(60)]
    texts += ["Same, text. HERE!", "same text here", "", None, "!!!", "???", "!!!", "x", "one two three four five", "word " * 30_000]
    rng.shuffle(texts)
    return texts


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def classes_by_hand(texts, least=0.8):
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = [words(t) for t in texts]
    sets = [shingles(w) for w in lists]
    for i in range(len(texts)):
        for j in range(i):
            a, b = lists[i], lists[j]
            same = a == b if a or b else (texts[i] or "") == (texts[j] or "")
            if not same and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                same = n >= least / (1 + least) * (len(sets[i]) + len(sets[j])) - 1e-9 and nd.aligned_similarity(codes(a), codes(b)) >= least
            if same:
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


_CODES: dict = {}


def codes(w):
    return np.array([_CODES.setdefault(x, len(_CODES)) for x in w], dtype=np.uint32)


def test_classes_equal_all_pairs(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)], "doc_id long, text string, node int, class_id string").repartition(5)
    got = defaultdict(set)
    for r in nd.near_classes(rows).collect():
        got[r.class_id].add(r.doc_id)
        assert r.class_size >= 1
    assert {frozenset(g) for g in got.values()} == classes_by_hand(texts)
    assert all(min(g) == c for c, g in got.items())
    kept = nd.near_dedup(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(got)


@pytest.mark.parametrize("leaders", [64, 3])
def test_classes_equal_all_pairs_with_large_buckets(spark, leaders):
    """Leaders, then blocks or splits: sizes are set so low that a hot passage and a group of copies go through all of them."""
    rng = random.Random(23)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, base = say(60), say(120)
    texts = [" ".join([*say(rng.randint(0, 60)), *passage, *say(rng.randint(0, 60))]) for _ in range(80)]
    texts += [" ".join(edited(base, rng.randint(0, 9), rng)) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in nd.near_classes(rows, small=2, leaders=leaders).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == classes_by_hand(texts)


def classes(spark, texts, **limits):
    got = defaultdict(set)
    for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **limits).collect():
        got[r.class_id].add(r.doc_id)
    return {frozenset(g) for g in got.values()}


def test_a_pair_that_meets_in_one_wide_bucket_only(spark):
    """It shares one of the 24 sketches, with more texts than may lead."""
    import pyarrow as pa

    rng = random.Random(75747)
    base = [f"w{rng.randrange(10**6)}" for _ in range(95)]
    other = list(base)
    other[rng.randrange(8, 40)], other[rng.randrange(50, 85)] = "x", "y"
    tries = []
    for _ in range(400):
        at = rng.randrange(60)
        tries.append([*base[:at], *(f"v{rng.randrange(10**6)}" for _ in range(35)), *base[at + 35 :]])
    texts = [" ".join(t) for t in (base, other, *tries)]
    bands = np.array([b for _, _, own, _ in nd.sketch_texts(pa.array(texts)) for b in own])
    (shared,) = np.flatnonzero(bands[0] == bands[1])
    texts = [t for t, b in zip(texts, bands, strict=True) if b[shared] == bands[0, shared]]
    assert len(texts) >= 12
    by_hand = classes_by_hand(texts)
    assert frozenset({0, 1}) in by_hand and len(by_hand) == len(texts) - 1
    assert classes(spark, texts, small=2, leaders=3) == by_hand


def test_parts_with_more_leaders_than_a_block(spark):
    """The same passages in other orders share nearly all shingles, and most aren't linked."""
    rng = random.Random(3)
    passages = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(4)]
    orders = [rng.sample(passages, 4) for _ in range(24)]
    texts = [" ".join(edited([w for p in own for w in p], rng.randint(0, 2), rng)) for own in orders]
    by_hand = classes_by_hand(texts)
    assert 4 < len(by_hand) < len(texts)
    assert classes(spark, texts, small=2, leaders=3) == by_hand


def test_prefixes_of_similar_texts_meet():
    """Whatever the order of shingles, one that both prefixes hold is an inner one of the smaller text."""
    rng = random.Random(4)
    similar = 0
    orders = [np.random.default_rng(i).integers(0, 4, 1 << nd.LEVEL_BITS).astype(np.uint8) for i in range(3)]
    for _ in range(3000):
        base = [rng.randrange(rng.choice((3, 10**6))) for _ in range(rng.randint(5, 120))]
        other = list(base)
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(len(other))] = rng.randrange(10**6)
        other += [rng.randrange(10**6) for _ in range(rng.randint(0, len(base) // 4))]
        a, b = (nd.labelled_runs(np.array(w, dtype=np.uint32)) for w in (base, other))
        both = len(np.intersect1d(a, b))
        assert both == len(shingles(base) & shingles(other))
        if both < 0.8 * (len(a) + len(b) - both):
            continue
        similar += 1
        levels = rng.choice(orders)
        (small, inner), (large, _) = (nd.prefix(x, levels, 0.8) for x in sorted((a, b), key=len))
        assert set(small[:inner].tolist()) & set(large.tolist())
    assert similar > 500


def test_signatures_let_similar_pairs_through():
    """Over sizes and edits, no pair of similarity 0.8 or more is held back, and far pairs are."""
    import pyarrow as pa

    rng = random.Random(9)
    for n in (30, 150, 600, 3000):
        pairs = []
        for _ in range(60):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            pairs.append((base, edited(base, rng.randint(1, max(1, n // 45)), rng)))
            pairs.append((base, [*base[: n // 2], *(f"v{rng.randrange(10**6)}" for _ in range(n // 2))]))
        (_, n_words, _, marks) = zip(*nd.sketch_texts(pa.array([" ".join(t) for p in pairs for t in p])), strict=True)
        n_words, marks = np.concatenate(n_words), np.array([np.frombuffer(m, dtype=np.uint8)[: nd.BINS] for own in marks for m in own])
        passed = nd.hopeful(marks[::2], marks[1::2], n_words[::2] + n_words[1::2] - 8, 0.8)
        for (a, b), ok in zip(pairs, passed, strict=True):
            x, y = shingles(a), shingles(b)
            if len(x & y) >= 0.8 * len(x | y):
                assert ok
            if n >= 150 and len(x & y) < 0.5 * len(x | y):
                assert not ok


def test_alignment_of_long_texts_takes_linear_memory():
    import tracemalloc

    words = np.random.default_rng(2).integers(0, 5000, 10_000).astype(np.uint32)
    moved = np.concatenate((words[5000:], words[:5000]))
    tracemalloc.start()
    assert nd.aligned_similarity(words, moved) == 0.0
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()


def test_short_near_copies_share_a_sketch():
    import pyarrow as pa

    rng = random.Random(5)
    long = [[f"w{rng.randrange(10**6)}" for _ in range(9)] for _ in range(3000)]
    texts = [" ".join(t) for w in long for t in (w, w[:8])]
    (_, _, bands, _), *more = nd.sketch_texts(pa.array(texts))
    assert not more and all(set(bands[i].tolist()) & set(bands[i + 1].tolist()) for i in range(0, len(texts), 2))


def test_sketches_do_not_depend_on_neighbours():
    import pyarrow as pa

    say = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    texts = [say(f"t{n}x", n) for n in (5, 6, 7, 8, 9, 43, 44, 45, 54, 55, 300, 5, 60)]
    (_, _, together, marks), *_ = nd.sketch_texts(pa.array(texts))
    for text, bands, mark in zip(texts, together, marks, strict=True):
        (_, _, (alone,), (own,)), *_ = nd.sketch_texts(pa.array([text]))
        assert np.array_equal(alone, bands) and mark == own
    assert [len(b) for b in together] == [24] * 5 + [24, 48, 48, 48, 24, 24, 24, 24]


def test_similarity_of_edits_in_place():
    base = np.arange(200, dtype=np.uint32)
    other = base.copy()
    other[100] = 9999
    assert nd.aligned_similarity(base, other) == pytest.approx(191 / 201)
    other[[20, 60, 140, 180]] = 9999
    assert nd.aligned_similarity(base, other) == 0.0  # 25 of 196 shingles are gone on either side: 0.77
    assert nd.aligned_similarity(base[:4], base[:4]) == 1.0 and nd.aligned_similarity(base[:4], base[1:5]) == 0.0


def test_ids_that_are_null_or_repeated(spark):
    rows = [(1, "a b c d e f g"), (1, "other words that are not the same"), (None, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g")]
    got = nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_size) for r in got) == [(0, 4), (1, 1), (1, 4), (2, 4), (2, 4)]
    assert nd.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(11)
    say = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    a, b, c, d = (say() for _ in range(4))
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(None, a), (None, b), (None, c), (None, near(c)), (None, b), (1, a), (7, d), (7, near(a)), (7, "short one"), (8, near(d)), (None, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int").repartition(3)
    kept = [(r.doc_id, r.text or "") for r in nd.near_dedup(docs).collect()]
    of = {a: "a", near(a): "a", b: "b", c: "c", near(c): "c", d: "d", near(d): "d", "short one": "s", "": ""}
    assert sorted((of[t], i or 0) for i, t in kept) == [("", 0), ("a", 0), ("b", 0), ("c", 0), ("d", 7), ("s", 7)]
    marked = [r.doc_id for r in nd.near_classes(docs).collect() if r.kept]
    assert Counter(marked) == {None: 5, 7: 2}  # the text b stands there twice


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
