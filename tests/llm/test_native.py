"""Exact dedup, line dedup, URL filters and mixing against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillsight.llm import exact_dedup, line_dedup, mixing, ranking, url_filter

DOCS = "doc_id long, text string, source string, keep_id string, size int"


def documents(spark, rows):
    """Rows (doc_id, text, source) with two columns whose names clash with the results'."""
    return spark.createDataFrame([(*r, "x", 7) for r in rows], DOCS)


ODD = [
    (1, "a b c", "s1"), (2, "a b c", "s2"), (3, "", "s1"), (4, None, None), (5, "x" * 5000 + " tail", "s3"), (6, "x" * 5000 + " tail", "s3"),
    (7, "x" * 5000 + " tale", "s3"), (7, "x" * 5000 + " tale", "s3"), (8, "é" * 3000, "s2"), (9, "long word " * 20000, "s1"), (None, "a b c", "s1"),
]


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (16, 64), (64, 12)])
def test_exact_dedup(spark, block, bits):
    rows = ODD + [(100 + i, f"text {i % 37} " * 9, "s1") for i in range(120)]
    got = exact_dedup.exact_dedup(documents(spark, rows), block, bits).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[text or ""].append(doc_id)
    expected = []
    for doc_id, text, _ in rows:
        own = groups[text or ""]
        keep = max((x for x in own if x is not None), default=None)
        expected.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


def test_ties_between_blocks_are_resolved(spark):
    texts = [(i, f"{i:04d}" * 3, "s") for i in range(400)]
    out = exact_dedup.name_texts(documents(spark, texts), block_bytes=4, bits=10)
    assert out.select("name").distinct().count() == 400


def test_names_of_blocks_and_pairs(spark):
    """Names are equal exactly when texts are, over texts of few different blocks and many numbers of blocks."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["aaaa", "bbbb", "aabb", "a"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    out = exact_dedup.name_texts(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), block_bytes=4).collect()
    names = {r.doc_id: r.name for r in out}
    assert len({(names[i], t) for i, t in enumerate(texts)}) == len(set(texts)) == len(set(names.values()))


def lines_by_hand(rows, least):
    sites, first = defaultdict(set), {}
    for doc_id, text, source in rows:
        digest = hashlib.md5((text or "").encode()).digest()
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip():
                sites[line].add(source)
                place = ((doc_id is not None, doc_id or 0), digest, pos)
                first[line] = min(first.get(line, place), place)
    out = []
    for doc_id, text, _ in rows:
        digest = hashlib.md5((text or "").encode()).digest()
        kept = [x for pos, x in enumerate((text or "").split("\n")) if len(sites[x]) < least or first[x] == ((doc_id is not None, doc_id or 0), digest, pos)]
        n = len((text or "").split("\n"))
        out.append((doc_id, text if n == len(kept) else "\n".join(kept), n, n - len(kept)))
    return out


def test_line_dedup(spark):
    rows = [(i, f"Shared banner\nown line {i}\n\nfooter {i % 2}\nShared banner" if i % 3 else f"only {i}", f"s{i % 12}") for i in range(60)]
    rows += [(90, None, "s1"), (91, "", None), (92, "Shared banner", None), (93, "two\ntwo", "s1"), (93, "other\ntwo", "s1"), (94, "own line 1\n" * 3000, "s2")]
    got = line_dedup.line_dedup(documents(spark, rows).withColumn("n_lines", F.lit(42)).withColumn("g_pos", F.lit("user's")).withColumn("_g_id", F.lit(1)), min_sites=5)
    assert got.columns == ["doc_id", "text", "source", "keep_id", "size", "n_lines", "g_pos", "_g_id", "_n_lines", "n_removed"]
    assert got.where("n_lines <> 42 OR g_pos <> 'user''s' OR _g_id <> 1").count() == 0
    got = [(r.doc_id, r.text, r._n_lines, r.n_removed) for r in got.collect()]
    key = lambda r: (r[0], r[1] or "", r[2:])
    assert sorted(got, key=key) == sorted(lines_by_hand(rows, 5), key=key)


def mix_by_hand(rows):
    sizes = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    names = sorted({s for *_, s in sizes}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(n for _, n, x in sizes if x == s) for s in names}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(size.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s] + 1e-9}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    return sizes, size, target


def test_mixing(spark):
    rows = [(i, "w " * (i % 17), ("big" if i % 3 else f"s{i % 7}")) for i in range(300)] + [(900, None, None), (901, "a b", None), (902, "x " * 30000, "s1"), (903, "a", "s1"), (903, "a", "s1")]
    got = mixing.mix_sources(documents(spark, rows)).collect()
    sizes, size, target = mix_by_hand(rows)
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, n) for d, n, _ in sizes)
    taken = defaultdict(int)
    for r in got:
        source = next(s for d, n, s in sizes if d == r.doc_id and n == r.size)
        assert r.source_size == size[source]
        assert abs(r.target - target[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix_sources(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_places_without_a_window(spark):
    rows = spark.createDataFrame([(f"s{(i * 7919) % 1000:04d}", i) for i in range(1000)] + [(None, -1)], "source string, source_size long")
    for range_rows in (100_000, 90):
        got = sorted((r.place, r.source) for r in ranking.numbered(rows.repartition(6), [F.col("source").asc_nulls_last()], "place", range_rows).collect())
        assert got == [*((i, f"s{i:04d}") for i in range(1000)), (1000, None)]


def test_targets_of_many_sources(spark):
    rng = random.Random(12)
    sizes = {f"h{i:05d}": rng.choice([0, 1, 5, 40, 900, rng.randrange(10**6)]) for i in range(700)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    _, size, target = mix_by_hand([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    assert size == sizes and all(abs(got[s] - target[s]) < 1e-3 for s in sizes)


URLS = [
    "http://example.org/es/1", "https://www.example.org/en/12", "http://example.org/en/2", "http://example.org", "http://EXAMPLE.org/ES/1", "http://shop.com/fr/x", "http://shop.com/de/",
    "http://notexample.org/es/", "http://spam.net/x", "http://a.b.spam.net/x", "http://xspam.net/", "no url", None, "http://h.net?x=http://spam.net/", "ftp://u#y", "", "http://spam.net", "http://clean.net/a",
]


def judged_by_hand(url, listed):
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "").groups() if "://" in (url or "") else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    is_listed = any(host == d or host.endswith("." + d) for d in listed)
    _, rule, verdict = max(fits, default=(0, None, "block" if is_listed else "allow"))
    return host, path, rule, verdict, is_listed


@pytest.mark.parametrize("most_bytes", [64 << 20, 1])
def test_url_filter(spark, most_bytes):
    urls = URLS + [f"http://h{i}.spam{i % 40}.net/p" for i in range(300)]
    listed = ["spam.net", *(f"spam{i}.net" for i in range(0, 40, 2)), "unseen.example"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, URLS[0], "h")], "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "key string"), most_bytes=most_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *judged_by_hand(u, listed)) for i, u in [*enumerate(urls), (0, URLS[0])]), key=str)


def test_cascade_is_exact_with_weak_filters(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 3000, 3).selectExpr("concat('k', id) as key")
    cascade = url_filter.build_cascade(universe, listed, bits_per_key=3)
    assert len(cascade.levels) > 3
    assert all(len(universe.select(bits).first()[0]) == (size + 63) // 64 * 8 for bits, size in cascade.levels)
    wrong = universe.where(cascade.contains(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 3 == 0))
    assert wrong.count() == 0


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    listed = spark.createDataFrame([], "key string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed).first().verdict == "allow"


def test_no_documents_but_empty_texts(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " ", None)]
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix_sources(documents(spark, rows)).collect()} == {(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)}
