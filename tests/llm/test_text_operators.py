"""LM scoring, toxicity, license scans, HTML extraction and decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsight.llm import common, decontaminate as dc, html_text, language_model as lm, licenses, toxicity

SCHEMA = "doc_id long, text string, size int, score string"
ODD = [(90, ""), (91, None), (92, " \t\n"), (93, "x"), (93, "x"), (None, "null id"), (94, "ÀÉ très long " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)


def test_words_of_runs():
    import pyarrow as pa

    texts = ["Ab cé-d 12", "", None, "end", "x" * 50, "last\x0bword"]
    for most in (1, 10, 1000):
        seen = []
        for first, _, raw, offsets in common.text_runs(pa.array(texts).slice(0), most):
            found = common.words_in(raw, offsets, common.SPACED, (2,))
            seen += [(first + int(t), found.word(i)) for i, t in enumerate(found.text)]
        assert seen == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    h = common.word_hash
    assert len({h(w.encode()) for w in ("a", "b", "ab", "ba", "aa", "aaa")}) == 6


def tokens(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [b"</end>"]


def test_lm_scores(spark):
    rng = random.Random(1)
    nouns, verbs = [f"noun{i}" for i in range(40)], [f"verb{i}x" for i in range(40)]
    rows = [(i, " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} ." for _ in range(rng.randint(1, 40)))) for i in range(90)] + ODD
    got = lm.score_texts(frame(spark, rows)).collect()
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        expected[d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    real = [r for r in got if r.doc_id is not None and r.doc_id < 90 and r.held_out]
    assert sum(r.score for r in real) > sum(r.base_score for r in real) * 0.9
    assert all(r.score < 0 for r in got)


def test_lm_scores_equal_a_direct_evaluation(spark):
    """Each text's score from the parameters, a token at a time in plain Python, with sums over whole classes and vocabularies for the normalisers."""
    rng = random.Random(2)
    nouns = [f"noun{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(["the", "a", "no", *nouns]) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(300, "unseen words zzz the noun1"), (301, None)]
    docs = frame(spark, rows)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    training = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    model, _ = lm.learn_model(training)
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t)[:-1])
    v, net, words = model.vocabulary, model.classes, model.words
    names = {w: (int(v.ranks[np.searchsorted(v.frequent.keys, np.uint64(common.word_hash(w)))]) if np.uint64(common.word_hash(w)) in v.frequent.keys else None) for w in {x for _, t in rows for x in tokens(t)[:-1]}}
    shape = lambda w: int(lm._shapes(common.words_in(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]), common.SPACED))[0])
    number = {w: int(v.numbers[np.searchsorted(v.known.keys, np.uint64(common.word_hash(w)))]) for w in names if np.uint64(common.word_hash(w)) in v.known.keys}
    assert len(number) > 30
    left = Counter()
    for w, c in counts.items():
        if names[w] is None and w not in number:
            left[shape(w)] += c + 0.5

    def probability(one, two, w):
        """p(w | classes one before and two before)."""
        mine = 0 if w is None else names[w] if names[w] is not None else v.first_shape + shape(w)
        predicted = net.position[0] * net.context[one] + net.position[1] * net.context[two]
        scores = [math.exp(float(predicted @ net.target[c]) + float(net.bias[c])) for c in range(v.n_classes)]
        p = scores[mine] / sum(scores)
        if w is None or names[w] is not None:
            return p, mine
        lo, hi = v.firsts[shape(w)], v.firsts[shape(w) + 1]
        own = [math.exp(float(words.context[one] @ words.target[i]) + float(words.bias[i])) for i in range(lo, hi)]
        at = number.get(w, hi - 1)
        p *= own[at - lo] / sum(own)
        return (p if w in number else p * (counts[w] + 0.5) / (left[shape(w)] + 0.5)), mine

    def score(text):
        one = two = v.n_classes
        total = 0.0
        for w in [*tokens(text)[:-1], None]:
            p, mine = probability(one, two, w)
            total += math.log10(p)
            one, two = mine, one
        return total

    got = {r.doc_id: r.score for r in lm.score_texts(docs).collect()}
    few = lm.MOST_COUNTED
    try:
        lm.MOST_COUNTED = 50  # not seen by workers, but by the plan's own function
        assert np.array_equal(lm.learn_model(training)[0].classes.context, net.context)
    finally:
        lm.MOST_COUNTED = few
    for d, t in rows:
        assert got[d] == pytest.approx(score(t), abs=2e-5 * (1 + len(tokens(t)))), d


def test_lm_is_normalised():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, (lm.CLASSES + 1) ** 2 * lm.CLASSES, 5000))
    table = lm.train(codes, np.ones(len(codes), dtype=np.int64), steps=50).log10_table()
    assert (10**table).sum(axis=1) == pytest.approx(np.ones(len(table)))


def test_lm_training_reads_every_code():
    rng = np.random.default_rng(3)
    pairs = rng.permutation((lm.CLASSES + 1) ** 2)[:6000]
    codes = np.sort(pairs * lm.CLASSES + (pairs % 7) * 20)
    table = lm.train(codes, np.full(len(codes), 3, dtype=np.int64)).log10_table().ravel()
    by_class = np.log10(np.bincount(codes % lm.CLASSES)[codes % lm.CLASSES] / len(codes))
    assert table[codes].mean() > by_class.mean() + 0.3 and (table[codes] > by_class).mean() > 0.95
    assert np.array_equal(lm.train(codes, np.full(len(codes), 3), steps=9).context, lm.train(codes, np.full(len(codes), 3), steps=9).context)


def test_lm_words_depend_on_the_class_before():
    firsts = np.array([0, 4, 5, 12])
    before, words = np.divmod(np.arange(11 * 12), 12)
    counts = np.where(words == before, 400, 10)
    model = lm.train_words(before, words, counts, firsts, 10, epochs=200)
    for c in range(3):
        own = np.arange(firsts[c], firsts[c + 1])
        for v in range(11):
            p = 10 ** model.log10(np.full(len(own), v), own, np.full(len(own), c))
            assert p.sum() == pytest.approx(1, abs=1e-5)
            if v in own and len(own) > 1:
                assert p[v - firsts[c]] > 0.6


def test_lm_without_training_rows(spark):
    assert lm.score_texts(frame(spark, [])).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    got = lm.score_texts(frame(spark, [(held, "a b")])).first()
    assert (got.train_tokens, got.n_known, got.n_tokens) == (0, 0, 3) and got.base_score == pytest.approx(0)


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice("the of and to in that it was for on".split()) + rng.choice(["", "", "."]) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["idiot", "grobz" + rng.choice("abcdefg"), "vermin"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows + ODD)
    truth = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    grammar = toxicity.learn_grammar(docs, truth)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, grammar).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(600))
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[90].predicted == got[91].predicted == 0
    kept = toxicity.drop_toxic(docs, grammar)
    assert kept.schema == docs.schema and kept.count() == len(rows + ODD) - sum(r.predicted for r in toxicity.score_toxicity(docs, grammar).collect())


def read_by_hand(clause):
    """The kind of each insult and threat of a clause, as the grammar's rules say it."""
    for i, word in enumerate(clause):
        if word not in ("idiot", "kill"):
            continue
        before = clause[:i]
        negated, reported = "not" in before[-3:], "said" in before
        aimed = "you" in before[-6:] or "you" in clause[i + 1 : i + 4]
        if word == "idiot":
            yield i, "negated" if negated else "reported" if reported else "targeted" if aimed else "plain"
        elif aimed and not negated and not reported:
            yield i, "threat"


def test_composed_transducers_read_clauses_like_a_hand_written_automaton():
    rng = random.Random(6)
    matcher = toxicity.Matcher({common.word_hash(b"idiot"): (2.0, 1.0)})
    factor = dict(zip(toxicity.KINDS, toxicity._FACTOR, strict=True))
    texts = ["", "...", "idiot", "not " + "x " * 500 + "idiot"]
    for _ in range(300):
        clauses = [[rng.choice(["idiot", "kill", "you", "not", "said", *["w"] * rng.randint(1, 9)]) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([". ", "! ", ", ", "\n", "; "]).join(" ".join(c) for c in clauses))
    offsets = np.cumsum([0] + [len(t) for t in texts])
    words = common.words_in(np.frombuffer("".join(texts).encode(), dtype=np.uint8), offsets, common.ALNUM, toxicity.STEMS)
    found = matcher.matches(words)
    expected = []
    for i, text in enumerate(texts):
        at = 0
        for clause in re.split(r"[.!?;:,()\n\"]", text):
            expected += [(i, at + j, kind) for j, kind in read_by_hand(clause.split())]
            at += len(clause.split())
    firsts = np.searchsorted(words.text, found.text)
    assert list(zip(found.text.tolist(), (found.word - firsts).tolist(), [toxicity.KINDS[k] for k in found.kind], strict=True)) == expected
    assert found.weight.tolist() == pytest.approx([(3.0 if kind == "threat" else 2.0) * factor[kind] for *_, kind in expected])
    for w, lo, hi in zip(found.word, found.firsts[found.clause], found.lasts[found.clause], strict=True):
        assert lo <= w <= hi and words.text[lo] == words.text[hi]


def test_composition():
    a, b = toxicity.scope(toxicity.NEGATION, 2, toxicity.NEGATED), toxicity.scope(toxicity.TARGET, None, toxicity.AIMED)
    both = toxicity.compose(a, b)
    rng = np.random.default_rng(1)
    for _ in range(200):
        symbols = rng.choice([0, 1, 2, 3, 4, toxicity.INSULT, toxicity.THREAT], 30)
        none, start = np.zeros(30, dtype=np.int64), np.array([0])
        assert np.array_equal(both.run(symbols, none, start)[0], b.run(a.run(symbols, none, start)[0], none, start)[0])


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "you idiot"), (2, "they said he is no idiot"), (3, "we will kill you"), (4, "kind words")])
    grammar = toxicity.learn_grammar(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, grammar).collect()}
    assert (got[1].worst_kind, got[2].worst_kind, got[3].worst_kind, got[4].worst_kind) == ("targeted", "negated", "threat", None)
    assert got[4].score < got[2].score < got[1].score
    assert toxicity.score_toxicity(docs.limit(0), grammar).count() == 0


def license_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [p for p, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License."), (2, "the mit\nlicense, MIT LICENSE and Apache License, Version 2.0"), (3, "GNU General Public License, version 3 or later"),
        (4, "Licensed under CC BY-NC 4.0."), (5, "SPDX-License-Identifier: BSD-3-Clause"), (6, "mit der Zeit; license"), (7, "All rights reserved."), (8, "mit-license mit\x00license"), *ODD,
    ]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *license_by_hand(t)) for d, t in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[2] == "apache,apache-2.0,mit" and labels[4] == "cc-by-nc-4.0" and labels[5] == "bsd-3-clause" and labels[3] == "gpl,gpl-3.0" and labels[6] == "" and labels[7] == "all-rights-reserved"
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        # no interval lies within another
        spans = sorted((s.start, -s.end) for s in r.spans)
        assert all(a[0] < b[0] and a[1] > b[1] for a, b in zip(spans, spans[1:], strict=False))
        text = (next(t for d, t in rows if d == r.doc_id) or "").lower()
        assert all("licen" in text[s.start : s.end] or "rights" in text[s.start : s.end] or "cc by" in text[s.start : s.end] for s in r.spans)
    assert len(licenses.signatures()) > 300
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_detections_within_others_go():
    rng = random.Random(3)
    for _ in range(300):
        found = [licenses.Detection(rng.choice("abc"), at, at + rng.randrange(1, 12), rng.choice([20, 40, 60])) for at in (rng.randrange(30) for _ in range(rng.randrange(40)))]
        kept = []
        for x in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
            if not any(y.start <= x.start and x.end <= y.end for y in kept):
                kept.append(x)
        assert licenses.resolve(found) == sorted(kept, key=lambda d: (d.start, d.end, d.label))


def test_scan_equals_all_rules_without_gates(spark):
    """The whole result by hand: every rule on every text, what lies within a stronger detection goes, places in characters."""
    rng, rules = random.Random(17), licenses.signatures()
    pieces = [_examples(re._parser.parse(r.pattern.pattern), rng.randrange).decode("latin-1") for r in rules for _ in range(2)]
    texts = [" ".join(rng.choice([rng.choice(pieces), "mit license", "Apache License", "some words", "é", "the"]) for _ in range(rng.randint(0, 12))) for _ in range(250)]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        data = low.encode()
        found = [(r.label, m.start(), m.end(), r.priority) for r in rules for m in r.pattern.finditer(data)]
        kept = []
        for x in sorted(found, key=lambda d: (-d[3], d[1] - d[2], d[1], d[0])):
            if not any(y[1] <= x[1] and x[2] <= y[2] for y in kept):
                kept.append(x)
        size = lambda at, data=data: len(data[:at].decode("utf-8", "ignore"))
        assert sorted((s.label, s.start, s.end, s.priority) for s in got[i].spans) == sorted((a, size(b), size(c), d) for a, b, c, d in kept)
        base = {x for x in license_by_hand(text)[4].split(",") if x}
        assert got[i].labels == ",".join(sorted(base | {k[0] for k in kept}))
        assert got[i].score == max([k[3] / 100 for k in kept] + [0.5] * bool(base), default=0.0)


def test_many_notices_in_one_text(spark):
    import time

    text = "é Licensed under the MIT License, and the BSD license.\n" * 20_000
    began = time.time()
    got = licenses.scan_licenses(frame(spark, [(1, text)])).first()
    assert got.n_found >= 40_000 and got.labels == "bsd,mit" and time.time() - began < 60
    assert all(text[s.start : s.end].endswith(("License", "license")) for s in got.spans[-50:])


def _examples(parsed, pick):
    """A text that a parsed pattern matches; pick(n) chooses among n alternatives or numbers of repeats."""
    out = b""
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out += bytes([value])
        elif name == "ANY":
            out += b"x"
        elif name == "IN":
            what, x = value[pick(len(value))]
            out += {"CATEGORY_SPACE": b" ", "CATEGORY_DIGIT": b"1", "CATEGORY_WORD": b"w"}[str(x)] if str(what) == "CATEGORY" else bytes([x[0] if str(what) == "RANGE" else x])
        elif name == "SUBPATTERN":
            out += _examples(value[3], pick)
        elif name == "BRANCH":
            out += _examples(value[1][pick(len(value[1]))], pick)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += b"".join(_examples(value[2], pick) for _ in range(value[0] + pick(min(value[1] - value[0], 2) + 1)))
        else:
            assert name in ("AT", "ASSERT_NOT"), name
    return out


def test_every_rule_passes_its_gate(spark):
    rng, matched = random.Random(8), 0
    for rule in licenses.signatures():
        assert rule.gate, rule.pattern
        for _ in range(40):
            text = _examples(re._parser.parse(rule.pattern.pattern), rng.randrange)
            if rule.pattern.search(text):
                matched += 1
                assert all(any(x in text for x in group) for group in rule.gate), (rule.pattern, text)
    assert matched > 10_000
    wanted = {
        "FreeBSD License": "bsd-2-clause", "0BSD license": "0bsd", "Beerware license": "beerware", "PNG Reference Library License": "libpng", "a BSD-style licence": "bsd",
        "Public Domain Dedication and License": "pddl", "MIT Licensed code": "mit", "GPL3": "gpl", "Open Data Commons Attribution License": "odc-by", "under MIT\u00e9": "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, list(enumerate(wanted)))).collect()}
    assert [got[i] for i in range(len(wanted))] == list(wanted.values())


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav>"
    "<!-- note --><div class=\"ad\">Buy  now</div><article><h1>Head &lt;1&gt;</h1><p><b>One  two<br>three.<p>Four&nbsp;five &eacute;</p><aside>aside</aside><form>f<input></form>"
    "<div id=comments><p>reader</p></div><ul><li>a<li>b</ul></article><footer>&copy; foot</footer></body></html>"
)


def test_html_extraction(spark):
    rows = [(1, "http://a.com/x/1", PAGE), (2, "http://a.com/x/2", PAGE.replace("Four", "Vier")), (3, None, None), (4, "http://b.com/", ""), (5, "http://b.com/q", "plain <b>te</b>xt &amp"), (5, "http://b.com/q", "plain <b>te</b>xt &amp"), (6, "http://c.com/", PAGE[: PAGE.index("Four") + 4])]
    got = html_text.extract_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert texts[1] == "Head <1>\nOne two three.\nFour five é\na\nb"
    assert texts[2] == texts[1].replace("Four", "Vier")
    assert texts[3] == texts[4] == "" and texts[6] == "Head <1>\nOne two three.\nFour"


def test_headers_go_wherever_they_stand(spark):
    page = "<header>top</header><article><header><h1>title</h1>by me</header><h2>part</h2><p>text</p><footer>notes</footer></article>"
    got = html_text.extract_text(spark.createDataFrame([(1, "http://a.com/", page)], "page_id long, url string, html string")).first()
    assert got.text == "part\ntext"


def test_long_pages(spark):
    """Many lines are aligned in memory that grows with them, not with their square."""
    import tracemalloc

    a, b = ([f"own {name} {i}" if i % 3 else f"shared {i}" for i in range(30_000)] for name in "ab")
    tracemalloc.start()
    assert html_text.shared_lines(a, b) == set(range(0, 30_000, 3))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_page_differencing(spark):
    page = "<body><p>Site banner</p><p>{}</p><p>Site terms</p></body>"
    rows = [(i, f"http://h.com/d/{i}", page.format(f"own {i}")) for i in range(6)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own {i}" for i in range(6)} and all(r.n_shared == 2 for r in got)


def extracted(spark, rows, parts):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    size = sum(len(r[2]) for r in rows)
    return sorted((tuple(r) for r in html_text.extract_text(pages, size // parts + 1).collect()), key=lambda r: (r[0] or 0, r[2]))


def test_alignment_decides_within_articles(spark):
    page = "<body><nav>menu</nav><article><p>Share this story</p><p>Story {0}: {1}</p><p>Read our newsletter</p></article></body>"
    rows = [(i, f"http://h.com/d/{i}", page.format(i, " ".join(f"w{i}x{j}" for j in range(30)))) for i in range(5)]
    rows += [(10, "http://h.com/d/1/copy", rows[1][2]), (11, "http://copy.com/1", rows[0][2]), (12, "http://copy.com/2", rows[0][2].replace("Share", "Spread"))]
    got = {r[0]: r for r in extracted(spark, rows, 3)}
    assert all(got[i][2] == f"Story {i}: " + " ".join(f"w{i}x{j}" for j in range(30)) and got[i][4] == 3 for i in range(5))
    assert got[10][2] == got[1][2]
    assert got[11][2].startswith("Share this story") and got[12][2].startswith("Spread") and got[11][4] == got[12][4] == 0


def test_pairing_ignores_copies_and_ranges(spark):
    page = "<body><p>Site banner</p><p>{}</p><p>Site terms</p></body>"
    rows = [(i, f"http://h.com/d/{i:03d}", page.format(f"own {i // 9}")) for i in range(60)] + [(None, "http://h.com/d/007", page.format("own 0"))] * 3
    rows += [(100 + i, f"http://g{i % 4}.com/{i:03d}", page.format(f"g {i % 7}")) for i in range(40)] + [(200 + i, "http://same.com/x", page.format("same")) for i in range(5)]
    one = extracted(spark, rows, 1)
    assert {r[2] for r in one if r[0] is None or r[0] < 100} == {f"own {i}" for i in range(7)}
    assert all(r[2] == "Site banner\nsame\nSite terms" for r in one if r[0] and r[0] >= 200)
    assert len(one) == len(rows) and extracted(spark, rows, 7) == one and extracted(spark, rows, 40) == one


def extracted_by_hand(rows):
    """Pairing over the whole sorted table and a table of common lengths, for pages of p elements in a body or an article."""
    import hashlib

    def key(row):
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", row[1]).groups()
        return host, path, row[0] is not None, row[0] or 0

    def blocks(page):
        return re.findall(r"<p>(.*?)</p>", page)

    def body(page):
        inner = re.search(r"<article>(.*)</article>", page)
        return blocks(inner[1] if inner else page)

    def common_blocks(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                size[i][j] = 1 + size[i + 1][j + 1] if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
        out, i, j = set(), 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(a[i])
                i, j = i + 1, j + 1
            elif size[i + 1][j] >= size[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    def alike(path, other):
        n = 0
        while n < min(len(path), len(other)) and path[n] == other[n]:
            n += 1
        return path[:n].count("/"), n

    table = sorted(rows, key=lambda r: (*key(r), hashlib.md5(r[2].encode()).digest()))
    out = []
    for at, (page_id, _, page) in enumerate(table):
        host, path = key(table[at])[:2]
        near = []
        for step in (-1, 1):
            i = at + step
            while 0 <= i < len(table) and key(table[i])[0] == host and body(table[i][2]) == body(page):
                i += step
            if 0 <= i < len(table) and key(table[i])[0] == host:
                near.append(table[i])
        near.sort(key=lambda r: [-x for x in alike(path, key(r)[1])])
        own, gone = body(page), set()
        for other in near:
            shared = common_blocks(blocks(page), blocks(other[2])) & set(own)
            if "<article>" not in page or 2 * sum(map(len, shared)) < sum(map(len, own)):
                gone = shared
                break
        out.append((page_id or 0, "\n".join(x for x in own if x not in gone)))
    return sorted(out)


def test_extraction_equals_brute_force(spark):
    """Pages of several hosts, with frames that change along the paths, copies, near copies, articles and pages without; whatever the ranges."""
    rng = random.Random(31)
    rows = []
    for host in ("a.org", "b.org", "c.org", "lone.org"):
        pages = []
        for i in range(1 if host == "lone.org" else 30):
            frame = [f"banner {host}", f"section {i // 7} {host}", f"terms {host}", f"contact {i // 11} {host}"]
            own = [f"{host} own {i} {j} " + "w" * rng.randint(3, 60) for j in range(rng.randint(1, 6))]
            if pages and rng.random() < 0.25:
                own = list(rng.choice(pages))
                own = own if rng.random() < 0.5 else [*own[:-1], f"changed {i}"]
            pages.append(own)
            inner = "".join(f"<p>{x}</p>" for x in [frame[1], *own, frame[3]])
            inner = f"<article>{inner}</article>" if rng.random() < 0.5 else inner
            rows.append((len(rows) + 1, f"http://{host}/s{i // 7}/p{rng.randrange(100):02d}", f"<body><p>{frame[0]}</p>{inner}<p>{frame[2]}</p></body>"))
    rows += [rows[3], rows[3], (None, rows[40][1], rows[40][2])]
    expected = extracted_by_hand(rows)
    for parts in (1, 5, 30):
        assert sorted((r[0] or 0, r[2]) for r in extracted(spark, rows, parts)) == expected


def test_shared_lines_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next_row(row, x, b)
        shared = html_text.shared_lines(a, b)
        assert len(shared) == row[-1]
        it = iter(b)
        assert all(a[i] in it for i in sorted(shared))


def _next_row(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
    return new


def leaks_by_hand(docs, items, least=0.8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) if w else Counter()
    own = [(i, words(t), grams(words(t))) for i, t in items if words(t)]
    weight = lambda g: len(set(g))
    out = set()
    for d, t in docs:
        w = words(t)
        for i, iw, ic in own:
            n, k = len(iw), min(5, len(iw))
            for p in range(len(w) - n + 1):
                window = Counter(tuple(w[q : q + k]) for q in range(p, p + n - k + 1))
                if not window.keys() & ic.keys():
                    continue
                both = sum(min(c, ic[g]) * weight(g) for g, c in window.items())
                every = sum(c * weight(g) for g, c in window.items()) + sum(c * weight(g) for g, c in ic.items()) - both
                if both / every >= least - 1e-12:
                    out.add((d, i))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(12, 60)))) for i in range(25)] + [(50, "three word item"), (51, ""), (52, None), (53, "a b c d e"), (54, " ".join(["rep"] * 20))]
    docs = []
    for d in range(120):
        text = say(rng.randint(5, 200))
        if d % 3 == 0:
            item = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                item[rng.choice([0, 1, -1, rng.randrange(len(item))])] = rng.choice(vocabulary)
            at = rng.randrange(len(text) + 1)
            text[at:at] = item if d % 2 else [w.upper() + "," for w in item]
        docs.append((d, " ".join(text)))
    docs += [(200, "so three WORD, item!"), (201, "rep " * 400), (202, "x a b c d e y"), *((d if d is None else d + 1000, t) for d, t in ODD)]
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = dc.find_leaks(frame(spark, docs), benchmark)
    expected = leaks_by_hand(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected and len(expected) > 20
    small = dc.find_leaks(frame(spark, docs), benchmark, most_bytes=500)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == expected
    clean = dc.decontaminate(frame(spark, docs), benchmark)
    assert clean.columns == ["doc_id", "text", "size", "score"]
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in docs if d not in {x for x, _ in expected})
    assert dc.find_leaks(frame(spark, docs), benchmark.limit(0)).count() == 0 and dc.find_leaks(frame(spark, []), benchmark).count() == 0


def short_leaks_by_hand(docs, items, least=0.8):
    """Documents shorter than an item, compared as a whole."""
    out = set()
    for d, t in docs:
        for i, item in items:
            w, own = (t or "").split(), (item or "").split()
            k = min(5, len(own))
            if k <= len(w) < len(own):
                a, b = (Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1)) for x in (w, own))
                both = sum(n * len(set(g)) for g, n in (a & b).items())
                if both / (sum(n * len(set(g)) for g, n in (a | b).items())) >= least - 1e-12:
                    out.add((d, i))
    return out


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(9)
    say = lambda n: [f"v{rng.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([60, 60, 50, 30, 12, 6, 4])] + [(50, " ".join(["rep"] * 40)), (51, "a b c d")]
    docs = [(0, " ".join(items[0][1].split()[:50]))]
    for i, item in items:
        w = item.split()
        for cut in range(1, len(w)):
            docs += [(1000 + 100 * i + cut, " ".join(w[:-cut])), (20000 + 100 * i + cut, " ".join(w[cut:])), (40000 + 100 * i + cut, " ".join(w[: len(w) // 2] + w[len(w) // 2 + cut :]))]
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    expected = short_leaks_by_hand(docs, items) | leaks_by_hand(docs, items)
    got = dc.find_leaks(frame(spark, docs), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and (0, 0) in expected and len(expected - leaks_by_hand(docs, items)) > 50
    assert next(r.similarity for r in got if (r.doc_id, r.item_id) == (0, 0)) == pytest.approx(46 / 56, abs=0.01)
    assert {r.doc_id for r in dc.decontaminate(frame(spark, docs), benchmark).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    index = dc.BenchmarkIndex([(i, " ".join(f"w{rng.integers(500)}" for _ in range(20)).encode()) for i in range(30)])
    own = index.index[20].prints
    for _ in range(300):
        row = int(rng.integers(len(own)))
        flips = rng.choice(64, int(rng.integers(0, 24)), replace=False)
        bits = np.unpackbits(own[row])
        bits[flips] ^= 1
        value = np.packbits(bits)
        _, found = index.index[20].near(value[None])
        assert row in found and set(found.tolist()) == {i for i in range(len(own)) if np.unpackbits(own[i] ^ value).sum() <= 23}


def test_windows_of_long_documents_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{rng.integers(300)}" for _ in range(40)).encode()) for i in range(20)]
    index = dc.BenchmarkIndex(items)
    text = np.concatenate([index.words[int(rng.integers(20))] if rng.random() < 0.3 else rng.integers(1, 2**62, 40, dtype=np.uint64) for _ in range(5000)])
    tracemalloc.start()
    found = index.in_text(text)
    assert len(found) == 20 and all(s == pytest.approx(1) for *_, s in found)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
