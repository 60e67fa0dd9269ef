"""Every operator and every pipeline stage over the same odd rows: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillsight.llm import decontaminate, exact_dedup, html_text, language_model, licenses, line_dedup, mixing, near_dedup, toxicity, url_filter

LONG = " ".join(f"wörd{i % 5003} is idiot-proof." if i % 400 == 0 else f"wörd{i % 5003}" for i in range(160_000))
TEXTS = [None, "", " \t\n", "\n\n\n", "x", "one two three four", "...", "é́\U0001f642", "You idiot. " * 3, LONG, LONG + " tail", "a b\nc d\na b"]
#: Names that operators use inside, or for results.
CLASHES = ("key", "size", "score", "node", "bucket", "n_lines", "n_removed", "class_id", "keep_id", "taken", "kept_id", "kept_node", "g_pos", "high", "bits", "item_id", "host", "listed", "text_sha256", "place", "name", "row")


def documents(spark, empty=False):
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], rows[9], (None, "null id", None, None, None), (None, None, None, None, None), (3, "another text of id 3", "en", "s2", 20)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]).repartition(3), rows


def labels(spark, empty=False):
    rows = [] if empty else [(i, 1, int(i == 8)) for i in range(12)] + [(None, 1, 1), (4, None, None), (8, 0, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark, empty=False):
    rows = [] if empty else [(1, "one two three four"), (1, "one two three four"), (2, None), (None, ""), (3, "..."), (None, "some item that nothing holds at all")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(7))


OPERATORS = {
    "lm": lambda s, d, e: language_model.score_texts(d),
    "toxicity": lambda s, d, e: toxicity.score_toxicity(d, toxicity.learn_grammar(d, labels(s, e))),
    "near": lambda s, d, e: near_dedup.near_classes(d),
    "exact": lambda s, d, e: exact_dedup.exact_dedup(d),
    "licenses": lambda s, d, e: licenses.scan_licenses(d),
    "lines": lambda s, d, e: line_dedup.line_dedup(d),
    "mixing": lambda s, d, e: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, name):
    docs, rows = documents(spark)
    got = OPERATORS[name](spark, docs, False)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r[0] for r in rows)
    again = OPERATORS[name](spark, docs.repartition(5), False)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    none, _ = documents(spark, True)
    assert OPERATORS[name](spark, none, True).count() == 0


def test_results_of_odd_texts(spark):
    docs, rows = documents(spark)
    lm = {r.doc_id: r for r in language_model.score_texts(docs).collect()}
    assert all(lm[i].n_tokens == 1 for i in (0, 1, 2, 3)) and all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 1) for i, r in lm.items())
    near = near_dedup.near_classes(docs).collect()
    of = {r.doc_id: r.class_id for r in near if r.doc_id not in (None, 3)}
    assert of[0] == of[1] is None and of[9] == of[10] == 9 and len({of[i] for i in (4, 5, 6, 7, 8, 11)}) == 6
    kept = near_dedup.near_dedup(docs)
    # no bytes; blank; line ends; x; four words; dots; a sign; the toxic one; the long ones; two lines; the null id's; the second text of id 3
    assert kept.columns == docs.columns and kept.count() == 12
    assert kept.where("key = 'own key' AND node = 'own node' AND kept_id = 'own kept_id'").count() == kept.count()
    lined = line_dedup.line_dedup(docs, min_sites=2)
    assert lined.columns == [*docs.columns, "_n_lines", "_n_removed"] and lined.where("n_lines = 'own n_lines' AND g_pos = 'own g_pos'").count() == len(rows)
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, benchmark(spark)).collect()}
    assert leaks == {(5, 1)}
    assert decontaminate.decontaminate(docs, benchmark(spark)).count() == len(rows) - 3
    assert decontaminate.decontaminate(docs, benchmark(spark, True)).count() == len(rows) and decontaminate.find_leaks(documents(spark, True)[0], benchmark(spark)).count() == 0


def pages(spark, empty=False):
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(30_000)) + "</article>"
    rows = [(1, None, None), (2, "", ""), (None, "http://a.org/x", "<p>one</p>"), (3, "http://a.org/y", "<p>one</p>"), (3, "http://a.org/y", "<p>one</p>"), (4, "no url", "<<<>>&&; <p"), (5, "http://b.org/1", long), (6, "http://b.org/2", long.replace("line 7<", "other<"))]
    table = spark.createDataFrame([] if empty else rows, "page_id long, url string, html string")
    return table.select("*", *[F.lit(f"own {c}").alias(c) for c in (*CLASHES, "path", "tie", "body", "part", "lent", "text")]), rows


def test_pages(spark):
    table, rows = pages(spark)
    got = html_text.extract_text(table).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == "" and texts[3] == "one" and texts[5].count("\n") == 29_999
    listed = spark.createDataFrame([("a.org",), ("a.org",), (None,), ("",)], "key string")
    judged = url_filter.filter_urls(table, listed).collect()
    assert Counter((r.page_id, r.listed) for r in judged) == Counter((r[0], "a.org" in (r[1] or "") or "://" not in (r[1] or "")) for r in rows)
    none, _ = pages(spark, True)
    assert html_text.extract_text(none).count() == url_filter.filter_urls(none, listed).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for empty in (False, True):
        folder = tmp_path / str(empty)
        labels(spark, empty).write.parquet(str(folder / "labels.parquet"))
        benchmark(spark, empty).write.parquet(str(folder / "benchmark.parquet"))
        docs, rows = documents(spark, empty)
        sizes = {"toxicity": len(rows), "line dedup": len(rows), "near dedup": 14, "decontamination": len(rows) - 3}
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(folder))
            n = out.count()
            if name == "mixing":
                assert {"doc_id", "source", "size", "taken"} <= set(out.columns) and out.where("taken <= 0").count() == 0
            else:
                assert out.columns == docs.columns and out.where("key <> 'own key'").count() == 0
            if empty:
                assert n == 0
            elif name == "decontamination":
                assert n == len(rows) - 3
            elif name == "line dedup":
                assert n == len(rows)
            elif name in sizes:
                assert 0 < n <= sizes[name]
