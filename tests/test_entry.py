"""The driver's entry points, the sources, and that the library stands without its corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from quillsight.operators import verdicts
from quillsight.sources import readers

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 45


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() == 200 and {"ai_score", "verdict", "detected_phrases"} <= set(out.columns)


def test_without_the_corpus_subpackage(tmp_path):
    for name in ("quillsight", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and 'score_default' in q"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"text": "long enough text"}\n{"url": "https://a.com/x.png", "text": "ignored"}\n{}\n{"text": "short"}\n')
    got = readers.read_requests(spark, str(tmp_path / "r.json")).collect()
    assert sorted((r.content_type, r.error or "") for r in got) == [("image", ""), ("text", ""), ("text", "text too short"), ("unknown", "no content")]


def test_fetched(spark):
    rows = [(1, "https://a.com/x.txt", 200, b"some text"), (2, "https://a.com/x.txt", 404, b"gone"), (3, "https://a.com/x.png", 200, b"\x89PNG"), (4, "https://a.com/", 200, b"?"), (5, "https://a.com/y.txt", 200, b""), (6, "https://a.com/y.txt", None, None), (7, "https://a.com/z.md", 200, b"a" * (1 << 20) + b"more")]
    fetched = spark.createDataFrame([(i, u, s, bytearray(b) if b is not None else None, "own") for i, u, s, b in rows], "id long, url string, status int, body binary, text string")
    got = {r.id: r for r in readers.fetched_as_items(fetched).collect()}
    assert got[1].text == "some text" and got[3].text is None and bytes(got[3].data) == b"\x89PNG" and len(got[7].text) == 1 << 20
    assert {i: r.error for i, r in got.items()} == {1: None, 2: "status 404", 3: None, 4: "unsupported content type: unknown", 5: "no content", 6: "status unknown", 7: None}
    assert got[2].text is None and got[2].data is None


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("héllo")
    (tmp_path / "a" / "y.png").write_bytes(b"\x89PNG")
    (tmp_path / "z.bin").write_bytes(b"z")
    got = {r.filename: (r.content_type, r.error) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"x.txt": ("text", None), "y.png": ("image", None), "z.bin": ("unknown", None)}
    assert [r.filename for r in readers.read_files(spark, str(tmp_path), "image").collect()] == ["y.png"]
    assert readers.files_as_text(readers.read_files(spark, str(tmp_path))).first().text == "héllo"


def test_labelled_folders_and_results(spark, tmp_path):
    for folder, text in (("human", "one"), ("ai_generated", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.txt").write_text(text)
    assert {(r.text, r.expected) for r in readers.read_labelled_texts(spark, str(tmp_path)).collect()} == {("one", "human"), ("two", "ai")}
    rows = spark.createDataFrame([("f", "ai", "human", 0.5, True, 3), ("g", "ai", "ai", 0.0, False, 1)], readers.RESULT)
    readers.write_results(rows, str(tmp_path / "out"))
    back = readers.read_results(spark, str(tmp_path / "out"))
    assert {(r.filename, r.genuine) for r in back.collect()} == {("f", True), ("g", False)}
    verdicts.write_summary_csv(verdicts.confusion(back.where("genuine")), str(tmp_path / "summary"))
    assert "0.00" in spark.read.text(str(tmp_path / "summary")).collect()[1].value
