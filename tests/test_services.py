"""Routing, validation, store and rate limits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillsight.functions import routing
from quillsight.operators import store
from quillsight.streaming import rate_limit


def values(spark, rows, kind, column):
    return [r.x for r in spark.createDataFrame([(r,) for r in rows], f"v {kind}").select(column(F.col("v")).alias("x")).collect()]


def test_type_of_url(spark):
    urls = ["https://a.com/image.jpg", "https://a.com/document.pdf", "https://a.com/photo.png?size=large", "https://a.com/audio.mp3?q=high", "https://a.com/document.txt", "https://example.com/", None]
    assert values(spark, urls, "string", routing.type_of_url) == ["image", "unknown", "image", "audio", "text", "unknown", "unknown"]


def test_type_of_filename(spark):
    assert values(spark, ["A.JPG", "x.tar.gz", "noext", "a/b.c/d", "clip.WebM", ""], "string", routing.type_of_filename) == ["image", "unknown", "unknown", "unknown", "video", "unknown"]


def test_type_of_magic(spark):
    data = [bytearray(bytes.fromhex(h)) for h in ("ffd8ffe0", "89504e47", "ffd8", "0000000000000000", "494433", "49443303", "524946460000000057415645", "000000186674797069736f6d")]
    assert values(spark, data, "binary", routing.type_of_magic) == ["image", "image", "unknown", "unknown", "unknown", "audio", "audio", "video"]


def test_validation(spark):
    rows = spark.createDataFrame([("", "", None), ("short", "", None), ("", "not-a-url", None), ("", "https://a.com", None), ("", "", bytearray(b"x")), ("x" * 100_001, "", None)], "t string, u string, d binary")
    got = [r.x for r in rows.select(routing.validation_error(F.col("t"), F.col("u"), F.col("d")).alias("x")).collect()]
    assert got == ["no content", "text too short", "invalid url", None, None, "text too long"]


def test_content_type_ladder(spark):
    rows = spark.createDataFrame([("t", "a.png", "", None), ("", "a.xyz", "b.png", None), ("", "", "b.mp3", None), ("", None, None, bytearray(b"ID3xx")), (None, None, None, None)], "t string, f string, u string, d binary")
    got = [r.x for r in rows.select(routing.content_type(F.col("t"), F.col("f"), F.col("u"), F.col("d")).alias("x")).collect()]
    assert got == ["text", "unknown", "audio", "audio", "unknown"]


def test_store(spark, tmp_path):
    scored = spark.createDataFrame([(1, True, 0.5, 0.25, "h1"), (2, False, 0.1, 0.55, "h2")], "k long, human boolean, confidence double, ai_score double, content_hash string")
    jobs = store.JobStore(spark, str(tmp_path / "jobs"))
    jobs.create(store.as_jobs(scored, "k"))
    jobs.create(store.as_jobs(scored.withColumn("k", F.col("k") + 10), "k"))
    rows = jobs.all().collect()
    assert len({r.id for r in rows}) == 4 and all(len(r.id) == 24 for r in rows)
    assert jobs.get(rows[0].id).first().content_hash == rows[0].content_hash
    assert jobs.get("missing").count() == 0
    assert "details" in store.response(jobs.all(), detailed=True).columns and "ai_score" not in store.response(jobs.all()).columns
    with pytest.raises(ValueError):
        store.JobStore(spark, "")


def test_rate_limit_windows(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    times = [0, 10, 20, 30, 60, 60.000001, 61, 200]
    rows = [("a", i, at(s)) for i, s in enumerate(times)] + [("b", 100, at(5))]
    got = rate_limit.limit_requests(spark.createDataFrame(rows, "client string, event_id long, ts timestamp"), limit=3, window_seconds=60).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, True, False, False, True, True, True, True]
    assert [r.remaining for r in got] == [2, 1, 0, 0, 0, 2, 1, 2, 2]


def test_rate_limit_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(f"c{i % 3}", i, at(i * 7)) for i in range(60)]
    events = spark.createDataFrame(rows, "client string, event_id long, ts timestamp")
    events.where("event_id < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rate_limit.limit_requests_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), limit=2, window_seconds=60)
    query = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    events.where("event_id >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    got = {(r.event_id, r.allowed, r.place) for r in spark.table("limited").collect()}
    assert got == {(r.event_id, r.allowed, r.place) for r in rate_limit.limit_requests(events, 2, 60).collect()}
