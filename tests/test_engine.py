"""Settings, request ids, and detection over mixed and odd items."""

import re

import pytest
from pyspark.sql import functions as F

from quillsight.engine import Detector, Settings, request_id
from quillsight.sources import shared


def test_settings():
    assert Settings.load({}) == Settings() and Settings().problems() == []
    odd = Settings.load({"PORT": "x", "MAX_UPLOAD_SIZE": "5", "RATE_LIMIT_PER_MINUTE": "7", "ALLOWED_ORIGINS": "a, b", "API_KEY_REQUIRED": "true", "HIVE_API_KEY": "k"})
    assert (odd.port, odd.requests_per_minute, odd.origins, odd.key_required, odd.scorers) == (8080, 7, ("a", "b"), True, ("HIVE_API_KEY",))
    assert odd.problems() == ["upload size too small: 5"]
    live = Settings.load({"ENV": "production"})
    assert live.origins == () and live.key_required and len(live.problems()) == 3
    assert Settings.load({"ENV": "production", "DATABASE_URL": "jobs", "ALLOWED_ORIGINS": "https://a.com", "OPENAI_API_KEY": "k"}).problems() == []
    assert Settings(environment="lab", port=0, max_upload_bytes=2**31).problems() == ["invalid port: 0", "invalid environment: lab", f"upload size too large: {2**31}"]
    with pytest.raises(ValueError):
        Detector(Settings(port=70_000))


def test_request_ids(spark):
    rows = spark.createDataFrame([("given",), ("",), (None,)], "r string").select("r", request_id(F.col("r")).alias("x")).collect()
    assert rows[0].x == "given" and all(re.fullmatch("[0-9a-f]{16}", r.x) for r in rows[1:]) and rows[1].x != rows[2].x


def test_detection_of_odd_items(spark):
    rows = [
        (1, "A text that is long enough to be read.", None, None, None, None), (2, None, bytearray(b"\xff\xd8\xff\xe0\0\x10JFIF" + b"\0" * 1000), None, None, None),
        (3, None, bytearray(b"\xff\xd8\xff\xe1\0\0" + b"\0" * 50), "x.jpg", None, "image"), (4, None, None, None, "https://a.com/x.png", None), (5, None, None, None, "ftp://a", None),
        (6, "short", None, None, None, None), (7, None, None, None, None, None), (8, None, bytearray(b"what is it?"), None, None, "unknown"), (8, "A text that is long enough to be read.", None, "x.png", None, ""),
        (None, "x" * 100_001, None, None, None, None), (9, None, bytearray(b"z" * 2000), None, None, None),
    ]
    items = spark.createDataFrame(rows, "id long, text string, data binary, filename string, url string, content_type string").withColumn("ai_score", F.lit("own"))
    got = Detector(Settings(max_upload_bytes=1500)).detect(items, "id").collect()
    assert len(got) == len(rows) and all(r.request_id for r in got)
    by = {(r.id, r.content_type): r for r in got}
    assert by[1, "text"].detectors == ["local"] and by[1, "text"].human and by[2, "image"].ai_score == pytest.approx(0.5)
    assert by[3, "image"].error.startswith("ValueError") and by[3, "image"].ai_score is None and by[3, "image"].human is None
    errors = {k: r.error for k, r in by.items()}
    assert errors[4, "image"] == "not fetched" and errors[5, "unknown"] == "invalid url" and errors[6, "text"] == "text too short" and errors[7, "unknown"] == "no content"
    assert errors[8, "unknown"] == "unsupported content type: unknown" and errors[8, "text"] is None and errors[None, "text"] == "text too long" and errors[9, "unknown"] == "file too large"
    external = spark.createDataFrame([(1, "hive", 0.9), (2, "hive", None), (6, "hive", 0.9)], "id long, detector string, score double")
    more = {(r.id, r.content_type): r for r in Detector().detect(items, "id", external).collect()}
    assert more[1, "text"].ai_score == pytest.approx((by[1, "text"].ai_score + 0.9 * 1.2) / 2.2) and more[1, "text"].detectors == ["hive", "local"]
    assert more[2, "image"].detectors == ["local"] and more[6, "text"].ai_score is None
    assert Detector().detect(items.limit(0), "id").count() == 0


def test_shared_tables(spark):
    path = shared.new_table(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
