"""Registered queries over binary items, which are built here, and over the bytes of documents."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..engine import Detector
from ..functions import byte_stats as bs, routing
from ..operators import audio, image, media, video, verdicts
from . import media_sql
from .queries import SCORED, query, read, spread


def png(*chunks: tuple[bytes, bytes], size: tuple[int, int] = (1024, 768)) -> bytes:
    header = (b"IHDR", struct.pack(">IIBBBBB", *size, 8, 6, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0" for kind, body in (header, *chunks))


def exif_jpeg(make: bytes, latitude: int = 48) -> bytes:
    """A JPEG head with one EXIF directory that has a make and a GPS directory, then pseudo-random bytes."""
    make += b"\0"
    entries = struct.pack("<HHII", 0x010F, 2, len(make), 100) + struct.pack("<HHII", 0x8825, 4, 1, 150)
    tiff = (b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entries + b"\0\0\0\0").ljust(100, b"\0") + make.ljust(50, b"\0")
    gps = struct.pack("<H", 2) + struct.pack("<HHI", 1, 2, 2) + b"N\0\0\0" + struct.pack("<HHII", 2, 5, 3, 200)
    tiff = (tiff + gps).ljust(200, b"\0") + struct.pack("<6I", latitude, 1, 30, 1, 0, 1)
    segment = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + noise(6000, 3)


def noise(n: int, seed: int) -> bytes:
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def wav(samples: np.ndarray, rate: int = 16_000, extra: bytes = b"") -> bytes:
    body = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def tone(rate: int = 16_000, seconds: float = 1.0) -> np.ndarray:
    t = np.arange(int(rate * seconds)) / rate
    return 0.5 * np.sin(2 * np.pi * 200 * t) + 0.2 * np.sin(2 * np.pi * 400 * t)


def mp3(n: int = 20) -> bytes:
    frame = b"\xff\xfb\x90\x00"  # 128 kbit/s at 44.1 kHz: 417 bytes
    return (frame + b"\x55" * 413) * n


def atom(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def mp4(n: int = 30, brand: bytes = b"isom") -> bytes:
    units = b"".join(b"\0\0\0\1" + (b"\x65" if i % 10 == 0 else b"\x41") + bytes([2 + (i * 7 + j) % 200 for j in range(400 + 10 * (i % 3))]) for i in range(n))
    return atom(b"ftyp", brand + b"\0\0\2\0avc1") + atom(b"moov", atom(b"trak", b"vide") + atom(b"trak", b"soun")) + atom(b"mdat", units)


def items() -> list[tuple[str, bytes]]:
    return [
        ("jpeg_exif", exif_jpeg(b"Canon")),
        ("jpeg_plain", b"\xff\xd8\xff\xe0\0\x10JFIF" + b"\0" * 1000),
        ("jpeg_damaged", b"\xff\xd8\xff\xe1\0\0" + b"\0" * 50),
        ("png_generated", png((b"tEXt", b"Software\0Stable Diffusion"), (b"IDAT", noise(5000, 1)), (b"IEND", b""))),
        ("png_screenshot", png((b"pHYs", struct.pack(">IIB", 3780, 3780, 1)), (b"tIME", struct.pack(">H5B", 2024, 5, 6, 7, 8, 9)), (b"IDAT", b"\x10" * 6000))),
        ("gif", b"GIF89a" + noise(3000, 2)),
        ("wav_tone", wav(tone())),
        ("wav_marked", wav(tone(seconds=0.5), extra=b"LIST" + struct.pack("<I", 12) + b"Suno session")),
        ("mp3", mp3()),
        ("mp3_tagged", b"ID3\3\0\0\0\0\0\x20" + b"TSSE LAME recorded live".ljust(32, b"\0") + mp3(3)),
        ("flac", b"fLaC" + b"\0\0\0\x22" + noise(6000, 4)),
        ("ogg", b"OggS" + b"\0" * 24 + b"\x01vorbis" + noise(6000, 5)),
        ("mp4", mp4()),
        ("mp4_zeros", atom(b"ftyp", b"isom\0\0\2\0isomavc1") + b"\0" * 5000),
        ("webm", b"\x1aE\xdf\xa3" + b"\0" * 20 + b"webm" + b"\x18\x53\x80\x67" + (b"\x1f\x43\xb6\x75\x44\x00" + noise(1024, 6)) * 12),
        ("avi", b"RIFF\0\0\0\0AVI " + b"".join(b"00dc" + struct.pack("<I", 2000) + noise(2000, i) for i in range(8))),
        ("empty", b""),
    ]


def _items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, bytearray(data)) for name, data in items()], "item string, content binary")


_SQL = "WITH RECURSIVE " + media_sql.bytes_of(items()) + ",\n"


def _scores(rows: DataFrame, column: str, weights: dict[str, float]) -> DataFrame:
    """item, score and signals, each rounded, and whether the item could be read."""
    value = lambda name: F.round(F.col(f"{column}.{name}"), 6)
    return rows.select("item", value("ai_score").alias("ai_score"), *[value(f"signals.{n}").alias(n) for n in weights], F.col(f"{column}.error").isNull().alias("readable"))


def _images(spark: SparkSession) -> DataFrame:
    return image.analyze_images(_items(spark).where(image.format_column(F.col("content")) != "unknown"))


def _audios(spark: SparkSession) -> DataFrame:
    return audio.analyze_audios(_items(spark).where(audio.format_column(F.col("content")) != "unknown"))


def _videos(spark: SparkSession) -> DataFrame:
    return _items(spark).where(video.format_column(F.col("content")) != "unknown")


@query("image_signals", _SQL + media_sql.IMAGES + "\n" + media_sql.signals("image_scores", image.WEIGHTS, ["jpeg_damaged"]))
def image_signals(spark, sf_dir):
    return _scores(_images(spark), "image", image.WEIGHTS)


#: What the items were built with.
_IMAGE_METADATA = (
    ("jpeg_exif", "jpeg", True, "Canon", "", "", 0, True, 48.5, False, 0, 0, 0), ("jpeg_plain", "jpeg", False, "", "", "", 0, False, 0.0, True, 0, 0, 0),
    ("png_generated", "png", True, "", image.GENERATED, "", 0, False, 0.0, False, 1024, 768, 8), ("png_screenshot", "png", False, "", "", "2024-05-06 07:08:09", 96, False, 0.0, True, 1024, 768, 8),
    ("gif", "gif", False, "", "", "", 0, False, 0.0, False, 0, 0, 0), ("jpeg_damaged", *[None] * 12),
)
_IMAGE_COLUMNS = ("file_format", "has_exif", "camera_make", "software", "date_taken", "x_resolution", "has_gps", "gps_latitude", "is_screenshot", "width", "height", "bit_depth")


@query("image_metadata", media_sql.table(_IMAGE_METADATA, ("item", *_IMAGE_COLUMNS)))
def image_metadata(spark, sf_dir):
    stats = ("width", "height", "bit_depth")
    return _images(spark).select("item", *[F.col(f"image.{'stats' if c in stats else 'metadata'}.{c}").alias(c) for c in _IMAGE_COLUMNS])


@query("audio_signals", _SQL + media_sql.AUDIO + "\n" + media_sql.signals("audio_scores", audio.WEIGHTS))
def audio_signals(spark, sf_dir):
    return _scores(_audios(spark), "audio", audio.WEIGHTS)


@query("audio_metadata", _SQL + media_sql.AUDIO_METADATA)
def audio_metadata(spark, sf_dir):
    return _audios(spark).select("item", "audio.metadata.*")


@query("wave_stats", _SQL + media_sql.WAVE_STATS)
def wave_stats(spark, sf_dir):
    rows = _audios(spark).where("audio.stats.has_waveform_stats").select("item", "audio.stats.*").drop("has_waveform_stats")
    return rows.select("item", "file_size", *[F.round(c, 6).alias(c) for c in rows.columns if c not in ("item", "file_size")])


@query("video_signals", _SQL + media_sql.VIDEO + "\n" + media_sql.signals("video_scores", video.WEIGHTS))
def video_signals(spark, sf_dir):
    return _scores(video.analyze_videos(_videos(spark)), "video", video.WEIGHTS)


@query("video_metadata", _SQL + media_sql.VIDEO + " SELECT f.*, n AS file_size, CAST(CASE WHEN contains(t, 'mdat') THEN 1 ELSE 0 END AS BIGINT) AS chunk_count FROM video_facts f JOIN len USING (item) JOIN text_ USING (item)")
def video_metadata(spark, sf_dir):
    return video.analyze_videos(_videos(spark)).select("item", "video.metadata.*", "video.stats.*")


@query("mp3_frames", _SQL + media_sql.MP3_FRAMES)
def mp3_frames(spark, sf_dir):
    return audio.frames_of(_items(spark), ["item"])


def _sounds(spark: SparkSession) -> DataFrame:
    return audio.analyze_sounds(_items(spark).where(audio.format_column(F.col("content")) == "wav"))


@query("sound_spectrum", _SQL + media_sql.SPECTRUM)
def sound_spectrum(spark, sf_dir):
    return _sounds(spark).select("item", *[F.round(f"sound.spectrum.{c}", 6).alias(c) for c in ("centroid", "flatness", "rolloff", "bandwidth", "harmonic_ratio", "flux")])


@query("sound_formants", _SQL + media_sql.FORMANTS)
def sound_formants(spark, sf_dir):
    return _sounds(spark).select("item", F.posexplode("sound.spectrum.formants").alias("place", "hz")).withColumn("hz", F.round("hz", 6))


@query("sound_cepstrum", _SQL + media_sql.CEPSTRUM)
def sound_cepstrum(spark, sf_dir):
    rows = _sounds(spark).select("item", F.posexplode("sound.mfcc_mean").alias("place", "mfcc_mean"), F.round("sound.mfcc_score", 6).alias("mfcc_score"))
    return rows.select("item", F.col("place").cast("long").alias("place"), F.round("mfcc_mean", 6).alias("mfcc_mean"), "mfcc_score")


@query("video_frames", _SQL + media_sql.VIDEO_FRAMES)
def video_frames(spark, sf_dir):
    frames = video.frames_of(_videos(spark), ["item"], config=video.ExtractionConfig(keyframes_only=False, max_frames=50))
    return video.frame_changes(frames, "item").withColumn("data", F.sha2("data", 256))


@query("video_motion", _SQL + media_sql.VIDEO_MOTION)
def video_motion(spark, sf_dir):
    rows = video.analyze_motion(_videos(spark)).select("item", "motion.n_frames", "motion.consistency", "motion.temporal.*")
    return rows.select("item", "n_frames", *[F.round(c, 6).alias(c) for c in ("consistency", "overall", "flickering", "diff_variance", "lighting", "morphing")])


@query("media_verdicts", _SQL + media_sql.VERDICTS)
def media_verdicts(spark, sf_dir):
    """Every item routed by its first bytes, analysed by its kind, with a verdict on the score to nine digits."""
    rows = _items(spark).withColumn("content_type", routing.type_of_magic(F.col("content")))
    parts = []
    for kind, analyse in (("image", image.analyze_images), ("audio", audio.analyze_audios), ("video", video.analyze_videos)):
        part = analyse(rows.where(F.col("content_type") == kind))
        parts.append(part.select("item", "content_type", F.col(kind).ai_score.alias("ai_score")))
    out = verdicts.add_verdict(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return out.select("item", "content_type", F.round("ai_score", 6).alias("ai_score"), (F.round("ai_score", 9) < 0.5).alias("human"), F.round("confidence", 6).alias("confidence"))


_FOUND = """
SELECT 'doc-' || k AS item, 'text' AS content_type, CASE WHEN error IS NULL THEN ai_score END AS ai_score, sha256(t) AS content_hash, error FROM (
  {text} SELECT *, CASE WHEN t = '' THEN 'no content' WHEN strlen(t) < 10 THEN 'text too short' WHEN strlen(t) > 100000 THEN 'text too long' END AS error FROM scored JOIN d USING (k))
UNION ALL
SELECT item, CASE WHEN content_type IS NULL THEN 'unknown' ELSE content_type END, ai_score, sha256(from_hex(h)),
       CASE WHEN h = '' THEN 'no content' WHEN content_type IS NULL THEN 'unsupported content type: unknown' WHEN ai_score IS NULL THEN 'unreadable' END
FROM ({media} SELECT len.item, h, v.content_type, v.ai_score FROM len LEFT JOIN verdicts v ON v.item = len.item)"""
_FOUND = _FOUND.format(text="WITH " + SCORED, media=_SQL + media_sql.VERDICTS_TABLE)
#: Scores that other detectors gave.
_EXTERNAL = (("jpeg_exif", "hive", 0.9), ("wav_tone", "hive", 0.8), ("mp4", "hive", 0.1), ("doc-7", "hive", 0.95), ("doc-7", "gptzero", 0.7), ("doc-7", "openai", 0.2), ("doc-9", "other", 0.6), ("doc-9", "hive", None), ("empty", "hive", 0.9), ("nowhere", "hive", 0.9))


def _mixed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("item"), F.coalesce("text", F.lit("")).alias("text"), F.lit("text").alias("content_type"))
    return spread(docs).unionByName(_items(spark).withColumnRenamed("content", "data"), allowMissingColumns=True)


def _results(found: DataFrame) -> DataFrame:
    """The result set, with verdicts on scores to nine digits and damaged items told apart from refused ones."""
    rows = found.withColumn("human", F.round("ai_score", 9) < 0.5)
    error = F.when(F.col("error").contains("Error:"), "unreadable").otherwise(F.col("error"))
    return rows.select("item", "content_type", "human", F.round("confidence", 6).alias("confidence"), F.round("ai_score", 6).alias("ai_score"), F.array_join("detectors", ",").alias("detectors"), "content_hash", error.alias("error"))


_RESULTS = "SELECT item, content_type, round(ai_score, 9) < 0.5 AS human, round(abs(ai_score - 0.5) * 2, 6) AS confidence, round(ai_score, 6) AS ai_score, {detectors} AS detectors, content_hash, error FROM {rows}"


@query("detect_mixed", _RESULTS.format(detectors="CASE WHEN ai_score IS NOT NULL THEN 'local' END", rows=f"({_FOUND})"))
def detect_mixed(spark, sf_dir):
    """Every document and every media item in one table, routed, analysed by its kind, and back in one result set."""
    return _results(Detector().detect(_mixed_items(spark, sf_dir), "item"))


_WEIGHT = "CASE detector WHEN 'hive' THEN CASE content_type WHEN 'text' THEN 1.2 WHEN 'video' THEN 1.4 ELSE 1.3 END WHEN 'gptzero' THEN 1.1 WHEN 'openai' THEN 0.9 ELSE 1.0 END"


@query("detect_with_external", _RESULTS.format(detectors="detectors", rows=f"""(
  SELECT item, content_type, any_value(content_hash) AS content_hash, any_value(f.error) AS error, CASE WHEN any_value(f.ai_score) IS NOT NULL THEN (any_value(f.ai_score) + coalesce(sum(e.score * w), 0)) / (1 + coalesce(sum(w) FILTER (e.score IS NOT NULL), 0)) END AS ai_score,
         CASE WHEN any_value(f.ai_score) IS NOT NULL THEN array_to_string(list_sort(list_append(coalesce(list(detector) FILTER (e.score IS NOT NULL), []), 'local')), ',') END AS detectors
  FROM (SELECT f.*, e.detector, e.score, ({_WEIGHT})::DOUBLE AS w FROM ({_FOUND}) f LEFT JOIN (VALUES {", ".join(f"('{i}', '{d}', {'NULL' if x is None else x}::DOUBLE)" for i, d, x in _EXTERNAL)}) e(item, detector, score) ON e.item = f.item) f(item, content_type, ai_score, content_hash, error, detector, score, w), LATERAL (SELECT f.score AS score) e
  GROUP BY item, content_type)"""))
def detect_with_external(spark, sf_dir):
    """The same with scores of other detectors joined in, by the weights of each kind."""
    external = spark.createDataFrame(_EXTERNAL, "item string, detector string, score double")
    return _results(Detector().detect(_mixed_items(spark, sf_dir), "item", external))


_BYTES = "SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS h FROM documents"


@query("byte_entropy", f"""
WITH b AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, CAST(2 * i + 1 AS BIGINT), 2))) AS byte FROM ({_BYTES})),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c),
e AS (SELECT doc_id, -sum(p * log2(p)) / 8 AS e, count(*) AS kinds FROM s GROUP BY doc_id)
SELECT doc_id, round(coalesce(e, 0), 6) AS entropy, coalesce(kinds, 0) AS kinds FROM documents LEFT JOIN e USING (doc_id)""")
def byte_entropy(spark, sf_dir):
    """Entropy of each text's bytes, from histograms in Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = [value.as_py() for value in batch.column(1)]
            entropies = [bs.relative_entropy(x) for x in rows]
            kinds = [int((bs.histogram(x) > 0).sum()) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entropies, pa.float64()), pa.array(kinds, pa.int64())], names=["doc_id", "entropy", "kinds"])

    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return docs.mapInArrow(run, "doc_id long, entropy double, kinds long").withColumn("entropy", F.round("entropy", 6))


PNG_CHUNK = "type string, length long, crc long"


@query("png_chunks", _SQL + media_sql.PNG_CHUNKS)
def png_chunks(spark, sf_dir):
    rows = _items(spark).where(image.format_column(F.col("content")) == "png")
    schema = spark.createDataFrame([], PNG_CHUNK).schema
    return media.explode_binary(rows, "content", lambda data: image.png_chunks(data).chunks, schema, ["item"])


_FORMATS = {
    "image": (image.format_column, (("ffd8ffe000104a46", "jpeg"), ("89504e470d0a1a0a", "png"), ("4749463839610000", "gif"), ("524946460000000057454250", "webp"), ("424d000000000000", "bmp"), ("0001020304050607", "unknown"), ("ffd8", "unknown"))),
    "audio": (audio.format_column, (("fffb90000000000000000000", "mp3"), ("494433030000000000000000", "mp3"), ("524946460000000057415645", "wav"), ("664c61430000000000000000", "flac"), ("4f6767530000000000000000", "ogg"), ("00000018667479704d344120", "m4a"), ("ffd8", "unknown"))),
    "video": (video.format_column, (("000000186674797069736f6d", "mp4"), ("000000186674797071742020", "mov"), ("1a45dfa30000000000000000", "mkv"), ("1a45dfa3000077656d626d00", "mkv"), ("1a45dfa30000007765626d00", "webm"), ("524946460000000041564920", "avi"), ("464c560105000000", "flv"), ("0000", "unknown"))),
}


@query("media_formats", "SELECT * FROM (VALUES " + ", ".join(f"('{kind}', '{head}', '{name}')" for kind, (_, rows) in _FORMATS.items() for head, name in rows) + ") AS v(kind, head, format)")
def media_formats(spark, sf_dir):
    parts = []
    for kind, (column, rows) in _FORMATS.items():
        heads = spark.createDataFrame([(head,) for head, _ in rows], "head string")
        parts.append(heads.select(F.lit(kind).alias("kind"), "head", column(F.unhex("head")).alias("format")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
