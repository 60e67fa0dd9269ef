"""Image, audio and video analysis against golden scores and definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsight.functions import byte_stats as bs
from quillsight.operators import audio, image, video
from quillsight.plans import media_queries as mq


@pytest.mark.parametrize(
    ("head", "name"),
    [(b"\xff\xd8\xff\xe0\0\0\0\0", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF89a\0\0", "gif"), (b"RIFF\0\0\0\0WEBP", "webp"), (b"BM\0\0\0\0\0\0", "bmp"), (bytes(range(8)), "unknown"), (b"\xff\xd8", "unknown")],
)
def test_image_formats(head, name):
    assert image.image_format(head) == name


def test_similarity_and_entropy():
    assert [bs.similarity(b"\1\2\3\4", x) for x in (b"\1\2\3\4", b"\0\0\0\0", b"\1\2\0\0", b"\1\2")] == [1.0, 0.0, 0.5, 0.0]
    assert bs.relative_entropy(b"") == 0 and bs.relative_entropy(b"aaaa") == 0 and bs.relative_entropy(bytes(range(256))) == pytest.approx(1)
    assert bs.zero_runs(b"\0\0a\0b") == {"mean": 1.5, "longest": 2, "n": 2, "variance": 0.25}
    assert bs.periodicity(b"ab" * 100, 2) == 1.0 and bs.periodicity(b"abc", 8) == 0.0


def test_image_metadata_scores():
    meta = image.ImageMetadata
    scores = [image.metadata_score(m) for m in (meta(has_exif=True, camera_make="x", has_gps=True), meta(software="AI Generator"), meta(), meta(is_screenshot=True))]
    assert scores == pytest.approx([0.0, 1.0, 0.7, 0.5], abs=1e-12)


def test_plain_jpeg_is_neutral():
    got = image.analyze_image(b"\xff\xd8\xff\xe0\0\x10JFIF" + b"\0" * 1000)
    assert got["signals"]["metadata"] == pytest.approx(0.5) and got["ai_score"] == pytest.approx(0.5)
    assert all(v == 0.5 for k, v in got["signals"].items() if k != "metadata")


def test_exif_and_gps():
    meta = image.jpeg_metadata(mq.exif_jpeg(b"Canon", 48))
    assert (meta.camera_make, meta.has_exif, meta.has_gps, meta.is_screenshot) == ("Canon", True, True, False)
    assert meta.gps_latitude == pytest.approx(48.5)
    with pytest.raises(ValueError):
        image.jpeg_metadata(b"\xff\xd8\xff\xe1\0\0" + b"\0" * 50)


def test_png():
    data = dict(mq.items())["png_screenshot"]
    meta, stats = image.png_metadata(data), image.stats_of(data, "png")
    assert (stats.width, stats.height, stats.bit_depth) == (1024, 768, 8)
    assert (meta.x_resolution, meta.resolution_unit, meta.date_taken, meta.is_screenshot) == (96, "inches", "2024-05-06 07:08:09", True)
    assert image.png_metadata(dict(mq.items())["png_generated"]).software == "AI Generator"
    assert image.decode_flash(16) == "Off, Flash did not fire" and image.decode_flash(99) == "Flash (99)"


def test_pcm():
    assert audio.pcm_samples(bytes([0, 128, 255]), 8).tolist() == [-1.0, 0.0, 127 / 128]
    assert audio.pcm_samples(b"\x00\x80\xff\x7f", 16).tolist() == [-1.0, 32767 / 32768]
    assert audio.pcm_samples(b"\x00\x00\x80\xff\xff\x7f", 24).tolist() == [-1.0, 8388607 / 8388608]
    assert audio.pcm_samples(b"\x00\x00\x00\x80", 32).tolist() == [-1.0]
    assert len(audio.pcm_samples(b"abcdef", 48)) == 0


def test_wav_figures():
    samples = mq.tone()
    meta, stats = audio.wav_metadata(mq.wav(samples))
    assert (meta.sample_rate, meta.channels, meta.bit_depth, meta.encoder_name, meta.duration) == (16_000, 1, 16, "PCM", 1.0)
    assert stats.rms_amplitude == pytest.approx(np.sqrt((0.25 + 0.04) / 2), rel=1e-3)
    assert stats.zero_crossing_rate == pytest.approx(400 / 16_000, rel=0.02)
    assert audio.wav_metadata(dict(mq.items())["wav_marked"])[0].is_ai_marked


def test_mp3_frames():
    frames = audio.mp3_frames(mq.mp3(20))
    assert len(frames) == 20 and {f["frame_size"] for f in frames} == {417} and frames[1]["offset"] == 417
    meta = audio.mp3_metadata(dict(mq.items())["mp3_tagged"])
    assert (meta.has_id3, meta.encoder_name, meta.has_recording, meta.bitrate) == (True, "LAME", True, 128)


def test_spectrum_of_a_tone():
    got = audio.spectrum(mq.tone(), 16_000)
    assert got["formants"][0] == pytest.approx(400, abs=8) and got["harmonic_ratio"] > 0.3 and got["flatness"] < 0.1
    assert audio.spectrum(mq.tone()[:100], 16_000) is None
    assert [audio.fft_size(n) for n in (5000, 4096, 2048, 2049, 1000)] == [4096, 4096, 1024, 2048, 512]


def test_mfcc():
    config = audio.MfccConfig.default(16_000)
    assert (config.frame_size, config.frame_stride) == (512, 160)
    frames = audio.mfcc(mq.tone(), 16_000)
    assert frames.shape == ((16_000 - 512) // 160, 13)
    assert audio.deltas(np.arange(10.0)[:, None])[5, 0] == pytest.approx(1)
    m = audio.dct_matrix(26, 26)
    assert m @ m.T == pytest.approx(np.eye(26), abs=1e-9)
    assert 0 <= audio.mfcc_score(frames) <= 1 and audio.mfcc_score(None) == 0.5
    assert audio.mel_to_hz(audio.hz_to_mel(440.0)) == pytest.approx(440)


@pytest.mark.parametrize(("meta", "score"), [({"encoder_name": "ffmpeg", "has_audio": True}, 0.4), ({"is_ai_marked": True}, 1.0), ({}, 0.65), ({"encoder_name": "Runway", "has_audio": True}, 0.8), ({"encoder_name": "Adobe Premiere", "has_audio": True}, 0.4)])
def test_video_metadata_scores(meta, score):
    assert video.metadata_score(video.VideoMetadata(**meta)) == pytest.approx(score)


def test_video_golden():
    assert bs.weighted_mean((0.9, 0.8, 0.9, 0.8, 0.7, 0.8), video.WEIGHTS.values()) == pytest.approx(0.825)
    got = video.analyze_video(dict(mq.items())["mp4_zeros"])
    assert got["signals"] == pytest.approx({"metadata": 0.65, "container": 0.9, "audio": 0.7, "temporal": 0.5, "encoding": 0.45, "bitrate": 0.6})
    assert got["ai_score"] == pytest.approx(0.65)


@pytest.mark.parametrize(("text", "yes"), [(b"Created with Runway Gen-2", True), (b"Pika Labs video", True), (b"AI-generated content", True), (b"Recorded on iPhone", False), (b"Encoded with ffmpeg", False)])
def test_video_markers(text, yes):
    assert audio.has_any(text, video.GENERATED_MARKERS) is yes


@pytest.mark.parametrize(("text", "name"), [(b"Lavf58.76.100", "ffmpeg"), (b"HandBrake 1.5.0", "HandBrake"), (b"x264 - core 164", "x264"), (b"Unknown software", "")])
def test_encoders(text, name):
    assert audio.encoder_of(text, video.ENCODERS) == name


def test_video_frames():
    data = mq.mp4(30)
    meta, stats = video.mp4_metadata(data)
    assert meta.has_audio and stats.chunk_count == 1
    keys = video.extract_frames(data)
    assert [f["frame_index"] for f in keys] == [0, 10, 20] and {f["frame_type"] for f in keys} == {"I"}
    every = video.extract_frames(data, video.ExtractionConfig(keyframes_only=False, max_frames=100, sample_rate=2))
    assert len(every) == 15
    assert video.temporal_consistency(every)["overall"] > 0 and video.temporal_consistency(every[:2])["overall"] == 0.5
    assert 0 <= video.frame_consistency(every) <= 1
    assert (video.byte_difference(b"abcd", b"abxx"), video.histogram_difference(b"aa", b"aa"), video.histogram_difference(b"aa", b"bb")) == (0.5, 0.0, 1.0)
    assert [video.ebml_size(x) for x in (b"\x81", b"\x40\x02", b"\x00", b"")] == [1, 2, 0, 0]


def test_damaged_items_do_not_fail(spark):
    rows = spark.createDataFrame([("a", bytearray(b"\xff\xd8\xff\xe1\0\0" + b"\0" * 50), "x"), ("b", None, "x"), ("c", bytearray(b""), "x")], "item string, content binary, image string")
    got = {r["item"]: r.image for r in image.analyze_images(rows).collect()}
    assert got["a"].error.startswith("ValueError") and got["b"] is None and got["c"].ai_score is not None
    for analyse, name in ((audio.analyze_audios, "audio"), (video.analyze_videos, "video")):
        assert all(r[name] is None or 0 <= r[name].ai_score <= 1 for r in analyse(rows).collect())


def test_formats_in_the_jvm_agree(spark):
    rows = spark.createDataFrame([(n, bytearray(d)) for n, d in mq.items()], "item string, content binary")
    got = rows.select("content", image.format_column(F.col("content")).alias("i"), audio.format_column(F.col("content")).alias("a"), video.format_column(F.col("content")).alias("v")).collect()
    assert all((r.i, r.a, r.v) == (image.image_format(bytes(r.content)), audio.audio_format(bytes(r.content)), video.video_format(bytes(r.content))) for r in got)
