"""Video forensics from bytes: containers, frames, six signals, and comparisons of successive frames."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import byte_stats as bs
from . import image
from .audio import encoder_of, has_any
from .media import analyze_binary, explode_binary, struct_of

# Signal weights.
WEIGHTS = {"metadata": 0.25, "container": 0.20, "audio": 0.15, "temporal": 0.15, "encoding": 0.15, "bitrate": 0.10}

# Markers, looked for in lower case; encoders by the order in which they are tried.
GENERATED_MARKERS = (
    b"runway", b"pika", b"sora", b"gen-2", b"gen2", b"stable video", b"stablevideo", b"modelscope", b"deforum", b"animatediff", b"zeroscope", b"ai generated",
    b"ai-generated", b"synthetic", b"dall-e", b"midjourney",
)
ENCODERS = {
    b"lavf": "ffmpeg", b"ffmpeg": "ffmpeg", b"handbrake": "HandBrake", b"premiere": "Adobe Premiere", b"final cut": "Final Cut Pro", b"davinci": "DaVinci Resolve",
    b"x264": "x264", b"x265": "x265", b"runway": "Runway", b"pika": "Pika Labs", b"sora": "OpenAI Sora", b"modelscope": "ModelScope",
}
GENERATOR_ENCODERS = ("runway", "pika", "sora", "gen-2", "gen2", "stable video", "stablevideo", "modelscope", "deforum", "animatediff", "zeroscope")
EDITOR_ENCODERS = ("premiere", "final cut", "davinci", "avid", "ffmpeg", "handbrake", "x264", "x265")
CODEC_TAGS = (b"avc1", b"h264", b"hvc1", b"hevc", b"vp09", b"av01")
NESTED_ATOMS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
RESOLUTIONS = ((1920, 1080), (1280, 720), (854, 480), (640, 480), (3840, 2160), (2560, 1440), (1080, 1920), (720, 1280))
KEY_NALS = (5, 19, 20)
MOST_CHUNK = 10_000_000


@dataclass
class VideoMetadata:
    format: str = ""
    has_audio: bool = False
    has_video: bool = False
    encoder_name: str = ""
    is_ai_marked: bool = False


@dataclass
class VideoStats:
    file_size: int = 0
    chunk_count: int = 0


@dataclass(frozen=True)
class ExtractionConfig:
    enabled: bool = True
    max_frames: int = 10
    keyframes_only: bool = True
    sample_rate: int = 1


def video_format(data: bytes) -> str:
    if len(data) < 4:
        return "unknown"
    if len(data) >= 12 and data[4:8] == b"ftyp":
        return "mov" if data[8:12] == b"qt  " else "mp4"
    if data[:4] == b"\x1aE\xdf\xa3":
        return "webm" if b"webm" in data[:100] else "mkv"
    if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        return "avi"
    if data[:3] == b"FLV":
        return "flv"
    return "ts" if len(data) > 376 and data[0] == data[188] == data[376] == 0x47 else "unknown"


def format_column(data: Column) -> Column:
    """video_format in the JVM."""
    at = lambda start, value: F.substring(data, start + 1, len(value)) == F.lit(value)
    long = F.octet_length(data) >= 12
    sync = at(0, b"G") & at(188, b"G") & at(376, b"G")
    return (
        F.when(F.octet_length(data) < 4, "unknown").when(long & at(4, b"ftyp"), F.when(at(8, b"qt  "), "mov").otherwise("mp4"))
        .when(at(0, b"\x1aE\xdf\xa3"), F.when(F.contains(F.substring(data, 1, 100), F.lit(b"webm")), "webm").otherwise("mkv"))
        .when(long & at(0, b"RIFF") & at(8, b"AVI "), "avi").when(at(0, b"FLV"), "flv").when(sync, "ts").otherwise("unknown")
    )


def atoms(data: bytes, start: int = 0, cut: bool = False):
    """(type, place, size) of the atoms from a place on. The last may be cut off, if that is allowed."""
    at = start
    while at < len(data) - 8:
        size = int.from_bytes(data[at : at + 4], "big")
        if size < 8 or (at + size > len(data) and not cut):
            return
        size = min(size, len(data) - at)
        yield data[at + 4 : at + 8], at, size
        at += size


def mp4_metadata(data: bytes) -> tuple[VideoMetadata, VideoStats]:
    meta, stats = VideoMetadata(format="mp4", has_video=True), VideoStats(file_size=len(data))
    for kind, at, size in atoms(data, cut=True):
        if kind == b"moov":
            _read_movie(data[at : at + size], meta)
        elif kind == b"mdat":
            stats.chunk_count += 1
        elif kind in (b"ftyp", b"udta") and size > 8:
            body = data[at + 8 : min(at + size, at + (100 if kind == b"ftyp" else 500))]
            meta.is_ai_marked = meta.is_ai_marked or has_any(body, GENERATED_MARKERS)
            if kind == b"udta":
                meta.encoder_name = encoder_of(body, ENCODERS)
    return meta, stats


def _read_movie(data: bytes, meta: VideoMetadata) -> None:
    for kind, at, size in atoms(data, 8):
        if kind == b"trak":
            meta.has_audio = meta.has_audio or b"soun" in data[at : at + size]
        elif kind == b"meta" and size > 8:
            body = data[at + 8 : min(at + size, at + 1000)]
            meta.is_ai_marked = meta.is_ai_marked or has_any(body, GENERATED_MARKERS)
            meta.encoder_name = encoder_of(body, ENCODERS) or meta.encoder_name


def webm_metadata(data: bytes) -> VideoMetadata:
    head = data[:2000]
    return VideoMetadata("webm", b"\x81" in data, True, encoder_of(head, ENCODERS), has_any(head, GENERATED_MARKERS))


def avi_metadata(data: bytes) -> VideoMetadata:
    head = data[:500] if len(data) > 500 else b""
    return VideoMetadata("avi", b"auds" in data, True, encoder_of(head, ENCODERS), has_any(head, GENERATED_MARKERS))


def describe(data: bytes, kind: str) -> tuple[VideoMetadata, VideoStats]:
    if kind in ("mp4", "mov"):
        return mp4_metadata(data)
    read = {"webm": webm_metadata, "avi": avi_metadata}.get(kind)
    return (read(data) if read else VideoMetadata(format=kind)), VideoStats(file_size=len(data))


def metadata_score(meta: VideoMetadata) -> float:
    low = meta.encoder_name.lower()
    score = 0.5
    score += 0.4 if meta.is_ai_marked else 0.0
    score += 0.0 if meta.has_audio else 0.15
    score += 0.3 if any(x in low for x in GENERATOR_ENCODERS) else 0.0
    score -= 0.1 if any(x in low for x in EDITOR_ENCODERS) else 0.0
    return bs.clamp(score)


def container_score(data: bytes, kind: str) -> float:
    if len(data) < 1000:
        return 0.5
    if kind in ("mp4", "mov"):
        return 0.5 + (0.0 if b"moov" in data[:100_000] else 0.2) + (0.0 if b"mdat" in data else 0.2)
    return 0.7 if kind == "webm" and b"\x18\x53\x80\x67" not in data[:1000] else 0.5


def find_atom(data: bytes, wanted: bytes) -> tuple[int, int]:
    """Place and size of the first such atom's content, looked for within nested atoms too; (-1, 0) if there is none."""
    at = 0
    while at < len(data) - 8:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if size == 1 and at + 16 <= len(data):
            size = int.from_bytes(data[at + 8 : at + 16], "big")
        if size < 8:
            break
        if kind == wanted:
            return at + 8, size - 8
        if kind in NESTED_ATOMS:
            place, inner = find_atom(data[at + 8 : at + size], wanted)
            if place >= 0:
                return at + 8 + place, inner
        at += size
    return -1, 0


_START = re.compile(b"\0\0\0?\1")


def nal_units(data: bytes, most: int, reach: int | None = None) -> list[dict]:
    """Offset, size (with the start code) and type of NAL units. reach: how far from its start a unit's end is looked for."""
    out: list[dict] = []
    at = 0
    while (found := _START.search(data, at)) and found.start() < len(data) - 4 and len(out) < most:
        begin, body = found.start(), found.end()
        if body >= len(data):
            break
        stop = len(data) if reach is None else min(len(data), body + reach + 3)
        following = _START.search(data, body + 1, stop)
        end = following.start() if following and following.start() < min(len(data) - 3, stop) else len(data)
        out.append({"offset": begin, "size": end - begin, "nal_type": data[body] & 0x1F})
        at = end
    return out


def coded_frames(data: bytes, most: int = 500) -> list[dict]:
    """Pictures of an H.264 stream: IDR units as I, other slices as P."""
    units = nal_units(data, 1 << 62, 100_000)
    frames = [{**u, "frame_type": "I" if u["nal_type"] == 5 else "P"} for u in units if u["nal_type"] in (1, 5)]
    return frames[:most]


def key_interval_score(kinds: np.ndarray) -> float:
    places = np.flatnonzero(kinds)
    if len(places) < 2:
        return 0.1 if len(kinds) > 100 else 0.0
    gaps = np.diff(places)
    return 0.05 if gaps.var() < 0.5 and len(gaps) > 3 else -0.05 if gaps.var() > gaps.mean() * 0.5 else 0.0


def gop_score(kinds: np.ndarray) -> float:
    """Even groups of pictures; frames before the first key frame count as a group, the last group doesn't."""
    cuts = np.flatnonzero(kinds)
    sizes = np.diff(np.concatenate(([0], cuts)))
    sizes = sizes[sizes > 0]
    return 0.05 if len(kinds) >= 10 and len(sizes) > 3 and bs.variation(sizes) < 0.05 else 0.0


def size_score(kinds: np.ndarray, sizes: np.ndarray) -> float:
    if len(kinds) < 10:
        return 0.0
    keys, others = sizes[kinds], sizes[~kinds]
    return (0.03 if len(keys) > 2 and bs.variation(keys) < 0.02 else 0.0) + (0.02 if len(others) > 5 and bs.variation(others) < 0.02 else 0.0)


def repeated_size_score(sizes: np.ndarray) -> float:
    counts = Counter(sizes.tolist())
    return 0.05 if len(sizes) > 20 and sum(n > 1 for n in counts.values()) / len(counts) > 0.5 else 0.0


def mp4_temporal_score(data: bytes) -> float:
    at, size = find_atom(data, b"mdat")
    frames = coded_frames(data[at : at + size]) if at >= 0 and size >= 1000 else []
    if len(frames) < 5:
        return 0.5
    kinds, sizes = np.array([f["frame_type"] == "I" for f in frames]), np.array([f["size"] for f in frames])
    return bs.clamp(0.5 + key_interval_score(kinds) + gop_score(kinds) + size_score(kinds, sizes) + repeated_size_score(sizes))


def ebml_length(first: int) -> int:
    """Bytes of a variable-length number by its first byte; 0 if it has no marker."""
    return 9 - first.bit_length() if first else 0


def ebml_size(data: bytes) -> int:
    n = ebml_length(data[0]) if data else 0
    return int.from_bytes(data[:n], "big") & ((1 << 7 * n) - 1) if 0 < n <= len(data) else 0


def block_size_length(data: bytes) -> int:
    """Bytes that a block's size takes; beyond four it counts as five."""
    return min(5, ebml_length(data[0]) or 5) if data else 0


def _even_sizes(sizes: list[int], least: int) -> float:
    return 0.55 if len(sizes) >= least and bs.variation(sizes) < 0.05 else 0.5


def _places(data: bytes, pattern: bytes, end: int):
    return (m.start() for m in re.finditer(pattern, data, re.S) if m.start() < end)


def webm_temporal_score(data: bytes) -> float:
    places = [p for _, p in zip(range(100), _places(data, b"\x1f\x43\xb6\x75", len(data) - 8), strict=False)]
    sizes = [ebml_size(data[p + 4 : p + 12]) for p in places]
    return _even_sizes([s for s in sizes if 0 < s < MOST_CHUNK], 3)


_AVI_CHUNK = rb"0[01]d[cb]"


def avi_temporal_score(data: bytes) -> float:
    sizes = (int.from_bytes(data[p + 4 : p + 8], "little") for p in _places(data, _AVI_CHUNK, len(data) - 8))
    return _even_sizes([s for s in sizes if 0 < s < MOST_CHUNK][:200], 5)


def generic_temporal_score(data: bytes) -> float:
    """Evenly spaced start codes; a long one counts twice, as the short one within it counts too."""
    places = [p for _, p in zip(range(500), _places(data, b"(?=\0\0\0?\1)", len(data) - 4), strict=False)]
    gaps = np.diff(places)
    return 0.55 if len(places) >= 5 and len(gaps) > 10 and bs.variation(gaps) < 0.1 else 0.5


def temporal_score(data: bytes, kind: str) -> float:
    if len(data) < 10_000:
        return 0.5
    by_kind = {"mp4": mp4_temporal_score, "mov": mp4_temporal_score, "webm": webm_temporal_score, "mkv": webm_temporal_score, "avi": avi_temporal_score}
    return by_kind.get(kind, generic_temporal_score)(data)


def encoding_score(data: bytes, meta: VideoMetadata) -> float:
    if any(tag in data for tag in CODEC_TAGS):
        return 0.45
    return 0.6 if meta.format in ("mp4", "webm") else 0.5


def bitrate_score(data: bytes) -> float:
    if len(data) < 100_000:
        return 0.6
    fifth = len(data) // 5
    return 0.6 if np.var([bs.relative_entropy(data[i * fifth : (i + 1) * fifth]) for i in range(5)]) > 0.1 else 0.4


def analyze_video(data: bytes) -> dict:
    kind = video_format(data)
    meta, stats = describe(data, kind)
    signals = {
        "metadata": metadata_score(meta), "container": container_score(data, kind), "audio": 0.3 if meta.has_audio else 0.7, "temporal": temporal_score(data, kind),
        "encoding": encoding_score(data, meta), "bitrate": bitrate_score(data),
    }
    return {"ai_score": bs.weighted_mean(signals.values(), WEIGHTS.values()), "signals": signals, "metadata": asdict(meta), "stats": asdict(stats)}


# --- frames: operators of their own, which the score doesn't use ------------------------------


def key_sample_numbers(data: bytes) -> set[int]:
    """Frame numbers, from 0, that the first stss box lists (1000 at most)."""
    at = bs.find_marker(data, b"stss", end=len(data) - 8)
    if at < 0 or at + 12 > len(data):
        return set()
    n = min(1000, int.from_bytes(data[at + 8 : at + 12], "big"))
    listed = np.frombuffer(data[at + 12 : at + 12 + 4 * n][: (len(data) - at - 12) // 4 * 4], dtype=">u4")
    return {int(x) - 1 for x in listed}


def dimensions(nal: bytes) -> tuple[int, int]:
    """A common resolution that the first parameter set within the unit hints at, or (0, 0)."""
    for found in _START.finditer(nal, 0, max(0, len(nal) - 7)):
        if found.start() < len(nal) - 10 and nal[found.end()] & 0x1F == 7:
            body = nal[found.end() :]
            if len(body) >= 10:
                for width, height in RESOLUTIONS:
                    if any(x in ((width + 15) // 16, (height + 15) // 16) for x in body[:-2]):
                        return width, height
            return 0, 0
    return 0, 0


def _mp4_candidates(data: bytes, config: ExtractionConfig):
    at, size = find_atom(data, b"mdat")
    if at < 0 or size < 100:
        return
    listed = key_sample_numbers(data)
    for i, u in enumerate(nal_units(data[at : at + size], 1001)):
        key = u["nal_type"] in KEY_NALS
        if not config.keyframes_only or key and (not listed or i in listed):
            body = data[at : at + size][u["offset"] : u["offset"] + u["size"]]
            yield i, key, at + u["offset"], u["size"], body, dimensions(body) if key else (0, 0)


def _webm_candidates(data: bytes, config: ExtractionConfig):
    for p in _places(data, b"\xa3", len(data) - 10):
        size = ebml_size(data[p + 1 : p + 9])
        start = p + 1 + block_size_length(data[p + 1 : p + 2])
        if not 0 < size <= min(MOST_CHUNK, len(data) - p - 1) or start + 4 > len(data):
            continue
        track = 1 if data[start] & 0x80 else 2
        if start + track + 3 > len(data):
            continue
        key = bool(data[start + track + 2] & 0x80)
        if key or not config.keyframes_only:
            yield None, key, start, size, data[start : start + size], (0, 0)


def _avi_candidates(data: bytes, config: ExtractionConfig):
    i = 0
    for p in _places(data, _AVI_CHUNK, len(data) - 8):
        size = int.from_bytes(data[p + 4 : p + 8], "little")
        if not 0 < size <= MOST_CHUNK or p + 8 + size > len(data):
            continue
        key = i == 0 or size > 50_000
        if key or not config.keyframes_only:
            yield i, key, p + 8, size, data[p + 8 : p + 8 + size], (0, 0)
        i += 1


def _stream_candidates(data: bytes, config: ExtractionConfig):
    for u in nal_units(data, 1001):
        key = u["nal_type"] in KEY_NALS
        if key or not config.keyframes_only and u["nal_type"] == 1:
            yield None, key, u["offset"], u["size"], data[u["offset"] : u["offset"] + u["size"]], (0, 0)


def extract_frames(data: bytes, config: ExtractionConfig = ExtractionConfig()) -> list[dict]:  # noqa: B008
    """Every sample_rate-th qualifying frame, max_frames at most. Frames without a number of their own are numbered as they are taken."""
    if not config.enabled or len(data) < 100:
        return []
    kind = video_format(data)
    read = {"mp4": _mp4_candidates, "mov": _mp4_candidates, "webm": _webm_candidates, "mkv": _webm_candidates, "avi": _avi_candidates}.get(kind, _stream_candidates)
    out: list[dict] = []
    for seen, (number, key, offset, size, body, (width, height)) in enumerate(read(data, config), 1):
        if seen % max(1, config.sample_rate):
            continue
        out.append({"frame_index": len(out) if number is None else number, "frame_type": "I" if key else "P", "offset": offset, "size": size, "data": body, "width": width, "height": height})
        if len(out) >= config.max_frames:
            break
    return out


def byte_difference(a: bytes, b: bytes) -> float:
    """Share of differing bytes over a common prefix, sampled evenly if it is long."""
    n = min(len(a), len(b))
    if not n:
        return 0.0
    step = n // min(n, 10_000)
    return float((bs.as_bytes(a[:n])[::step] != bs.as_bytes(b[:n])[::step]).mean())


def histogram_difference(a: bytes, b: bytes) -> float:
    """Chi-squared distance of byte histograms on a scale of the bytes' number, 1 at most."""
    x, y = bs.histogram(a).astype(float), bs.histogram(b).astype(float)
    middle = (x + y) / 2
    some = middle > 0
    distance = (((x - middle) ** 2 + (y - middle) ** 2)[some] / middle[some]).sum()
    return float(min(1.0, distance / (len(a) + len(b)))) if a or b else 0.0


def frame_consistency(frames: list[dict]) -> float:
    if len(frames) < 2:
        return 0.5
    by_size, by_entropy = bs.variation([f["size"] for f in frames]), bs.variation([bs.relative_entropy(f["data"]) for f in frames])
    score = 0.5
    score += 0.1 if by_size < 0.1 else -0.1 if by_size > 0.5 else 0.0
    score += 0.1 if by_entropy < 0.05 else -0.1 if by_entropy > 0.2 else 0.0
    return bs.clamp(score)


def temporal_consistency(frames: list[dict]) -> dict:
    """Flicker, lighting, morphing and change between neighbours; neutral for fewer than three frames."""
    if len(frames) < 3:
        return {"overall": 0.5, "flickering": 0.0, "diff_variance": 0.0, "lighting": 0.0, "morphing": 0.0, "size_deltas": [], "entropy_deltas": []}
    pairs = list(zip(frames, frames[1:], strict=False))
    changed = np.array([byte_difference(a["data"], b["data"]) for a, b in pairs])
    sizes = np.diff([float(f["size"]) for f in frames])
    entropies = np.diff([bs.relative_entropy(f["data"]) for f in frames])
    turns = float(np.mean((entropies[1:] > 0) != (entropies[:-1] > 0)))
    flicker = 0.7 if turns > 0.8 else 0.6 if turns > 0.6 else 0.3 if turns < 0.3 else 0.5
    light = bs.variation([bs.as_bytes(f["data"]).mean() if f["data"] else 0.0 for f in frames])
    lighting = 0.65 if light < 0.01 else 0.6 if light > 0.3 else 0.35 if 0.02 < light < 0.15 else 0.5
    smooth = float((changed < 0.1).mean())
    morphing = 0.5
    if len(pairs) >= 3:
        morphing += 0.1 if smooth > 0.7 else 0.0
        morphing += 0.1 if sizes.var() < 1000 and smooth > 0.5 else 0.0
    spread = float(changed.var())
    by_spread = 0.7 if spread < 0.001 else 0.6 if spread < 0.01 else 0.4 if spread > 0.1 else 0.5
    overall = bs.clamp(flicker * 0.25 + lighting * 0.20 + morphing * 0.25 + by_spread * 0.30)
    return {"overall": overall, "flickering": flicker, "diff_variance": spread, "lighting": lighting, "morphing": morphing, "size_deltas": sizes.tolist(), "entropy_deltas": entropies.tolist()}


RESULT = T.StructType(
    [
        T.StructField("ai_score", T.DoubleType()),
        T.StructField("signals", T.StructType([T.StructField(n, T.DoubleType()) for n in WEIGHTS])),
        T.StructField("metadata", struct_of(VideoMetadata)),
        T.StructField("stats", struct_of(VideoStats)),
        T.StructField("error", T.StringType()),
    ]
)
FRAME = T.StructType(
    [
        T.StructField("frame_index", T.LongType()),
        T.StructField("frame_type", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
    ]
)
_TEMPORAL = T.StructType([*[T.StructField(n, T.DoubleType()) for n in ("overall", "flickering", "diff_variance", "lighting", "morphing")], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("size_deltas", "entropy_deltas")]])
MOTION = T.StructType([T.StructField("n_frames", T.LongType()), T.StructField("consistency", T.DoubleType()), T.StructField("temporal", _TEMPORAL), T.StructField("error", T.StringType())])


def analyze_videos(items: DataFrame, content: str = "content") -> DataFrame:
    """items with column video: score, signals, metadata, stats, or an error."""
    return analyze_binary(items, content, "video", analyze_video, RESULT)


def frames_of(items: DataFrame, keep: list[str], content: str = "content", config: ExtractionConfig = ExtractionConfig()) -> DataFrame:  # noqa: B008
    """One row per extracted frame."""
    return explode_binary(items, content, lambda data: extract_frames(data, config), FRAME, keep)


def analyze_motion(items: DataFrame, content: str = "content", config: ExtractionConfig = ExtractionConfig(keyframes_only=False)) -> DataFrame:  # noqa: B008
    """items with column motion: how consistent the extracted frames are from one to the next."""

    def run(data: bytes) -> dict:
        frames = extract_frames(data, config)
        return {"n_frames": len(frames), "consistency": frame_consistency(frames), "temporal": temporal_consistency(frames)}

    return analyze_binary(items, content, "motion", run, MOTION)


def analyze_frame_images(frames: DataFrame) -> DataFrame:
    """The image analysis of frames of 100 bytes or more."""
    return image.analyze_images(frames.where(F.octet_length("data") >= 100), "data")


def frame_changes(frames: DataFrame, key: str) -> DataFrame:
    """Change of size from the frame before, by item: a window over frame numbers."""
    order = Window.partitionBy(key).orderBy("frame_index")
    return frames.withColumn("size_delta", F.col("size") - F.lag("size").over(order))
