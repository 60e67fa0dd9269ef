"""Image forensics from bytes: metadata, chunks and six signals. Pixels are never decoded."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import byte_stats as bs
from .media import analyze_binary, struct_of

# Signal weights.
WEIGHTS = {"metadata": 0.25, "color": 0.20, "edge": 0.15, "noise": 0.15, "compression": 0.15, "symmetry": 0.10}

# Names that generators leave in files.
JPEG_GENERATORS = (b"DALL-E", b"Midjourney", b"Stable Diffusion", b"ComfyUI", b"NovelAI")
PNG_GENERATORS = (
    b"DALL-E", b"Midjourney", b"Stable Diffusion", b"ComfyUI", b"NovelAI", b"Automatic1111", b"InvokeAI", b"DreamStudio", b"Leonardo.AI", b"Adobe Firefly",
    b"Imagen", b"SDXL",
)
GENERATED = "AI Generator"

# TIFF type sizes, tags and codes.
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TEXT_TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0131: "software", 0x0132: "date_taken", 0x013B: "artist", 0x8298: "copyright"}
NUMBER_TAGS = {0x0112: "orientation", 0x011A: "x_resolution", 0x011B: "y_resolution"}
RESOLUTION_UNITS = {1: "None", 2: "inches", 3: "centimeters"}
EXIF_TEXT_TAGS = {0x9000: "exif_version", 0xA433: "lens_make", 0xA434: "lens_model"}
EXIF_RAW_TAGS = {0x829A: "exposure_time", 0x829D: "aperture", 0x920A: "focal_length"}
COLOR_SPACES = {1: "sRGB", 65535: "Uncalibrated"}
FLASH = {
    0: "No Flash", 1: "Flash Fired", 5: "Flash Fired, Return not detected", 7: "Flash Fired, Return detected", 8: "On, Flash did not fire", 9: "On, Flash Fired",
    16: "Off, Flash did not fire", 24: "Auto, Flash did not fire", 25: "Auto, Flash Fired",
}


@dataclass
class ImageMetadata:
    file_format: str = ""
    has_exif: bool = False
    camera_make: str = ""
    camera_model: str = ""
    lens_make: str = ""
    lens_model: str = ""
    software: str = ""
    date_taken: str = ""
    artist: str = ""
    copyright: str = ""
    orientation: int = 0
    x_resolution: int = 0
    y_resolution: int = 0
    resolution_unit: str = ""
    exposure_time: str = ""
    aperture: str = ""
    iso: int = 0
    flash: str = ""
    focal_length: str = ""
    color_space: str = ""
    exif_version: str = ""
    has_thumbnail: bool = False
    has_gps: bool = False
    gps_latitude: float = 0.0
    gps_longitude: float = 0.0
    gps_altitude: float = 0.0
    gps_timestamp: str = ""
    is_screenshot: bool = False


@dataclass
class ImageStats:
    width: int = 0
    height: int = 0
    bit_depth: int = 0
    color_channels: int = 0


@dataclass
class PngChunks:
    chunks: list = field(default_factory=list)
    texts: dict = field(default_factory=dict)
    kinds: set = field(default_factory=set)
    header: dict = field(default_factory=dict)
    profile: str = ""
    dpi: int = 0
    modified: str = ""
    generator: str = ""


def image_format(data: bytes) -> str:
    if len(data) < 8:
        return "unknown"
    for head, name in ((b"\xff\xd8\xff", "jpeg"), (b"\x89PNG", "png"), (b"GIF8", "gif"), (b"BM", "bmp")):
        if data.startswith(head):
            return name
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else "unknown"


def format_column(data: Column) -> Column:
    """image_format in the JVM."""
    head = lambda n: F.substring(data, 1, n)
    return (
        F.when(F.octet_length(data) < 8, "unknown").when(head(3) == F.lit(b"\xff\xd8\xff"), "jpeg").when(head(4) == F.lit(b"\x89PNG"), "png").when(head(4) == F.lit(b"GIF8"), "gif")
        .when(head(2) == F.lit(b"BM"), "bmp").when((head(4) == F.lit(b"RIFF")) & (F.substring(data, 9, 4) == F.lit(b"WEBP")), "webp").otherwise("unknown")
    )


def clean_string(raw: bytes | str) -> str:
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw
    return text.rstrip("\x00").strip()


def leading_integer(text: str) -> int | None:
    found = re.match(r"\+?(\d+)", text.strip())
    return int(found[1]) if found else None


def decode_flash(code: int) -> str:
    return FLASH.get(code, f"Flash ({code})")


class Tiff:
    """Directories of tags in one byte order."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "little", b"MM": "big"}.get(data[:2]) if len(data) >= 8 else None
        self.valid = self.order is not None and self.number(2, 2) == 42 and self.number(4, 4) < len(data)

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size], self.order)

    def entries(self, at: int, most: int):
        """(tag, type, count, place of the value) of the directory at a place; of one that claims more tags, `most` at most."""
        if at + 2 > len(self.data):
            return
        for i in range(min(most, self.number(at, 2))):
            place = at + 2 + 12 * i
            if place + 12 > len(self.data):
                return
            yield self.number(place, 2), self.number(place + 2, 2), self.number(place + 4, 4), place + 8

    def value(self, kind: int, count: int, place: int) -> str:
        """A tag's value as text; numbers by their first element."""
        size = TIFF_SIZES.get(kind, 0) * count
        if size <= 4:
            raw = self.data[place : place + 4]
        else:
            start = self.number(place, 4)
            raw = self.data[start : start + size] if start + size <= len(self.data) else b""
        if kind in (1, 2, 7):
            return raw[:count].decode("utf-8", "replace")
        if kind in (3, 4) and len(raw) >= 2 * (kind - 2):
            return str(int.from_bytes(raw[: 2 * (kind - 2)], self.order))
        if kind in (5, 10) and len(raw) >= 8 and (below := int.from_bytes(raw[4:8], self.order)):
            return f"{int.from_bytes(raw[:4], self.order) / below:.4f}"
        return ""

    def rationals(self, place: int, n: int) -> list[float] | None:
        start = self.number(place, 4)
        if start + 8 * n > len(self.data):
            return None
        pairs = [(self.number(start + 8 * i, 4), self.number(start + 8 * i + 4, 4)) for i in range(n)]
        return [above / below if below else 0.0 for above, below in pairs]


def read_exif(data: bytes, meta: ImageMetadata) -> None:
    tiff = Tiff(data)
    if not tiff.valid:
        return
    first = tiff.number(4, 4)
    pointer = _read_directory(tiff, first, meta, False)
    if 0 < pointer < len(data):
        _read_directory(tiff, pointer, meta, True)
    gps = next((tiff.number(place, 4) for tag, _, _, place in tiff.entries(first, 200) if tag == 0x8825), 0)
    if 0 < gps < len(data):
        _read_gps(tiff, gps, meta)
    after = first + 2 + 12 * tiff.number(first, 2)
    meta.has_thumbnail = first + 2 < len(data) and after + 4 <= len(data) and 0 < tiff.number(after, 4) < len(data)


def _read_directory(tiff: Tiff, at: int, meta: ImageMetadata, exif: bool) -> int:
    """Set the fields that a directory has; return where the EXIF directory is."""
    pointer = 0
    if at + 2 <= len(tiff.data) and tiff.number(at, 2) > 200:
        return 0
    for tag, kind, count, place in tiff.entries(at, 200):
        value = tiff.value(kind, count, place)
        number = leading_integer(value)
        if tag in TEXT_TAGS:
            setattr(meta, TEXT_TAGS[tag], clean_string(value))
        elif tag in NUMBER_TAGS and number is not None:
            setattr(meta, NUMBER_TAGS[tag], number)
        elif tag == 0x0128 and number in RESOLUTION_UNITS:
            meta.resolution_unit = RESOLUTION_UNITS[number]
        elif tag == 0x8769 and number is not None:
            pointer = number
        if not exif:
            continue
        if tag in EXIF_TEXT_TAGS:
            setattr(meta, EXIF_TEXT_TAGS[tag], clean_string(value))
        elif tag in EXIF_RAW_TAGS:
            setattr(meta, EXIF_RAW_TAGS[tag], value)
        elif tag == 0x8827 and number is not None:
            meta.iso = number
        elif tag == 0x9003:
            meta.date_taken = meta.date_taken or clean_string(value)
        elif tag == 0x9209 and number is not None:
            meta.flash = decode_flash(number)
        elif tag == 0xA001 and number in COLOR_SPACES:
            meta.color_space = COLOR_SPACES[number]
        elif tag == 0xA405:
            meta.focal_length = meta.focal_length or f"{value}mm (35mm equivalent)"
    return pointer


def _read_gps(tiff: Tiff, at: int, meta: ImageMetadata) -> None:
    if at + 2 > len(tiff.data):
        return
    meta.has_gps = True
    references, degrees = {}, {}
    for tag, kind, count, place in tiff.entries(at, 50):
        if tag in (1, 3):
            references[tag] = clean_string(tiff.value(kind, count, place))
        elif tag in (2, 4):
            degrees[tag] = tiff.rationals(place, 3) or [0.0] * 3
        elif tag == 6 and (altitude := tiff.rationals(place, 1)):
            meta.gps_altitude = altitude[0] or meta.gps_altitude
        elif tag == 7:
            meta.gps_timestamp = tiff.value(kind, count, place)
    for tag, name, negative in ((2, "gps_latitude", "S"), (4, "gps_longitude", "W")):
        d, m, s = degrees.get(tag, (0.0, 0.0, 0.0))
        angle = d + m / 60 + s / 3600
        setattr(meta, name, -angle if references.get(tag - 1) == negative else angle)


def jpeg_metadata(data: bytes) -> ImageMetadata:
    meta = ImageMetadata(file_format="jpeg")
    if len(data) < 12:
        return meta
    at = bs.find_marker(data, b"\xff\xe1", end=len(data) - 10)
    if at >= 0:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if at + 4 + size <= len(data):
            if size < 2:
                raise ValueError("an APP1 segment is shorter than its length field")
            segment = data[at + 4 : at + 2 + size]
            if len(segment) >= 6 and segment[:4] == b"Exif":
                meta.has_exif = True
                if len(segment) >= 14:
                    read_exif(segment[6:], meta)
    meta.is_screenshot = not (meta.software or meta.has_exif or meta.camera_make)
    if any(name in data for name in JPEG_GENERATORS):
        meta.software = GENERATED
    return meta


def png_chunks(data: bytes) -> PngChunks:
    """All chunks of a PNG, with what the text, profile, size and time chunks say."""
    out, at = PngChunks(), 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        end = at + 12 + size
        if end > len(data):
            break
        kind, body = data[at + 4 : at + 8].decode("latin-1"), data[at + 8 : at + 8 + size]
        out.chunks.append({"type": kind, "length": size, "crc": int.from_bytes(data[end - 4 : end], "big")})
        out.kinds.add(kind)
        _read_chunk(kind, body, out)
        out.generator = next((g.decode() for g in PNG_GENERATORS if g in body), out.generator)
        at = end
    return out


def _read_chunk(kind: str, body: bytes, out: PngChunks) -> None:
    zero = body[:80].find(b"\0")
    key = body[:zero].decode("utf-8", "replace") if zero > 0 else ""
    if kind == "IHDR" and len(body) >= 13:
        out.header = dict(zip(("bit_depth", "color_type", "compression", "filter", "interlace"), body[8:13], strict=True))
    elif kind == "tEXt" and 0 < zero < len(body) - 1:
        out.texts[key] = clean_string(body[zero + 1 :])
    elif kind == "iTXt" and zero > 0 and zero + 3 < len(body):
        start = max(zero + 3, body.rfind(b"\0", zero + 3) + 1)
        if start < len(body):
            out.texts[key] = clean_string(body[start:])
    elif kind == "zTXt" and zero > 0:
        out.texts[key] = "[compressed]"
    elif kind == "iCCP" and zero > 0:
        out.profile = key
    elif kind == "pHYs" and len(body) >= 9 and body[8] == 1:
        out.dpi = int(sum(int.from_bytes(body[i : i + 4], "big") / 39.3701 for i in (0, 4)) / 2)
    elif kind == "tIME" and len(body) >= 7:
        out.modified = "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(int.from_bytes(body[:2], "big"), *body[2:7])


def png_metadata(data: bytes) -> ImageMetadata:
    meta = ImageMetadata(file_format="png")
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return meta
    info = png_chunks(data)
    text = info.texts.get
    meta.has_exif = bool(info.kinds & {"tEXt", "iTXt", "eXIf"})
    meta.software = text("Software") or text("software") or text("Description") or ""
    meta.artist = text("Author") or text("artist") or ""
    meta.copyright = text("Copyright") or ""
    meta.date_taken = info.modified or text("Creation Time") or ""
    if info.generator:
        meta.software = GENERATED
    if info.dpi > 0:
        meta.x_resolution = meta.y_resolution = info.dpi
        meta.resolution_unit = "inches"
    meta.color_space = "sRGB" if "sRGB" in info.kinds else info.profile
    meta.is_screenshot = not (info.kinds & {"tEXt", "iTXt", "iCCP"} or meta.software or meta.artist)
    return meta


def metadata_of(data: bytes, kind: str) -> ImageMetadata:
    return {"jpeg": jpeg_metadata, "png": png_metadata}.get(kind, lambda _: ImageMetadata(file_format=kind))(data)


def stats_of(data: bytes, kind: str) -> ImageStats:
    big = lambda at, n: int.from_bytes(data[at : at + n], "big")
    if kind == "jpeg":
        at = bs.find_marker(data, b"\xff\xc0", b"\xff\xc2", end=len(data) - 10)
        return ImageStats(big(at + 7, 2), big(at + 5, 2), data[at + 4], data[at + 9]) if at >= 0 else ImageStats()
    if kind == "png" and len(data) >= 24:
        return ImageStats(big(16, 4), big(20, 4), data[24] if len(data) > 24 else 0)
    return ImageStats()


def metadata_score(meta: ImageMetadata) -> float:
    score = 0.5
    score += -0.2 if meta.has_exif else 0.2
    score -= 0.2 if meta.camera_make else 0.0
    score -= 0.2 if meta.has_gps else 0.0
    score += 0.4 if meta.software == GENERATED else 0.0
    score -= 0.2 if meta.is_screenshot else 0.0
    return bs.clamp(score)


def scan_start(data: bytes) -> int:
    """Where a JPEG's entropy-coded data begins, or -1."""
    at = bs.find_marker(data, b"\xff\xda", end=len(data) - 10)
    return at + 2 + int.from_bytes(data[at + 2 : at + 4], "big") if at >= 0 else -1


def data_offset(data: bytes, kind: str) -> int:
    if kind == "jpeg":
        start = scan_start(data)
        return 100 if start < 0 else start
    if kind == "png":
        at = 8
        while at < len(data) - 12:
            if data[at + 4 : at + 8] == b"IDAT":
                return at + 8
            at += 12 + int.from_bytes(data[at : at + 4], "big")
        return 50
    return 100


def _sample(data: bytes, kind: str, least: int, most: int) -> np.ndarray | None:
    at = data_offset(data, kind)
    return bs.as_bytes(data[at : at + most]) if at + least <= len(data) else None


def entropy_score(data: bytes, kind: str) -> float:
    sample = _sample(data, kind, 2000, 5000)
    if sample is None:
        return 0.5
    x = bs.relative_entropy(sample)
    return 0.75 if x < 0.5 else 0.6 if x < 0.65 or x > 0.97 else 0.45 if x > 0.92 else 0.35


def histogram_shape_score(data: bytes, kind: str) -> float:
    sample = _sample(data, kind, 3000, 10_000)
    if sample is None:
        return 0.5
    h = bs.histogram(sample).astype(float)
    gaps = float((h[10:246] == 0).sum()) / 236.0
    around = (h[:-4] + h[1:-3] + h[3:-1] + h[4:]) / 4.0
    spikes = float(((around > 0) & (h[2:-2] > around * 5)).sum()) / 256.0
    levels, share = np.arange(256), h / h.sum()
    mean = float((levels * share).sum())
    spread = float(np.sqrt(((levels - mean) ** 2 * share).sum()))
    skew = float((((levels - mean) / spread) ** 3 * share).sum()) if spread > 0 else 0.0
    score = 0.4
    score += 0.2 if gaps > 0.3 else 0.1 if gaps > 0.15 else 0.0
    score += 0.2 if spikes > 0.05 else 0.1 if spikes > 0.02 else 0.0
    score += 0.1 if abs(skew) > 1.5 else 0.0
    return min(0.9, score)


def banding_score(data: bytes, kind: str) -> float:
    sample = _sample(data, kind, 2000, 8000)
    if sample is None:
        return 0.5
    steps = np.diff(sample.astype(np.int64))
    ends = np.flatnonzero(steps)
    closed = np.diff(np.concatenate(([-1], ends)))  # lengths of runs of equal bytes but the last
    repeats = float((closed > 8).sum()) / (len(sample) // 10)
    near = float((np.abs(steps) <= 2).sum()) / len(sample)
    score = 0.4
    score += 0.25 if repeats > 0.2 else 0.15 if repeats > 0.1 else 0.0
    score += 0.15 if near > 0.7 else 0.0
    return min(0.85, score)


def peak_score(data: bytes, kind: str) -> float:
    sample = _sample(data, kind, 2000, 8000)
    if sample is None:
        return 0.5
    h = bs.histogram(sample)
    middle = h[2:-2]
    peaks = np.flatnonzero((middle > h[1:-3]) & (middle > h[3:-1]) & (middle > h[:-4]) & (middle > h[4:])) + 2
    held = sum(int(h[max(0, p - 3) : p + 4].sum()) for p in peaks) / len(sample)
    spacing = np.diff(peaks)
    regular = len(spacing) >= 2 and spacing.std() < spacing.mean() * 0.2
    round_ones = int((peaks % 16 == 0).sum())
    score = 0.4
    score += 0.15 if len(peaks) > 20 else 0.0
    score += 0.15 if held > 0.6 else 0.0
    score += 0.15 if regular else 0.0
    score += 0.1 if round_ones > len(peaks) // 3 and round_ones > 2 else 0.0
    return min(0.85, score)


def color_score(data: bytes, kind: str) -> float:
    if len(data) < 2000:
        return 0.5
    parts = (entropy_score(data, kind) * 0.25, histogram_shape_score(data, kind) * 0.30, banding_score(data, kind) * 0.25, peak_score(data, kind) * 0.20)
    return bs.clamp(sum(parts))


def edge_score(data: bytes) -> float:
    if len(data) < 5000:
        return 0.5
    samples = [data[i : i + 256] for i in range(1000, len(data) - 256, len(data) // 12)][:10]
    if len(samples) < 3:
        return 0.5
    alike = [bs.similarity(a, b) > 0.9 for i, a in enumerate(samples) for b in samples[i + 1 :]]
    return 0.7 if sum(alike) / len(alike) > 0.3 else 0.4


def noise_score(data: bytes) -> float:
    if len(data) < 2000:
        return 0.5
    variances = bs.as_bytes(data[500 : 500 + 62 * 16]).reshape(62, 16).astype(float).var(axis=1)
    mean = float(variances.mean())
    return 0.7 if mean < 10 else 0.6 if float(variances.std()) / (mean + 1) > 2.0 else 0.4


def quantization_score(data: bytes) -> float:
    at = bs.find_marker(data, b"\xff\xdb", end=len(data) - 100)
    if at < 0:
        return 0.5
    total = sum(data[at + 5 : at + 69])
    return 0.7 if total < 200 else 0.6 if total > 3000 else 0.4


def coefficient_score(data: bytes) -> float:
    start = scan_start(data)
    if start < 0 or start >= len(data) - 1000:
        return 0.5
    scan = bs.as_bytes(data[start : start + 5000])
    bits, zeros = bs.entropy(scan), bs.zero_runs(scan)["mean"]
    marks = scan[:-1] == 0xFF
    stuffed = float((scan[1:][marks] == 0).mean()) if marks.any() else None
    by_bits = 0.7 if bits < 6.5 else 0.6 if bits > 7.9 else 0.4
    by_zeros = 0.6 if zeros < 1.5 or zeros > 8.0 else 0.4
    by_stuffing = 0.5 if stuffed is None else 0.6 if stuffed < 0.3 else 0.4 if stuffed > 0.95 else 0.5
    return by_bits * 0.4 + by_zeros * 0.3 + by_stuffing * 0.3


def double_compression_score(data: bytes) -> float:
    tables = at = 0
    while 0 <= (at := data.find(b"\xff\xdb", at)) < len(data) - 4:
        tables += 1
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    if tables > 2:
        return 0.65
    middle = len(data) // 2
    if len(data) < 10_000 or middle + 2048 > len(data):
        return 0.5
    sample = data[middle : middle + 2048]
    by_16 = bs.periodicity(sample, 16)
    return 0.6 if by_16 > bs.periodicity(sample, 8) * 1.5 and by_16 > 0.3 else 0.4


def compression_score(data: bytes, kind: str) -> float:
    if kind != "jpeg":
        return 0.5
    return bs.clamp(quantization_score(data) * 0.3 + coefficient_score(data) * 0.4 + double_compression_score(data) * 0.3)


def symmetry_score(data: bytes) -> float:
    middle = len(data) // 2
    if len(data) < 2000 or middle + 500 > len(data):
        return 0.5
    return 0.7 if bs.similarity(data[100:600], data[middle : middle + 500]) > 0.7 else 0.4


def analyze_image(data: bytes) -> dict:
    kind = image_format(data)
    meta = metadata_of(data, kind)
    signals = {
        "metadata": metadata_score(meta), "color": color_score(data, kind), "edge": edge_score(data), "noise": noise_score(data),
        "compression": compression_score(data, kind), "symmetry": symmetry_score(data),
    }
    return {"ai_score": bs.weighted_mean(signals.values(), WEIGHTS.values()), "signals": signals, "metadata": asdict(meta), "stats": asdict(stats_of(data, kind))}


RESULT = T.StructType(
    [
        T.StructField("ai_score", T.DoubleType()),
        T.StructField("signals", T.StructType([T.StructField(n, T.DoubleType()) for n in WEIGHTS])),
        T.StructField("metadata", struct_of(ImageMetadata)),
        T.StructField("stats", struct_of(ImageStats)),
        T.StructField("error", T.StringType()),
    ]
)


def analyze_images(items: DataFrame, content: str = "content") -> DataFrame:
    """items with column image: score, signals, metadata, stats, or an error for bytes that can't be read."""
    return analyze_binary(items, content, "image", analyze_image, RESULT)
