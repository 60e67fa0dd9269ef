"""Audio forensics from bytes: containers, frames, PCM statistics, spectra, and six signals."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import byte_stats as bs
from .media import analyze_binary, explode_binary, struct_of

# Signal weights.
WEIGHTS = {"metadata": 0.25, "format": 0.15, "pattern": 0.20, "quality": 0.15, "signatures": 0.15, "noise": 0.10}

# Markers, looked for in lower case; encoders by the order in which they are tried.
GENERATED_MARKERS = (
    b"elevenlabs", b"eleven labs", b"murf", b"play.ht", b"resemble", b"descript", b"synthesia", b"wellsaid", b"suno", b"udio", b"musicgen", b"riffusion",
    b"ai generated", b"ai-generated", b"synthetic voice", b"text to speech", b"text-to-speech", b"tts", b"voice clone", b"cloned voice",
)
RECORDING_MARKERS = (
    b"recorded", b"recording", b"studio", b"microphone", b"live", b"concert", b"session", b"interview", b"iphone", b"android", b"voice memo",
)
SIGNATURES = (
    b"elevenlabs", b"murf.ai", b"play.ht", b"resemble.ai", b"suno", b"udio", b"generated", b"synthetic", b"ai voice", b"text-to-speech", b"tts", b"voice clone",
)
GENERATOR_TOOLS = (
    "elevenlabs", "eleven labs", "murf", "play.ht", "resemble", "descript", "synthesia", "wellsaid", "amazon polly", "google tts", "azure speech", "suno", "udio",
    "musicgen", "riffusion",
)
ENCODERS = {
    b"lame": "LAME", b"ffmpeg": "ffmpeg", b"audacity": "Audacity", b"adobe": "Adobe Audition", b"logic": "Logic Pro", b"pro tools": "Pro Tools",
    b"ableton": "Ableton Live", b"fl studio": "FL Studio", b"elevenlabs": "ElevenLabs", b"suno": "Suno AI", b"udio": "Udio",
}

# MPEG header tables.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
SAMPLE_RATES = (44100, 48000, 32000, 0)
STANDARD_RATES = (44100, 48000, 96000, 22050, 16000)
MOST_SAMPLES = 10_000_000


@dataclass
class AudioMetadata:
    format: str = ""
    sample_rate: int = 0
    channels: int = 0
    bit_depth: int = 0
    bitrate: int = 0
    duration: float = 0.0
    has_id3: bool = False
    encoder_name: str = ""
    is_ai_marked: bool = False
    has_recording: bool = False


@dataclass
class AudioStats:
    file_size: int = 0
    has_waveform_stats: bool = False
    silence_ratio: float = 0.0
    peak_amplitude: float = 0.0
    dynamic_range: float = 0.0
    rms_amplitude: float = 0.0
    zero_crossing_rate: float = 0.0
    spectral_centroid: float = 0.0
    spectral_rolloff: float = 0.0
    crest: float = 0.0


def audio_format(data: bytes) -> str:
    if len(data) < 12:
        return "unknown"
    if data[0] == 0xFF and data[1] & 0xE0 == 0xE0 or data[:3] == b"ID3":
        return "mp3"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    return {b"fLaC": "flac", b"OggS": "ogg"}.get(data[:4], "m4a" if data[4:8] == b"ftyp" else "unknown")


def format_column(data: Column) -> Column:
    """audio_format in the JVM."""
    from ..functions.routing import byte_at

    head = lambda at, n: F.substring(data, at + 1, n)
    sync = (byte_at(data, 0) == 0xFF) & (byte_at(data, 1).bitwiseAND(F.lit(0xE0)) == 0xE0)
    return (
        F.when(F.octet_length(data) < 12, "unknown").when(sync | (head(0, 3) == F.lit(b"ID3")), "mp3")
        .when((head(0, 4) == F.lit(b"RIFF")) & (head(8, 4) == F.lit(b"WAVE")), "wav").when(head(0, 4) == F.lit(b"fLaC"), "flac").when(head(0, 4) == F.lit(b"OggS"), "ogg")
        .when(head(4, 4) == F.lit(b"ftyp"), "m4a").otherwise("unknown")
    )


def has_any(data: bytes, markers: tuple[bytes, ...]) -> bool:
    low = data.lower()
    return any(m in low for m in markers)


def encoder_of(data: bytes, encoders: dict[bytes, str] = ENCODERS) -> str:
    """The first encoder, in the table's order, whose key stands in the data."""
    low = data.lower()
    return next((name for key, name in encoders.items() if key in low), "")


def _sync_places(data: bytes) -> np.ndarray:
    x = bs.as_bytes(data)
    return np.flatnonzero((x[:-4] == 0xFF) & (x[1:-3] & 0xE0 == 0xE0)) if len(x) > 4 else np.empty(0, dtype=np.int64)


def mp3_metadata(data: bytes) -> AudioMetadata:
    meta = AudioMetadata(format="mp3")
    if len(data) > 10 and data[:3] == b"ID3":
        meta.has_id3 = True
        size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
        if 0 < size < len(data) - 10:
            tag = data[10 : 10 + size]
            meta.is_ai_marked, meta.has_recording, meta.encoder_name = has_any(tag, GENERATED_MARKERS), has_any(tag, RECORDING_MARKERS), encoder_of(tag)
    places = _sync_places(data)
    if len(places):
        header = int.from_bytes(data[places[0] : places[0] + 4], "big")
        meta.sample_rate = SAMPLE_RATES[header >> 10 & 3]
        meta.channels = 1 if header >> 6 & 3 == 3 else 2
        meta.bitrate = BITRATES[header >> 12 & 15]
    meta.has_id3 = meta.has_id3 or (len(data) >= 128 and data[-128:-125] == b"TAG")
    return meta


def pcm_samples(data: bytes, bit_depth: int) -> np.ndarray:
    """Little-endian PCM as numbers in [-1, 1], channels interleaved; empty for depths that have no whole number of 1 to 4 bytes."""
    width = bit_depth // 8
    if not 1 <= width <= 4:
        return np.empty(0)
    n = min(len(data) // width, MOST_SAMPLES)
    raw = np.frombuffer(data, dtype=np.uint8, count=n * width)
    if bit_depth == 8:
        return (raw.astype(float) - 128) / 128
    if bit_depth in (16, 32):
        return raw.view(f"<i{width}").astype(float) / (1 << (bit_depth - 1))
    if bit_depth == 24:
        wide = np.zeros((n, 4), dtype=np.uint8)
        wide[:, 1:] = raw.reshape(n, 3)
        return (wide.reshape(-1).view("<i4") >> 8).astype(float) / (1 << 23)
    return np.zeros(n)


def crossings(samples: np.ndarray) -> int:
    return int(np.count_nonzero(np.diff(samples < 0)))


def waveform_stats(samples: np.ndarray, sample_rate: int, size: int = 0) -> AudioStats:
    out = AudioStats(file_size=size)
    n = len(samples)
    if not n:
        return out
    out.has_waveform_stats = True
    out.rms_amplitude, out.peak_amplitude = float(np.sqrt((samples**2).mean())), float(np.abs(samples).max())
    out.zero_crossing_rate = crossings(samples) / n
    out.silence_ratio = float((np.abs(samples) < 0.01).mean())
    if out.rms_amplitude > 0:
        out.crest = out.peak_amplitude / out.rms_amplitude
        out.dynamic_range = float(20 * np.log10(out.crest))
    if n >= 1000 and sample_rate:
        out.spectral_centroid = out.zero_crossing_rate * sample_rate / 2
        energy = float((samples[1:] ** 2).sum())
        if energy:
            high = float((np.diff(samples) ** 2).sum()) / energy
            out.spectral_rolloff = min(sample_rate / 2 * (0.2 + 0.6 * high), sample_rate / 2)
    return out


def wav_chunks(data: bytes) -> list[tuple[bytes, int, int]]:
    """(id, place, size) of the chunks after the RIFF header, up to the first that is empty or cut off."""
    out, at = [], 12
    while at < len(data) - 8:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if size <= 0 or at + 8 + size > len(data):
            break
        out.append((data[at : at + 4], at + 8, size))
        at += 8 + size
    return out


def wav_metadata(data: bytes) -> tuple[AudioMetadata, AudioStats]:
    meta, stats = AudioMetadata(format="wav"), AudioStats(file_size=len(data))
    if len(data) < 44:
        return meta, stats
    little = lambda at, n: int.from_bytes(data[at : at + n], "little")
    pcm = False
    if data[12:16] == b"fmt ":
        pcm = little(20, 2) == 1
        meta.encoder_name = "PCM" if pcm else ""
        meta.channels, meta.sample_rate, meta.bit_depth = little(22, 2), little(24, 4), little(34, 2)
    samples = b""
    for name, at, size in wav_chunks(data):
        body = data[at : at + size]
        if name == b"data":
            samples = body
        elif name == b"LIST":
            meta.is_ai_marked = meta.is_ai_marked or has_any(body, GENERATED_MARKERS)
            meta.has_recording = meta.has_recording or has_any(body, RECORDING_MARKERS)
    if pcm and samples and meta.bit_depth > 0:
        wave = pcm_samples(samples, meta.bit_depth)
        if len(wave):
            stats = waveform_stats(wave, meta.sample_rate, len(data))
            if meta.sample_rate > 0 and meta.channels > 0:
                meta.duration = len(wave) / (meta.sample_rate * meta.channels)
    return meta, stats


def flac_metadata(data: bytes) -> AudioMetadata:
    meta = AudioMetadata(format="flac")
    if len(data) < 42:
        return meta
    meta.sample_rate = data[18] << 12 | data[19] << 4 | data[20] >> 4
    meta.channels = (data[20] >> 1 & 7) + 1
    meta.bit_depth = ((data[20] & 1) << 4 | data[21] >> 4) + 1
    at = 4
    while at < min(len(data) - 4, 10_000):
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        if data[at] & 0x7F == 4 and at + 4 + size <= len(data):
            comment = data[at + 4 : at + 4 + size]
            meta.is_ai_marked = meta.is_ai_marked or has_any(comment, GENERATED_MARKERS)
            meta.encoder_name = encoder_of(comment)
        if data[at] & 0x80:
            break
        at += 4 + size
    return meta


def ogg_metadata(data: bytes) -> AudioMetadata:
    meta = AudioMetadata(format="ogg")
    head = data[:1000]
    if b"vorbis" in head:
        meta.encoder_name = "Vorbis"
    if b"OpusHead" in head:
        meta.format, meta.encoder_name = "opus", "Opus"
    meta.is_ai_marked = len(data) > 500 and has_any(data[:5000], GENERATED_MARKERS)
    return meta


def m4a_metadata(data: bytes) -> AudioMetadata:
    head = data[:10_000]
    return AudioMetadata(format="m4a", is_ai_marked=has_any(head, GENERATED_MARKERS), encoder_name=encoder_of(head))


def describe(data: bytes, kind: str) -> tuple[AudioMetadata, AudioStats]:
    if kind == "wav":
        return wav_metadata(data)
    read = {"mp3": mp3_metadata, "flac": flac_metadata, "ogg": ogg_metadata, "m4a": m4a_metadata}.get(kind)
    return (read(data) if read else AudioMetadata(format=kind)), AudioStats(file_size=len(data))


def metadata_score(meta: AudioMetadata) -> float:
    score = 0.5
    score += 0.35 if meta.is_ai_marked else 0.0
    score -= 0.2 if meta.has_recording else 0.0
    score -= 0.1 if meta.has_id3 else 0.0
    score += 0.3 if any(tool in meta.encoder_name.lower() for tool in GENERATOR_TOOLS) else 0.0
    return bs.clamp(score)


def format_score(meta: AudioMetadata) -> float:
    score = 0.5
    score += 0.1 if meta.sample_rate > 0 and meta.sample_rate not in STANDARD_RATES else 0.0
    score += 0.1 if meta.sample_rate >= 96_000 and meta.bit_depth >= 24 else 0.0
    score += 0.1 if meta.channels == 1 else 0.0
    return score


def mp3_frames(data: bytes, most: int = 500) -> list[dict]:
    """MPEG-1 layer III frames; each is skipped over, so only real frames count while they follow one another."""
    out: list[dict] = []
    resume = 0
    for at in _sync_places(data).tolist():
        if at < resume:
            continue
        header = int.from_bytes(data[at : at + 4], "big")
        rate, bitrate = SAMPLE_RATES[header >> 10 & 3], BITRATES[header >> 12 & 15]
        if header >> 19 & 3 != 3 or header >> 17 & 3 != 1 or not rate or not bitrate:
            continue
        padding = header >> 9 & 1
        size = 144 * bitrate * 1000 // rate + padding
        out.append({"offset": at, "bitrate": bitrate, "sample_rate": rate, "padding": bool(padding), "channel_mode": header >> 6 & 3, "frame_size": size})
        if len(out) == most:
            break
        resume = at + (size if size > 0 and at + size < len(data) else 1)
    return out


def mp3_pattern_score(frames: list[dict]) -> float:
    if len(frames) < 10:
        return 0.5
    column = lambda name: np.array([f[name] for f in frames], dtype=float)
    spread, padded, sizes = bs.variation(column("bitrate")) ** 2, column("padding").mean(), column("frame_size")
    mono = (column("channel_mode") == 3).mean() * 0.1
    score = 0.5
    score += 0.1 if spread < 0.01 else -0.1 if spread > 0.3 else 0.0
    score += 0.05 if padded < 0.01 or padded > 0.99 else -0.05 if 0.3 < padded < 0.7 else 0.0
    score += 0.1 if (sizes[1:] == sizes[:-1]).mean() > 0.99 else 0.0
    score += 0.1 if mono > 0.3 else -0.05 if mono < 0.05 else 0.0
    return bs.clamp(score)


def _int16(data: bytes, most: int | None = None) -> np.ndarray:
    n = len(data) // 2 if most is None else min(len(data) // 2, most)
    return np.frombuffer(data, dtype="<i2", count=n).astype(np.int64)


def dc_offset(data: bytes) -> float:
    return float(_int16(data, 10_000).mean()) / 32768 if len(data) >= 100 else 0.0


def clipping_ratio(data: bytes) -> float:
    return float(np.isin(_int16(data, 10_000), (32767, -32768)).mean()) if len(data) >= 100 else 0.0


def crossing_variance(data: bytes) -> float:
    """Variance of the zero-crossing rate over up to 20 segments of 250 samples."""
    n = min(20, -(-(len(data) - 500) // 500)) if len(data) >= 2000 else 0
    if n < 2:
        return 0.5
    return float(np.var([crossings(_int16(data[i * 500 : i * 500 + 500])) / 250 for i in range(n)]))


def wav_pattern_score(data: bytes) -> float:
    at = data.find(b"data", 12, min(len(data) - 8, 1000) + 3)
    samples = data[at + 8 :] if at >= 0 else data[44:]
    if len(samples) < 1000:
        return 0.5
    score = 0.5
    score += 0.05 if abs(dc_offset(samples)) < 0.001 else 0.0
    score -= 0.1 if clipping_ratio(samples) > 0.01 else 0.0
    score += 0.05 if crossing_variance(samples) < 0.1 else 0.0
    return bs.clamp(score)


def flac_pattern_score(data: bytes) -> float:
    x = bs.as_bytes(data)[42:]
    found = min(500, int(((x[:-2] == 0xFF) & (x[1:-1] & 0xFC == 0xF8)).sum()))
    return 0.55 if 0 < found < len(data) // 4000 // 4 else 0.5


def repeated_chunks(data: bytes) -> float:
    """0.15 if over a tenth of the pairs of 256-byte chunks at most nine apart are equal; looks at about 50 pairs."""
    if len(data) < 2000:
        return 0.0
    pairs = equal = 0
    for i in range(0, len(data) - 512, 256):
        if pairs >= 50:
            break
        later = [data[j : j + 256] for j in range(i + 256, min(len(data) - 256, i + 2560), 256)]
        pairs += len(later)
        equal += later.count(data[i : i + 256])
    return 0.15 if pairs and equal / pairs > 0.1 else 0.0


def generic_pattern_score(data: bytes) -> float:
    quarter = len(data) // 4
    even = abs(bs.relative_entropy(data[:500]) - bs.relative_entropy(data[quarter : quarter + 2000])) < 0.5
    return bs.clamp(0.5 + (0.1 if even else 0.0) + repeated_chunks(data[quarter:]))


def pattern_score(data: bytes, kind: str) -> float:
    if len(data) < 5000:
        return 0.5
    if kind == "mp3":
        return mp3_pattern_score(mp3_frames(data))
    return {"wav": wav_pattern_score, "flac": flac_pattern_score}.get(kind, generic_pattern_score)(data)


def quality_score(meta: AudioMetadata, stats: AudioStats) -> float:
    score = 0.5
    score += 0.1 if 0 < meta.bitrate < 64 else 0.0
    score += 0.1 if meta.bitrate > 320 else 0.0
    score += 0.2 if 0 < stats.file_size < 10_000 else 0.0
    return score


def signature_score(data: bytes, meta: AudioMetadata) -> float:
    return min(1.0, (0.3 if has_any(data[:50_000], SIGNATURES) else 0.0) + (0.4 if meta.is_ai_marked else 0.0))


def noise_score(data: bytes) -> float:
    if len(data) < 10_000:
        return 0.5
    start = len(data) // 3
    windows = bs.as_bytes(data[start : start + 5000])
    rows = windows[: len(windows) // 100 * 100].reshape(-1, 100)
    n = -(-(len(windows) - 200) // 100)  # pairs of neighbours that begin 200 bytes or more before the end
    alike = (rows[:-1] == rows[1:]).mean(axis=1)[: max(0, n)] > 0.9
    return 0.7 if int(alike.sum()) > 5 else 0.4


def analyze_audio(data: bytes) -> dict:
    kind = audio_format(data)
    meta, stats = describe(data, kind)
    signals = {
        "metadata": metadata_score(meta), "format": format_score(meta), "pattern": pattern_score(data, kind), "quality": quality_score(meta, stats),
        "signatures": signature_score(data, meta), "noise": noise_score(data),
    }
    return {"ai_score": bs.weighted_mean(signals.values(), WEIGHTS.values()), "signals": signals, "metadata": asdict(meta), "stats": asdict(stats)}


# --- spectra: operators of their own, which the score doesn't use -----------------------------


def hann(n: int) -> np.ndarray:
    return np.hanning(n)


def magnitudes(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of the lower half of the spectrum of windowed samples."""
    return np.abs(np.fft.fft(samples * hann(len(samples)))[: len(samples) // 2])


def fft_size(n: int) -> int:
    """4096, or for fewer samples the largest power of two strictly below their number."""
    return 4096 if n >= 4096 else 1 << max(0, (n - 1).bit_length() - 1)


def harmonic_ratio(m: np.ndarray, resolution: float) -> float:
    low, high = int(80 / resolution), int(400 / resolution)
    if len(m) < 50 or high >= len(m):
        return 0.0
    base = low + int(np.argmax(m[low : high + 1]))
    energy = float((m**2).sum())
    if not m[base] or not energy:
        return 0.0
    peaks = [m[max(0, base * h - 3) : base * h + 4].max() for h in range(2, 11) if base * h < len(m)]
    return float(m[base] ** 2 + sum(p * p for p in peaks)) / energy


def formants(m: np.ndarray, resolution: float) -> list[float]:
    """Up to five peaks between 200 and 4000 Hz that stand out, six bins apart at least."""
    low, high = int(200 / resolution), min(int(4000 / resolution), len(m) - 1)
    if len(m) < 100 or low >= len(m):
        return []
    level = m[low : high + 1].mean() * 1.5
    out: list[float] = []
    resume = low + 2
    for i in range(low + 2, high - 2):
        if i >= resume and m[i] > max(m[i - 2], m[i - 1], m[i + 1], m[i + 2]) and m[i] > level:
            out.append(i * resolution)
            resume = i + 6
            if len(out) == 5:
                break
    return out


def spectral_flux(samples: np.ndarray, size: int) -> float:
    frames = min(50, (len(samples) - size) // (size // 2))
    if len(samples) < 2 * size or frames < 2:
        return 0.0
    spectra = np.stack([magnitudes(samples[f * (size // 2) : f * (size // 2) + size]) for f in range(frames)])
    rises = np.maximum(np.diff(spectra, axis=0), 0)
    return float(np.sqrt((rises**2).sum(axis=1)).sum() / (frames - 1))


def spectrum(samples: np.ndarray, sample_rate: int) -> dict | None:
    """Centroid, flatness, rolloff, bandwidth, harmonic ratio, formants and flux; None for too few samples."""
    size = fft_size(len(samples))
    if len(samples) < 512 or not sample_rate or size < 256:
        return None
    m, step = magnitudes(samples[:size]), sample_rate / size
    at, total, energy = np.arange(len(m)) * step, float(m.sum()), np.cumsum(m**2)
    centroid = float((at * m).sum() / total) if total else 0.0
    floor = np.maximum(m, 1e-10)
    return {
        "centroid": centroid,
        "flatness": float(np.exp(np.log(floor).mean()) / floor.mean()),
        "rolloff": float(at[min(len(m) - 1, int(np.searchsorted(energy, energy[-1] * 0.85)))]) if energy[-1] else 0.0,
        "bandwidth": float(np.sqrt(((at - centroid) ** 2 * m).sum() / total)) if centroid else 0.0,
        "harmonic_ratio": harmonic_ratio(m, step),
        "formants": formants(m, step),
        "flux": spectral_flux(samples, size),
    }


def hz_to_mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def mel_to_hz(mel):
    return 700 * (10 ** (np.asarray(mel) / 2595) - 1)


@dataclass(frozen=True)
class MfccConfig:
    frame_size: int
    frame_stride: int
    n_coefficients: int = 13
    n_filters: int = 26
    pre_emphasis: float = 0.97
    low: float = 0.0
    high: float = 0.0  # 0: half the sample rate

    @staticmethod
    def default(sample_rate: int) -> MfccConfig:
        """Frames of 25 ms, rounded up to a power of two, every 10 ms."""
        return MfccConfig(1 << max(0, (sample_rate * 25 // 1000 - 1).bit_length()), sample_rate * 10 // 1000)


def mel_filterbank(config: MfccConfig, sample_rate: int) -> np.ndarray:
    """Triangles between whole bins, one row per filter."""
    bins = config.frame_size // 2
    ends = hz_to_mel([config.low, config.high or sample_rate / 2])
    points = np.minimum((mel_to_hz(np.linspace(*ends, config.n_filters + 2)) / (sample_rate / config.frame_size)).astype(int), bins - 1)
    left, middle, right = points[:-2, None], points[1:-1, None], points[2:, None]
    b = np.arange(bins)[None]
    rising = np.where((b >= left) & (b < middle), (b - left) / np.maximum(1, middle - left), 0.0)
    return np.where((b >= middle) & (b < right), (right - b) / np.maximum(1, right - middle), rising)


def dct_matrix(n: int, n_out: int) -> np.ndarray:
    k, i = np.arange(n_out)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def deltas(frames: np.ndarray) -> np.ndarray:
    """Regression over two frames on either side, with the ends repeated."""
    if len(frames) < 3:
        return np.empty((0, frames.shape[1] if frames.ndim == 2 else 0))
    padded = np.pad(frames, ((2, 2), (0, 0)), mode="edge")
    n = len(frames)
    return ((padded[3 : 3 + n] - padded[1 : 1 + n]) + 2 * (padded[4 : 4 + n] - padded[:n])) / 10


def mfcc(samples: np.ndarray, sample_rate: int, config: MfccConfig | None = None) -> np.ndarray | None:
    """Cepstral coefficients, one row per frame (1000 at most); None for too few samples."""
    config = config or MfccConfig.default(sample_rate)
    size, stride = config.frame_size, config.frame_stride
    n = min(1000, (len(samples) - size) // stride) if sample_rate and len(samples) >= size else 0
    if n < 1:
        return None
    emphasized = np.concatenate((samples[:1], samples[1:] - config.pre_emphasis * samples[:-1]))
    frames = emphasized[np.arange(n)[:, None] * stride + np.arange(size)] * hann(size)
    power = np.abs(np.fft.fft(frames, axis=1)[:, : size // 2]) ** 2
    energies = np.log(np.maximum(power @ mel_filterbank(config, sample_rate).T, 1e-10))
    return energies @ dct_matrix(config.n_filters, config.n_coefficients).T


def moments(frames: np.ndarray) -> dict[str, np.ndarray]:
    """Population mean, variance, skewness and excess kurtosis by column; 0 where nothing varies."""
    off = frames - frames.mean(axis=0)
    variance = (off**2).mean(axis=0)
    safe = np.where(variance > 0, variance, 1.0)
    some = variance > 0
    return {"mean": frames.mean(axis=0), "variance": variance, "skewness": np.where(some, (off**3).mean(axis=0) / safe**1.5, 0.0), "kurtosis": np.where(some, (off**4).mean(axis=0) / safe**2 - 3, 0.0)}


def mfcc_score(frames: np.ndarray | None) -> float:
    if frames is None or not len(frames):
        return 0.5
    stats, score, few = moments(frames), 0.5, slice(1, 6)
    spread = stats["variance"][few].mean()
    score += 0.1 if spread < 10 else -0.1 if spread > 50 else 0.0
    moving = deltas(frames)
    score += 0.1 if len(moving) and moving[:, few].var(axis=0).mean() < 1 else 0.0
    score += 0.05 if np.abs(stats["kurtosis"][few]).mean() < 0.5 else 0.0
    return bs.clamp(score)


def analyze_sound(data: bytes) -> dict:
    """Spectrum and MFCC score of a PCM WAV file; nulls for anything else."""
    meta, _ = wav_metadata(data) if audio_format(data) == "wav" else (AudioMetadata(), None)
    body = next((data[at : at + size] for name, at, size in reversed(wav_chunks(data)) if name == b"data"), b"") if meta.encoder_name == "PCM" else b""
    samples = pcm_samples(body, meta.bit_depth)
    frames = mfcc(samples, meta.sample_rate) if len(samples) else None
    return {"spectrum": spectrum(samples, meta.sample_rate) if len(samples) else None, "mfcc_mean": None if frames is None else moments(frames)["mean"].tolist(), "mfcc_score": mfcc_score(frames)}


RESULT = T.StructType(
    [
        T.StructField("ai_score", T.DoubleType()),
        T.StructField("signals", T.StructType([T.StructField(n, T.DoubleType()) for n in WEIGHTS])),
        T.StructField("metadata", struct_of(AudioMetadata)),
        T.StructField("stats", struct_of(AudioStats)),
        T.StructField("error", T.StringType()),
    ]
)
_SPECTRUM = T.StructType([*[T.StructField(n, T.DoubleType()) for n in ("centroid", "flatness", "rolloff", "bandwidth", "harmonic_ratio")], T.StructField("formants", T.ArrayType(T.DoubleType())), T.StructField("flux", T.DoubleType())])
SOUND = T.StructType([T.StructField("spectrum", _SPECTRUM), T.StructField("mfcc_mean", T.ArrayType(T.DoubleType())), T.StructField("mfcc_score", T.DoubleType()), T.StructField("error", T.StringType())])
FRAME = T.StructType([T.StructField("offset", T.LongType()), T.StructField("bitrate", T.LongType()), T.StructField("sample_rate", T.LongType()), T.StructField("padding", T.BooleanType()), T.StructField("channel_mode", T.LongType()), T.StructField("frame_size", T.LongType())])


def analyze_audios(items: DataFrame, content: str = "content") -> DataFrame:
    """items with column audio: score, signals, metadata, stats, or an error."""
    return analyze_binary(items, content, "audio", analyze_audio, RESULT)


def analyze_sounds(items: DataFrame, content: str = "content") -> DataFrame:
    """items with column sound: spectrum and cepstral score of PCM audio."""
    return analyze_binary(items, content, "sound", analyze_sound, SOUND)


def frames_of(items: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """One row per MP3 frame."""
    return explode_binary(items, content, mp3_frames, FRAME, keep)
