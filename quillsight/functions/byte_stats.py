"""Statistics of byte strings, in numpy; used inside Arrow batches only."""

from __future__ import annotations

import numpy as np


def as_bytes(data: bytes | np.ndarray) -> np.ndarray:
    return data if isinstance(data, np.ndarray) else np.frombuffer(data, dtype=np.uint8)


def histogram(data) -> np.ndarray:
    return np.bincount(as_bytes(data), minlength=256)


def entropy(data) -> float:
    """Bits per byte; 0 for no data."""
    counts = histogram(data)
    shares = counts[counts > 0] / max(1, counts.sum())
    return float(-(shares * np.log2(shares)).sum())


def relative_entropy(data) -> float:
    """Entropy over its maximum of 8 bits."""
    return entropy(data) / 8.0


def run_lengths(flags: np.ndarray) -> np.ndarray:
    """Lengths of the runs of true values."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edges == -1) - np.flatnonzero(edges == 1)


def zero_runs(data) -> dict[str, float]:
    runs = run_lengths(as_bytes(data) == 0)
    if not len(runs):
        return {"mean": 0.0, "longest": 0, "n": 0, "variance": 0.0}
    return {"mean": float(runs.mean()), "longest": int(runs.max()), "n": len(runs), "variance": float(runs.var())}


def similarity(a, b) -> float:
    """Share of equal bytes at equal places; 0 for different lengths or no data."""
    a, b = as_bytes(a), as_bytes(b)
    return float((a == b).mean()) if len(a) == len(b) and len(a) else 0.0


def periodicity(data, period: int) -> float:
    """1 less the mean squared difference of bytes a period apart, on a scale of 255 squared."""
    data = as_bytes(data).astype(np.int64)
    if len(data) < 4 * period:
        return 0.0
    return float(1.0 - ((data[:-period] - data[period:]) ** 2).mean() / 65025.0)


def variation(values) -> float:
    """Population standard deviation over mean; 0 where the mean is 0 or there is nothing."""
    values = np.asarray(values, dtype=float)
    mean = values.mean() if len(values) else 0.0
    return float(values.std() / mean) if mean else 0.0


def find_marker(data: bytes, *markers: bytes, end: int | None = None) -> int:
    """The first place before `end` where any of the markers stands, or -1."""
    places = [p for p in (data.find(m) for m in markers) if 0 <= p < (len(data) if end is None else end)]
    return min(places, default=-1)


def clamp(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return max(low, min(high, x))


def weighted_mean(values, weights) -> float:
    """Weighted mean in [0, 1], summed in order."""
    total = whole = 0.0
    for value, weight in zip(values, weights, strict=True):
        total += value * weight
        whole += weight
    return clamp(total / whole if whole > 0 else total)
