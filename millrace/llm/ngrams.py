"""Hashed n-grams of whole texts, by chunks, and a small logistic fit, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: n-grams of one size that are hashed at once; longer texts are taken in overlapping chunks.
CHUNK = 1 << 17


def code_points(text: str) -> np.ndarray:
    """The text's characters in lower case, as numbers."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def ngram_ids(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hashes, below ``2**bits``, of every run of n numbers for each n of the rising ``sizes``, in chunks; each run counts once."""
    most = max(sizes)
    for a in range(0, max(1, len(points)), CHUNK):
        part = points[a : a + CHUNK + most - 1].astype(np.uint64)
        found, h = [], np.zeros(len(part) + 1, np.uint64)
        for n in range(1, most + 1):
            if len(part) < n:
                break
            # A run's hash follows from that of the run one shorter.
            h = h[: len(part) - n + 1] * _STEP + part[n - 1 :]
            if n in sizes:
                x = h[:CHUNK] + np.uint64(n)
                x = x * _ODD
                x ^= x >> np.uint64(29)
                found.append(((x * _ODD) >> np.uint64(64 - bits)).astype(np.int64))
        yield np.concatenate(found) if found else np.zeros(0, np.int64)


def ngram_counts(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a text and how often each occurs."""
    parts = [np.unique(x, return_counts=True) for x in ngram_ids(points, sizes, bits)]
    if len(parts) == 1:
        return parts[0]
    ids, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return ids, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def logistic(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int, l2: float, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of sparse rows, by full-batch gradient steps with adaptive rates (Adam).

    ``target`` may be soft (0 to 1); ``weight`` scales each row's loss.
    """
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    index = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    value = np.concatenate(values) if len(rows) else np.zeros(0)
    owner = np.repeat(np.arange(len(rows)), sizes)
    total = weight.sum()
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[index] * value, len(rows)) + b
        error = weight * (sigmoid(z) - target) / total
        grad = np.append(np.bincount(index, error[owner] * value, width) + l2 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
