"""Hashed byte n-gram features and the small linear models that are trained on them."""

from __future__ import annotations

import numpy as np

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_counts(text: str, bits: int) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased letters of a whole text (all else is a space)."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(1 << bits)
    h = b[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF)
    h += b[1:-1] * np.uint32(65599)
    h += b[2:]
    h *= np.uint32(2654435761)
    h >>= np.uint32(32 - bits)
    out = np.bincount(h, minlength=1 << bits).astype(np.float64)
    out[_SPACES[bits]] = 0  # a run of spaces says nothing
    return out


def _spaces(bits: int) -> int:
    h = (32 * (65599 * 65599 & 0xFFFFFFFF) + 32 * 65599 + 32) & 0xFFFFFFFF
    return (h * 2654435761 & 0xFFFFFFFF) >> (32 - bits)


_SPACES = {b: _spaces(b) for b in range(6, 21)}


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies: a vector of length one (or zero)."""
    n = counts.sum()
    return np.sqrt(counts / n) if n else counts


def _longest(x: np.ndarray) -> float:
    return max((float(np.einsum("ij,ij->i", p, p).max()) for k in range(0, len(x), 1024) if len(p := x[k : k + 1024])), default=0.0) + 1.0


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions, one for each column of y (0/1), by accelerated gradient descent with a bias."""
    t = x.T
    w = np.zeros((x.shape[1], y.shape[1]))
    b = np.zeros(y.shape[1])
    vw, vb, lw, lb = w.copy(), b.copy(), w, b
    total = weight.sum(axis=0)
    step = 1.0 / (0.25 * _longest(x) + l2)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ vw.astype(x.dtype) + vb, -40, 40)))
        g = (p - y) * weight / total
        w, b = vw - step * (t @ g.astype(x.dtype) + l2 * vw), vb - step * g.sum(axis=0)
        m = k / (k + 3)
        vw, vb, lw, lb = w + m * (w - lw), b + m * (b - lb), w, b
    return w, b


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, l2: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial regression with classes weighted evenly; y holds class numbers."""
    t = x.T
    hot = np.eye(k)[y]
    weight = (hot / np.maximum(hot.sum(axis=0), 1)).sum(axis=1, keepdims=True) / k
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    vw, vb, lw, lb = w.copy(), b.copy(), w, b
    step = 1.0 / (0.5 * _longest(x) + l2)
    for r in range(rounds):
        g = (softmax(x @ vw.astype(x.dtype) + vb) - hot) * weight
        w, b = vw - step * (t @ g.astype(x.dtype) + l2 * vw), vb - step * g.sum(axis=0)
        m = r / (r + 3)
        vw, vb, lw, lb = w + m * (w - lw), b + m * (b - lb), w, b
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def pack(counts: np.ndarray) -> bytes:
    """Places and counts of what is not zero."""
    at = np.flatnonzero(counts)
    return at.astype("<u4").tobytes() + counts[at].astype("<f4").tobytes()


def unpack(raw: bytes, row: np.ndarray) -> None:
    """Fill a row of zeros with the unit vector of packed counts."""
    n = len(raw) // 8
    c = np.frombuffer(raw, "<f4", n, 4 * n)
    row[np.frombuffer(raw, "<u4", n)] = np.sqrt(c / c.sum()) if n else 0
