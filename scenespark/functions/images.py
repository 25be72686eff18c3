"""Image kernels in NumPy: grey values, sharpness, area resize, perceptual hash, colour histogram."""

from __future__ import annotations

import numpy as np


def decode(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """An image row's bytes as [height, width, 3] in blue, green, red order."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr.astype(np.float64) @ np.array([0.114, 0.587, 0.299]))


def sharpness(bgr: np.ndarray) -> float:
    """Population variance of the 3 x 3 Laplacian of the grey image, its border reflected."""
    g = np.pad(gray(bgr), 1, mode="reflect" if min(bgr.shape[:2]) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def area_weights(n: int, m: int) -> np.ndarray:
    """[m, n] shares by which m cells average n samples."""
    edge = np.linspace(0, n, m + 1)
    lo, hi = edge[:-1, None], edge[1:, None]
    k = np.arange(n)[None]
    share = np.clip(np.minimum(hi, k + 1) - np.maximum(lo, k), 0, None)
    return share / share.sum(1, keepdims=True)


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, cols = area_weights(x.shape[0], height), area_weights(x.shape[1], width)
    return np.einsum("ih,hw...,jw->ij...", rows, x.astype(np.float64), cols, optimize=True)


def resize_max_width(bgr: np.ndarray, most: int) -> np.ndarray:
    """Only ever shrinks."""
    h, w = bgr.shape[:2]
    return bgr if w <= most else np.rint(resize(bgr, max(1, int(h * (most / w))), most)).astype(np.uint8)


def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    c = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


DCT = dct_matrix(32)


def bits_of(low: np.ndarray) -> np.ndarray:
    """1 where a coefficient is above the median of all but the first."""
    return (low > np.median(low[1:])).astype(np.float32)


def phash(bgr: np.ndarray) -> np.ndarray:
    return bits_of((DCT @ np.rint(resize(gray(bgr), 32, 32)) @ DCT.T)[:8, :8].ravel())


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in half degrees, saturation and value up to 255."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(d == 0, 0, h % 360) / 2
    s = np.where(v == 0, 0, d / np.where(v == 0, 1, v)) * 255
    return np.stack([np.rint(h) % 180, np.rint(s), v], axis=-1)


def hsv_histogram(bgr: np.ndarray) -> np.ndarray:
    x = (hsv(bgr).reshape(-1, 3) // 8).astype(np.int64)
    return np.concatenate([np.bincount(x[:, k], minlength=32) / max(len(x), 1) for k in range(3)]).astype(np.float32)
