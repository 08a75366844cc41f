"""Arithmetic of one image, a numpy array of shape (height, width, 3) with 8 bits a channel.

The loader of image files resizes with it, and ``operators.resample`` works out perturbations and hashes with it: an image is a
row there, and Spark plans what is done to each.  Measurements and regions of images are Spark expressions
(``operators.imaging``, ``operators.regions``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def _weights(n: int, m: int, reach: float = 3.0) -> np.ndarray:
    """(m, n) Lanczos weights, widened when shrinking."""
    scale = n / m
    wide = max(1.0, scale)
    centre = (np.arange(m) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0)
    return w / w.sum(1, keepdims=True)


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.einsum("yh,hwc->ywc", _weights(img.shape[0], height), img.astype(float))
    out = np.einsum("xw,ywc->yxc", _weights(img.shape[1], width), out)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def bounded(img: np.ndarray, most: int = 1024) -> np.ndarray:
    """The image, shrunk so that no side exceeds ``most``."""
    side = max(img.shape[:2])
    if side <= most:
        return img
    return resize(img, max(1, round(img.shape[0] * most / side)), max(1, round(img.shape[1] * most / side)))


@lru_cache(256)
def whole_weights(n: int, m: int) -> np.ndarray:
    """(m, n) Lanczos weights in 65536ths, as whole numbers in doubles."""
    scale = n / m
    wide = max(1.0, scale)
    x = (np.arange(n)[None, :] + 0.5 - (np.arange(m) + 0.5)[:, None] * scale) / wide
    v = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    w = v / v.sum(1, keepdims=True) * 65536
    return np.sign(w) * np.floor(np.abs(w) + 0.5)


def sampled(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, channels) of whole values (h, w, channels) below 2 ** 18, rounded once and 0 at least; all sums are whole and below 2 ** 53."""
    h, w, c = values.shape
    one = whole_weights(h, height) @ values.reshape(h, w * c).astype(float)
    two = np.einsum("xw,ywc->yxc", whole_weights(w, width), one.reshape(height, w, c), optimize=True)
    return np.maximum(two.astype(np.int64) + (1 << 31), 0) >> 32


def recoloured(img: np.ndarray, turn: int, percent: int) -> np.ndarray:
    """The image after the hue was turned by 256ths and the saturation taken times hundredths: HSV in whole numbers."""
    r, g, b = np.moveaxis(img.astype(np.int64), -1, 0)
    top, low = img.max(-1).astype(np.int64), img.min(-1).astype(np.int64)
    d = np.maximum(top - low, 1)
    lead = np.select([top == low, r == top, g == top], [0, g - b, b - r + 2 * d], r - g + 4 * d)
    h = (255 * (lead % (6 * d)) // (6 * d) + turn) % 256
    s = np.minimum(255 * (top - low) // np.maximum(top, 1) * percent // 100, 255)
    k, f = 6 * h // 255 % 6, 6 * h % 255
    half = lambda a, c: (2 * a + c) // (2 * c)
    p, q, t = half(top * (255 - s), 255), half(top * (65025 - s * f), 65025), half(top * (65025 - s * (255 - f)), 65025)
    return np.stack([np.choose(k, c) for c in ((top, q, p, p, t, top), (t, top, top, q, p, p), (p, p, t, top, top, q))], -1)


def badged(img: np.ndarray, badges: list[dict], colours: tuple, banner: bool) -> np.ndarray:
    """The image with toothed badges pasted one over the other, and a banner below."""
    out = img.copy()
    height, width = img.shape[:2]
    for e in badges:
        dy, dx = np.arange(height)[:, None] - e["cy"], np.arange(width)[None, :] - e["cx"]
        edge = e["radius"] * np.where(np.cos(12 * np.arctan2(dy, dx)) >= 0, 1.0, 0.7)
        out[np.sqrt(dy * dy + dx * dx) <= edge] = colours[e["hue"]]
    if banner:
        out[height - max(1, height // 8) :] = colours[0]
    return out
