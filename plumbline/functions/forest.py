"""Connected components inside a task, on arrays of places."""

from __future__ import annotations

import numpy as np


def settled(top: np.ndarray) -> np.ndarray:
    """Each place's root, from parents that are never larger."""
    while not np.array_equal(above := top[top], top):
        top = above
    return top


def united(top: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots after the places in ``x`` were joined with those in ``y``."""
    while len(x):
        p, q = top[x], top[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        if len(x):
            np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
            top = settled(top)
    return top
