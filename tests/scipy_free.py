"""Rank correlation by the definition."""

from __future__ import annotations


def spearman(pairs: list) -> float:
    def ranked(values: list) -> list:
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    a, b = (ranked([p[i] for p in pairs]) for i in (0, 1))
    m = (len(pairs) + 1) / 2
    cross = lambda p, q: sum((x - m) * (y - m) for x, y in zip(p, q, strict=True))
    return cross(a, b) / (cross(a, a) * cross(b, b)) ** 0.5
