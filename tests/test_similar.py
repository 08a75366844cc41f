"""The similarity join against all pairs, and what its bounds skip."""

from __future__ import annotations

import random

import numpy as np
import pytest

from plumbline.functions.forest import united
from plumbline.operators import clusters, similar


def brute(rows: list, least: float) -> set:
    fine = [(i, b, v) for i, b, v in rows if i is not None and b is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return {(min(i, j), max(i, j)) for i, b, v in fine for j, c, w in fine if i != j and b == c and len(v) == len(w) and sum(x * y for x, y in zip(v, w, strict=True)) >= least}


def grouped(pairs: set, ids: list) -> dict:
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for u, v in pairs:
            low = min(least[u], least[v])
            changed |= least[u] != low or least[v] != low
            least[u] = least[v] = low
    return least


@pytest.mark.parametrize("kind, page, leaf", [("long", 4096, 128), ("string", 7, 3), ("long", 16, 4)])
def test_equals_all_pairs(spark, kind, page, leaf):
    rnd = random.Random(21)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    name = (lambda i: f"id{i:03d}") if kind == "string" else (lambda i: i)
    rows = []
    for i in range(150):
        c = rnd.choice(centres)
        v = np.array([x + rnd.gauss(0, 0.2) for x in c])
        rows.append((name(i), rnd.choice(["a", "a", "b"]), (v / np.linalg.norm(v) * rnd.choice([1.0, 1.0, 3.0])).tolist()))
    rows += [(name(200), "a", None), (name(201), None, [1.0] * 6), (name(202), "a", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (name(203), "a", [float("nan")] * 6), (name(204), "a", [1.0]), (name(205), "a", [1.0]), (name(206), "a", []), (name(207), "b", [0.0] * 6), (name(5), *rows[5][1:]), (name(208), *rows[5][1:]), (None, "a", [1.0] * 6)]
    items = spark.createDataFrame(rows, f"item_id {kind}, brand string, vec array<double>").repartition(3)
    for least in (0.95, 0.0) if page == 4096 else (0.5,):
        want = brute(rows, least)
        pairs = similar.similar_pairs(items, "brand", least, page, leaf).collect()
        assert {(r["u"], r["v"]) for r in pairs} == want
        links = similar.similar_links(items, "brand", least, page, leaf)
        assert {(min(r), max(r)) for r in links.collect()} <= {(u, v) for u in {r[0] for r in rows} - {None} for v in {r[0] for r in rows} - {None}}
        ids = [r[0] for r in rows if r[0] is not None]
        found = {r["item_id"]: r["component"] for r in clusters.clusters(items.where("item_id is not null"), links).collect()}
        assert found == grouped(want, ids)
    assert similar.similar_links(items.limit(0), "brand", 0.9).count() == 0


def test_pages_are_skipped_and_links_span():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 64, axis=0) + 0.01 * rng.normal(size=(1920, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pages = similar.Pages(x, None, 0.95, leaf=64)
    found = {(int(u), int(v)) for a, b, _ in pages.hits() for u, v in zip(a, b, strict=True)}
    product = x @ x.T
    assert found == {(int(u), int(v)) for u, v in np.argwhere(product >= 0.95) if u < v}
    assert pages.skipped > 0.8 * 30 * 31 / 2  # most leaves are far apart
    other = similar.Pages(x[:960], x[960:], 0.95, leaf=64)
    assert not list(other.hits()) or other.skipped > 0.5 * 225
    again = similar.Pages(x, None, 0.95, leaf=16)
    roots = again.roots()
    assert len(set(roots.tolist())) == len({int(r) for r in united(np.arange(1920), *np.array(sorted(found)).T)})
    assert again.met < similar.Pages(x, None, 0.95, leaf=16).met + 120 * 121 // 2


def test_a_limit_met_exactly(spark):
    rows = [(1, "a", [0.5, 0.5]), (2, "a", [1.0, 0.0]), (3, "a", [0.0, 0.9999999])]
    items = spark.createDataFrame(rows, "item_id long, brand string, vec array<float>")
    assert {(r["u"], r["v"]) for r in similar.similar_pairs(items, "brand", 0.5).collect()} == {(1, 2)}
