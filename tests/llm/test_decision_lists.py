"""The learner of decision lists against exhaustive search, and its lists as Spark expressions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from plumbline.llm import quality


def gain(bad: list[bool], inside: list[bool], hit: list[bool]) -> float:
    """FOIL's gain of a term, counted row by row."""
    count = lambda rows: (sum(b for b, r in zip(bad, rows, strict=True) if r), quality.GOOD_WEIGHT * sum(not b for b, r in zip(bad, rows, strict=True) if r))
    p0, n0 = count(inside)
    p, n = count([a and b for a, b in zip(inside, hit, strict=True)])
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def holds(value: float, least: bool, at: float) -> bool:
    return value >= at if least else value <= at


@pytest.mark.parametrize("seed", range(6))
def test_each_term_has_the_best_gain(seed):
    rnd = random.Random(seed)
    n = 60
    x = {f: [round(rnd.random(), 1 + i) for _ in range(n)] for i, f in enumerate("abc")}  # ties in a
    bad = [x["a"][i] >= 0.4 and x["b"][i] <= 0.6 and rnd.random() < 0.9 for i in range(n)]
    terms = quality._grow({f: np.array(v) for f, v in x.items()}, np.array(bad))
    inside = [True] * n
    assert terms
    for f, least, at in terms:
        every = []
        for g, values in x.items():
            some = sorted({v for v, i in zip(values, inside, strict=True) if i})
            for low, high in zip(some, some[1:], strict=False):
                every += [gain(bad, inside, [holds(v, way, (low + high) / 2) for v in values]) for way in (False, True)]
        chosen = [holds(v, least, at) for v in x[f]]
        assert gain(bad, inside, chosen) == pytest.approx(max(every))
        inside = [a and b for a, b in zip(inside, chosen, strict=True)]
    assert len(terms) == quality.MOST_TERMS or all(b for b, i in zip(bad, inside, strict=True) if i)


def planted(n: int, seed: int = 0):
    """Rows that are bad where two thresholds hold together; either alone is good."""
    rng = np.random.default_rng(seed)
    x = {f: rng.random(n) for f in ("a", "b", "noise")}
    return x, (x["a"] > 0.6) & (x["b"] < 0.3), rng.random(n) < 1 / 3


def test_conjunctions_are_found():
    x, bad, held = planted(3000)
    rules = quality.learn(x, bad, held)
    assert any({(f, least) for f, least, _ in r.terms} >= {("a", True), ("b", False)} for r in rules)
    rejected = np.zeros(len(bad), bool)
    for r in rules:
        hit = r.holds(x) & ~rejected
        assert (r.covered, r.precision) == (int(hit.sum()), pytest.approx(bad[hit].mean()))  # statistics of the rows left to this rule
        assert r.precision >= quality.LEAST_PRECISION and r.covered >= quality.LEAST_COVER
        rejected |= hit
    assert rejected[bad].mean() > 0.9 and rejected[~bad].mean() < 0.01


def test_terms_that_held_rows_do_not_bear_out_are_pruned():
    x, bad, held = planted(3000, 1)
    bad = x["a"] > 0.6
    flip = ~held & (x["a"] > 0.6) & (x["noise"] > 0.98)  # wrong labels among growing rows alone, too few to miss the least precision
    grown = quality._grow({f: v[~held] for f, v in x.items()}, (bad & ~flip)[~held])
    assert "noise" in {f for f, _, _ in grown}
    first = quality.learn(x, bad & ~flip, held)[0]
    assert {f for f, _, _ in first.terms} == {"a"}


def test_nothing_bad_gives_no_rule():
    x, bad, held = planted(200)
    assert quality.learn(x, np.zeros_like(bad), held) == []
    assert quality.learn({f: np.ones(200) for f in x}, bad, held) == []  # no threshold lies between equal values


def test_lists_as_expressions_reject_what_they_hold(spark):
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        loud, shouting = rnd.random() < 0.5, rnd.random() < 0.5
        words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(40)]
        words = [w.upper() if shouting else w for w in words]
        words = [w + "#" if loud and rnd.random() < 0.6 else w for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not (loud and shouting))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rules = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert any(len(r.terms) > 1 for r in rules)
    rows, name, failed, kept = quality.judged(docs, rules)
    got = {r["doc_id"]: r["kept"] for r in rows.select("doc_id", kept.alias("kept")).collect()}
    of = quality.features(name)
    cells = rows.select("doc_id", failed.alias("failed"), *(c.alias(f) for f, c in of.items())).toPandas()
    x = {f: cells[f].to_numpy(float) for f in of}
    hit = np.any([r.holds(x) for r in rules], axis=0) | cells["failed"].to_numpy(bool)
    assert got == dict(zip(cells["doc_id"], (~hit).tolist(), strict=True))
    assert sum(got[i] == bool(q) for i, q in labels) > 880
