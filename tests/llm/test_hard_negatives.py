"""Hard negatives against all pairs, and what the coordinate lists leave out."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list) -> list:
    fine = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in (r for r in fine if r[0] % 50 == 0):
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))
        ranked = sorted((-score(w), j, other) for j, other, w in fine)
        for s, j, _ in [r for r in ranked if r[2] == label and r[1] != i][:5]:
            good = [(n, k) for n, k, other in ranked if other != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(good)]
    return sorted(out)


def vectors(rnd: random.Random, n: int, spread: float) -> list:
    """Float32 values, as the column holds them."""
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        size = rnd.choice([0.02, 0.1, 0.5, 1.0])
        rows.append((i, [float(np.float32(size * (x + rnd.gauss(0, spread)))) for x in c], rnd.randrange(4)))
    return rows


@pytest.mark.parametrize("spread, bucket, block, focus", [(0.3, 1024, 256, 4), (0.3, 16, 3, 2), (2.0, 7, 2, 8), (0.0, 16, 4, 1)])
def test_against_all_pairs(spark, spread, bucket, block, focus):
    rnd = random.Random(12)
    rows = vectors(rnd, 520, spread)
    rows += [(600, [0.0] * 8, 1), (650, None, 1), (700, [1.0] * 7 + [float("nan")], 1), (750, [1.0] * 7 + [None], 2), (800, [1.0] * 8, None), (850, [0.5, 0.25], 3), (900, [-1.0] * 8, 9), (None, [1.0] * 8, 1), (951, rows[3][1], 2), (951, rows[3][1], 2), (950, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(f"clash {c}") for c in ("anchor", "slot", "v", "least")})
    made = hard_negatives.labelled(df)
    found = hard_negatives.mine(made, made.where("vec_id % 50 = 0"), focus=focus, bucket=bucket, block=block)
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    none = hard_negatives.labelled(df.limit(0))
    assert hard_negatives.mine(none, none).count() == 0


def test_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.75, 0.0], 2), (4, [0.75, 0.0], 3), (5, [0.75, 0.0], 2), (6, [0.75, 0.0], 2), (50, [0.0, 1.0], 5), (100, [0.0, 0.0], 5)]
    made = hard_negatives.labelled(spark.createDataFrame(rows, SCHEMA))
    found = hard_negatives.mine(made, made.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows) and found.count() >= 6


def test_lists_prune_and_lose_nothing():
    """Clustered directions: whole buckets go by length, most rows by their coordinates, and no pair that counts."""
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 32))
    which = rnd.integers(0, 20, 2000)
    ints = np.floor(256 * (centres[which] + 0.05 * rnd.normal(size=(2000, 32))) * np.where(np.arange(2000) < 1000, 1.0, 0.01)[:, None]).astype(np.int64)
    ids, labels = np.arange(2000), which % 5
    some = np.arange(0, 1000, 37)
    needs = (0.9 * (ints[some].astype(float) ** 2).sum(1)).astype(np.int64)[:, None]
    block = hard_negatives.Block(ids[some], labels[some], ints[some], needs, np.full_like(needs, 1 << 62), 3, True)
    for begin in (0, 500, 1000, 1500):
        cut = slice(begin, begin + 500)
        bucket = hard_negatives.Bucket(ids[cut], labels[cut], ints[cut])
        of, row = block.candidates(bucket)
        product = ints[some] @ ints[cut].T
        want = (product >= block.needs()[:, None]) & (labels[some][:, None] == labels[cut]) & (ids[some][:, None] != ids[cut])
        assert want[of, row].sum() == want.sum()
        assert len(of) < 0.2 * product.size
        block.meet(bucket)
    assert block.skipped >= 4 and block.listed < 0.75 * 2 * len(some) * 1000  # twice over two buckets


def test_feasible_ranges_hold_every_unit_vector():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        q, p = (x / np.linalg.norm(x) for x in rnd.normal(size=(2, 5)))
        for cosine in (q @ p, q @ p - 0.1, -1.0):
            low, high = hard_negatives.feasible(np.full(5, cosine), q)
            assert ((low <= p) & (p <= high)).all()
