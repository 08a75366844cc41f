"""The metrics against their definitions, written out in Python over random and awkward pools."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import metrics, ranks

FEW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
#: Few values, so that ties are common; some outside the unit interval.
GRID = st.sampled_from([-0.25, 0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.95, 1.0, 1.25])
POOLS = "judge string, score double, label int, x double"


def pools(spark, rows):
    return spark.createDataFrame([("j", *r) for r in rows], POOLS)


@FEW
@given(st.lists(st.tuples(GRID, st.integers(0, 1), GRID), min_size=1, max_size=40))
def test_area_is_the_share_of_won_pairs(spark, rows):
    ups, downs = ([s for s, y, _ in rows if y == side] for side in (1, 0))
    found = metrics.auc(pools(spark, rows), ["judge"], "label = 1").first()
    won = [1 if u > d else 0.5 if u == d else 0 for u in ups for d in downs]
    assert (found["auc"] is None) if not won else found["auc"] == pytest.approx(sum(won) / len(won), abs=1e-12)
    assert (found["n_pos"], found["n_neg"]) == (len(ups), len(downs))


def test_area_does_not_see_the_scale(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice((0.2, 0.4, 0.9)) + rnd.random() // 0.5, rnd.randrange(2), 0.0) for _ in range(300)]
    areas = [metrics.auc(pools(spark, [(f(s), y, x) for s, y, x in rows]), ["judge"], "label = 1").first()["auc"] for f in (float, lambda s: 9 * s**3 - 4, lambda s: -s)]
    assert areas[0] == pytest.approx(areas[1], abs=1e-12) and areas[0] + areas[2] == pytest.approx(1, abs=1e-12)


def mid_ranks(values):
    return [sum(o < v for o in values) + (sum(o == v for o in values) + 1) / 2 for v in values]


@FEW
@given(st.lists(st.tuples(GRID, st.just(1), GRID), min_size=2, max_size=30))
def test_rank_correlation_is_that_of_the_ranks(spark, rows):
    a, b = mid_ranks([s for s, _, _ in rows]), mid_ranks([x for _, _, x in rows])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    cov, va, vb = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)), sum((p - ma) ** 2 for p in a), sum((q - mb) ** 2 for q in b)
    want = cov / (va * vb) ** 0.5 if va and vb else 0.0  # a constant side counts as no correlation
    assert metrics.spearman(pools(spark, rows), ["judge"], "x").first()["rho"] == pytest.approx(want, abs=1e-9)


EDGES = [k * 0.1 for k in range(11)]


def edge_bin(score):
    """The tenth a score lies in, by the double edges of an even grid; the last one is closed."""
    if not 0 <= score <= 1:
        return None
    return max(k for k in range(10) if score >= EDGES[k])


@FEW
@given(st.lists(st.tuples(GRID, st.integers(0, 1), GRID), min_size=1, max_size=40))
def test_calibration_error_sums_the_bins(spark, rows):
    error = 0.0
    for k in range(10):
        held = [(s, y) for s, y, _ in rows if edge_bin(s) == k]
        if held:
            error += len(held) / len(rows) * abs(sum(s for s, _ in held) / len(held) - sum(y for _, y in held) / len(held))
    assert metrics.ece(pools(spark, rows), ["judge"]).first()["ece"] == pytest.approx(error, abs=1e-9)


def test_bins_of_every_edge_and_its_neighbours(spark):
    import math

    points = [x for e in EDGES for x in (e, math.nextafter(e, -1), math.nextafter(e, 2))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(points)], "i int, s double")
    found = {r["i"]: r["b"] for r in df.select("i", metrics.ece_bin(F.col("s")).alias("b")).collect()}
    assert found == {i: edge_bin(s) for i, s in enumerate(points)}


@FEW
@given(st.lists(GRID, min_size=1, max_size=60), st.lists(GRID, min_size=1, max_size=30))
def test_detection_is_strict_below_the_threshold(spark, real, fakes):
    rows = [("j", "real", s) for s in real] + [("j", "fake", s) for s in fakes]
    df = spark.createDataFrame(rows, "judge string, instrument string, score double")
    cut = metrics.detection(df, ["judge"], "instrument = 'real'")
    row = cut.first()
    below = lambda pool: sum(s < row["threshold"] for s in pool) / len(pool)
    assert row["fpr_realized"] == pytest.approx(below(real)) and row["fpr_realized"] <= 0.05 + 1 / len(real)
    assert metrics.detection_rates(df, ["judge"], cut, "instrument = 'fake'", ["judge"]).first()["det"] == pytest.approx(below(fakes))


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0)], "g string, v double")
    assert ranks.percentile(df, ["g"], "v", 0.05).first()["percentile"] == pytest.approx(1.1)


def test_average_ranks_over_buckets(spark):
    rnd = random.Random(2)
    values = [round(rnd.gauss(0, 1), 1) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["rank"] for r in ranks.average_ranks(df.withColumn("g", F.lit(1)), ["g"], "v", buckets=7).collect()}
    for i, v in enumerate(values):
        below, same = sum(x < v for x in values), sum(x == v for x in values)
        assert got[i] == below + (same + 1) / 2


def test_no_groups_gives_no_summary(spark):
    empty = spark.createDataFrame([], "judge string, p int, x double, score double")
    assert metrics.spearman_summary(metrics.spearman(empty, ["judge", "p"], "x"), ["judge"]).count() == 0
