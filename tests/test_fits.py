"""Grouped and stacked fits against single ones, and seeded curves against the closed form."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibrate, pressure, probes, stacked


def rows_of(rnd, judges, n):
    return [(j, x, int(rnd.random() < 1 / (1 + np.exp(-(s * x - 1))))) for k, j in enumerate(judges) for s in [k + 1.0] for x in (round(rnd.gauss(0, 1), 2) for _ in range(n))]


def test_grouped_platt_equals_single_fits(spark):
    rows = rows_of(random.Random(41), ["a", "b", None], 150) + [("a", None, 1), ("b", 0.5, None)]
    df = spark.createDataFrame(rows, "judge string, similarity double, label int").repartition(3)
    newton = {r["judge"]: r for r in calibrate.platt_newton_by(df, ["judge"]).collect()}
    descent = {r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=50).collect()}
    by_job = {r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=5, most_values=1).collect()}
    few = {r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=5).collect()}
    assert newton.keys() == descent.keys() == {"a", "b", None}
    for j in newton:
        own = df.where(F.col("judge").eqNullSafe(F.lit(j)))
        assert calibrate.platt_newton(own) == pytest.approx((newton[j]["a"], newton[j]["b"]), abs=1e-9)
        assert calibrate.platt_descent(own, steps=50) == pytest.approx((descent[j]["a"], descent[j]["b"]), abs=1e-9)
        assert (by_job[j]["a"], by_job[j]["b"]) == pytest.approx((few[j]["a"], few[j]["b"]), abs=1e-9)
    assert len({r["steps"] for r in newton.values()}) >= 1 and max(r["steps"] for r in newton.values()) < 20
    assert calibrate.platt_newton_by(df.limit(0), ["judge"]).count() == 0 and calibrate.platt_newton(df.limit(0)) == (0.0, 0.0)


def test_stacked_equals_single_fits(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(300, 5))
    labels = [(x @ rng.normal(size=5) + rng.normal(size=300) > 0).astype(float) for _ in range(3)]
    weights = rng.uniform(0.5, 2, size=(300, 3))
    rows = [(x[i].tolist(), [float(y[i]) if (k, i % 7) != (1, 0) else None for k, y in enumerate(labels)], weights[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "features array<double>, labels array<double>, weights array<double>").repartition(3)
    found = stacked.fit(df, [0.01, 0.1, 0.01])
    for k, penalty in enumerate((0.01, 0.1, 0.01)):
        one = df.select("features", F.get("labels", F.lit(k)).alias("label"), F.get("weights", F.lit(k)).alias("w")).where("label is not null")
        w, b = calibrate.logistic(one, "features", penalty=penalty, weight="w")
        assert found[k] == pytest.approx([*w, b], abs=1e-6)
    evaluate = stacked.Evaluator(df, [0.0] * 3)
    stacked.Evaluator.__call__(evaluate, np.zeros((3, 6)))
    assert evaluate.jobs == 1  # all three models
    scores = stacked.scored(df, found).collect()
    assert all(len(r["scores"]) == 3 and 0 < min(r["scores"]) and max(r["scores"]) < 1 for r in scores)


def test_permutations_deal_the_same_labels(spark):
    rows = [(i, [float(i % 5)], i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "item_id long, vec array<double>, hit boolean").withColumn("label", F.col("hit").cast("int"))
    dealt = probes.permuted_labels(df, "item_id", [1, 2, 9]).collect()
    assert len(dealt) == 200
    columns = list(zip(*(r["labels"] for r in dealt), strict=True))
    assert [sum(c) for c in columns] == [67] * 3 and len(set(columns)) == 3
    again = {r["item_id"]: r["labels"] for r in probes.permuted_labels(df.repartition(5), "item_id", [1, 2, 9]).collect()}
    assert again == {r["item_id"]: r["labels"] for r in dealt}


def test_seeded_curves_lie_about_the_closed_form(spark):
    rnd = random.Random(43)
    pool = [(s, p, f"{s}{p}i{i}", round(rnd.random(), 1), rnd.gauss(0, 1)) for s in ("a", "b") for p in range(6) for i in range(70 if p < 5 else 3)]
    df = spark.createDataFrame(pool, "selector string, prompt_idx long, item_id string, score double, gold double")
    exact = {(r["selector"], r["arm"], r["n"]): r for r in pressure.bon_curves(df).collect()}
    drawn = {(r["selector"], r["arm"], r["n"]): r for r in pressure.bon_bootstrap(df, 200).collect()}
    assert exact.keys() == drawn.keys() and ("a", "deep", 64) in drawn and ("a", "broad", 2) in drawn
    for key, r in drawn.items():
        want = exact[key]
        assert r["prompts"] == want["prompts"]
        for name in ("proxy", "gold"):
            assert abs(r[name] - want[name]) < 5 * want[f"{name}_sd"] / 200**0.5 + 1e-9, (key, name)
    assert pressure.bon_bootstrap(df.limit(0)).count() == 0
