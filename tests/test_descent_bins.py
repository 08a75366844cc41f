"""A descent over many values takes its steps from binned moments."""

from __future__ import annotations

import random

import pytest

from plumbline.operators import calibrate


def test_bins_give_the_steps_of_all_values_without_a_job_a_step(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(j, x := rnd.uniform(-0.4, 0.9), int(rnd.random() < 0.2 + x / 2)) for j in ("u", "v", None) for _ in range(300)] + [("w", 0.25, 1)] * 3
    df = spark.createDataFrame(rows, "judge string, similarity double, label int")
    want = {r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=400).collect()}
    with monkeypatch.context() as held:
        held.setattr(calibrate, "_with_fits", lambda *_: pytest.fail("a job a step"))
        got = {r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=400, most_values=1).collect()}
    assert got.keys() == want.keys()
    for j, r in got.items():
        assert (r["a"], r["b"], r["steps"]) == pytest.approx((want[j]["a"], want[j]["b"], 400), abs=1e-10)
    monkeypatch.setattr(calibrate, "BINS", 1)  # too coarse: every step is a job
    few = {r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=2, most_values=1).collect()}
    assert few["u"]["a"] == pytest.approx({r["judge"]: r for r in calibrate.platt_descent_by(df, ["judge"], steps=2).collect()}["u"]["a"], abs=1e-10)
