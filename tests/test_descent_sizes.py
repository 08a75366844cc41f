"""Descent has no largest input, and its two ways agree."""

from __future__ import annotations

import pytest

from plumbline.operators import calibrate


def test_descent_in_spark(spark):
    rows = [(i / 40 % 1, int(i * 7 % 11 < 5)) for i in range(90)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "similarity double, label int")
    want = calibrate.platt_descent(df, steps=12)
    assert calibrate.platt_descent(df, steps=12, most_values=20) == pytest.approx(want, abs=1e-9)
