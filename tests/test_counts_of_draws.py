"""Permutations and bootstrap replicates are as many as the operators' defaults."""

from __future__ import annotations

from plumbline.operators import pressure
from plumbline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_five_permutations(spark):
    assert catalogue.QUERIES["permutation_floor"](spark, FOLDER).count() == 5


def test_interval_takes_the_default_replicates(spark, monkeypatch):
    real, asked = pressure.paired_delta, []
    monkeypatch.setattr(pressure, "paired_delta", lambda *a, **k: asked.append(k) or real(*a, **k))
    catalogue.QUERIES["paired_slot_interval"](spark, FOLDER)
    assert asked and asked[0].get("reps", 1000) >= 1000
