"""Many phrases at once against plain containment; first rows of null keys and ties."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ingest, masks


@pytest.mark.parametrize("most", [1 << 18, 700])
def test_ten_thousand_phrases(spark, most):
    rnd = random.Random(51)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    phrases = sorted({word() + word() for _ in range(14_000)})[:10_000]
    texts = ["".join(word() for _ in range(rnd.randrange(1, 25))) for _ in range(60)] + ["", None, phrases[0], "zzz", phrases[5] * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "item_id long, flat string").repartition(3)
    lexicon = spark.createDataFrame([(p,) for p in [*phrases, phrases[0], None, ""]], "phrase string")
    found = {r["item_id"]: list(r["held"]) for r in masks.held_phrases(rows, "flat", lexicon, most=most).collect()}
    assert len(phrases) == 10_000 and found == {i: [p for p in phrases if p in (t or "")] for i, t in enumerate(texts)}
    assert masks.held_phrases(rows, "flat", lexicon.limit(0)).where(F.size("held") > 0).count() == 0
    assert masks.held_phrases(rows.limit(0), "flat", lexicon).count() == 0


def test_first_seen_keeps_null_keys_and_one_of_ties(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), (None, 5, "n"), (None, 4, "m"), ("b", None, "q"), ("b", None, "q"), ("c", 3, None)]
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(4)
    found = [tuple(r) for r in ingest.first_seen(df, F.col("k"), ["at"]).collect()]
    assert len(found) == 4 and {r[0] for r in found} == {"a", None, "b", "c"}
    assert (None, 4, "m") in found and ("b", None, "q") in found and ("c", 3, None) in found
    assert {tuple(r) for r in ingest.first_seen(df.repartition(2), F.col("k"), ["at"]).collect()} == set(found)
    assert ingest.first_seen(df.limit(0), F.col("k"), ["at"]).count() == 0
