"""Exact neighbours in cells of bounded size."""

from __future__ import annotations

import numpy as np

from plumbline.operators import embedding, probes


def test_cells_give_what_one_matrix_gives(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SLICE", 3)
    rng = np.random.default_rng(3)
    made = rng.integers(-3, 4, (60, 5)).astype(float)  # whole numbers, so that scores tie
    made[40:50] = made[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    df = spark.createDataFrame([*rows, (60, None), (None, [1.0] * 5), (61, [float("nan")] * 5)], "item_id long, vec array<double>")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["similarity"]) for r in embedding.neighbours(df.where("item_id % 2 = 1 or item_id is null"), df, 4, 16).collect()}
    want = {}
    for i in range(1, 60, 2):
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-(made[i] @ made[j]), j))[:4]
        want |= {(i, k): (j, float(made[i] @ made[j])) for k, j in enumerate(best, 1)}
    assert got == want


def test_fewer_rows_than_asked_and_none(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "item_id int, vec array<float>")
    assert [tuple(r) for r in embedding.neighbours(df, df, 3).orderBy("query_id").collect()] == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]
    assert embedding.neighbours(df.limit(0), df, 3).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, 0)], "item_id int, label int")
    assert tuple(probes.same_label_rate(embedding.neighbours(df, df, 1), labels).first()) == (2, 1.0)
