"""Ranks and positions by range partitions: strings, groups of unlike scale, one value repeated, null groups."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from plumbline.operators import clusters, metrics, ranks, sampling, splits
from scipy_free import spearman


def test_running_over_unlike_groups_and_strings(spark):
    rnd = random.Random(31)
    rows = [(f"g{g}" if g else None, 10.0 ** (g - 5) * rnd.randrange(-40, 40)) for g in range(10) for _ in range(60)] + [("g3", 7.0)] * 500
    df = spark.createDataFrame(rows, "g string, v double")
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for value in ("v", "s"):
        frame = counted.withColumn("s", F.format_string("%020.10f", F.col("v") + 10_000_000))
        got = ranks.running(frame, ["g"], value, {"below": "n"}, 5, {"all": "below"}).collect()
        assert len(got) == frame.count()
        for r in got:
            mine = [v for g, v in rows if g == r["g"]]
            assert (r["below"], r["all"]) == (sum(v < r["v"] for v in mine), len(mine))
    assert ranks.running(counted.limit(0), ["g"], "v", {"below": "n"}).count() == 0


def test_positions_split_ties(spark):
    """One value repeated in one group: numbered without a gap, and no partition holds most of it."""
    df = spark.range(20_000).select(F.lit("x").alias("g"), F.lit(1).alias("v"), "id").unionByName(spark.range(5).select(F.lit(None).cast("string").alias("g"), F.lit(2).alias("v"), "id"))
    rows = ranks.positions(df, ["g"], [F.col("v")], parts=8)
    got = rows.where("g = 'x'").select("at").toPandas()["at"].sort_values().tolist()
    assert got == list(range(1, 20_001)) and {r["of"] for r in rows.where("g is null").collect()} == {5}
    held = ranks.ranged(df.withColumn("_row", F.monotonically_increasing_id()), ["g", "v", "_row"], 8).groupBy("_part").count().collect()
    assert max(r["count"] for r in held) < 2 * 20_005 / 8 and len(held) == 8


def test_numbering_of_string_clusters(spark):
    rnd = random.Random(32)
    members = [(f"m{i}", f"c{rnd.randrange(300)}") for i in range(900)]
    got = {r["component"]: (r["cluster_id"], r["n"]) for r in clusters.numbered(spark.createDataFrame(members, "item_id string, component string")).collect()}
    sizes = Counter(c for _, c in members)
    assert got == {c: (f"h{k:04d}", sizes[c]) for k, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}


@pytest.mark.parametrize("size", [1, 6, 7, 200])
def test_holdout_takes_the_newest(spark, size):
    """Most clusters without a date, and string components."""
    rows = [(f"c{i:03d}", "anchor", i if i % 5 == 0 and i else None) for i in range(size)] + [("x", "other", 10**9)]
    info = spark.createDataFrame(rows, "component string, brand string, date long")
    want = sorted((c for c, b, _ in rows if b == "anchor"), key=lambda c: ({r[0]: r[2] or 0 for r in rows}[c], c), reverse=True)[: max(1, 15 * size // 100)]
    assert sorted(r["component"] for r in splits.temporal_holdout(info, "anchor").collect()) == sorted(want)


def test_stride_over_strings(spark):
    rows = [("a", f"k{i:03d}") for i in range(100)] + [("b", "only")]
    got = sampling.stride_sample(spark.createDataFrame(rows, "g string, k string"), ["k"], 7, ["g"]).collect()
    assert sorted(r["k"] for r in got if r["g"] == "a") == [f"k{14 * i:03d}" for i in range(7)] and ("b", "only") in {tuple(r) for r in got}


def test_spearman_of_a_large_tied_group(spark):
    rnd = random.Random(33)
    rows = [("j", rnd.randrange(5), round(rnd.gauss(0, 1), 1)) for _ in range(3000)] + [("k", 1, float(i)) for i in range(4)] + [(None, 1, 2.0), (None, 2, 3.0), ("j", None, 1.0), ("j", 1, None)]
    got = {r["judge"]: (r["n"], r["rho"]) for r in metrics.spearman(spark.createDataFrame(rows, "judge string, x int, score double"), ["judge"], "x").collect()}
    whole = [(x, y) for j, x, y in rows if j == "j" and x is not None and y is not None]
    assert got["j"] == (3000, pytest.approx(spearman(whole))) and got["k"] == (4, 0.0) and got[None] == (2, pytest.approx(1.0))
