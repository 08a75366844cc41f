"""Audits: can the source be read from the features, and do neighbours leak?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import stacked
from plumbline.operators.calibrate import balanced_weight
from plumbline.operators.metrics import auc
from plumbline.operators.ranks import positions
from plumbline.staging import staged


def balanced_accuracy(scored: DataFrame, by: list[str] | None = None, label: str = "label", cut: float = 0.5) -> DataFrame:
    hit = ((F.col("score") > cut).cast("int") == F.col(label)).cast("double")
    sides = [F.avg(F.when(F.col(label) == side, hit)) for side in (0, 1)]
    return scored.groupBy(*(by or [])).agg(((sides[0] + sides[1]) / 2).alias("balanced_accuracy"))


def permuted_labels(df: DataFrame, item: str, seeds: list[int]) -> DataFrame:
    """``(item, labels)``: the labels dealt anew, once for each seed: the k-th item takes that of the k-th item in a seeded order.

    Items are numbered under all seeds at once, over range partitions.
    """
    every = df.select(item, "label", F.explode(F.array(*(F.lit(s) for s in (0, *seeds)))).alias("seed"))
    order = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(item).cast("string")).cast("binary"))
    ranked = staged(positions(every.withColumn("o", order), ["seed"], [F.col("o"), F.col(item)], "k", "of").select("seed", "k", item, "label"), "dealt")
    plain = ranked.where("seed = 0").select("k", item)
    mixed = ranked.where("seed <> 0").select("k", "seed", "label")
    dealt = plain.join(mixed, "k").groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("seed", "label"))).alias("m"))  # an entry a seed
    return dealt.select(item, F.array(*(F.col("m")[F.lit(s)] for s in seeds)).alias("labels"))


def probes(train: DataFrame, test: DataFrame, item: str, seeds: list[int], features: str = "vec", c: float = 1.0) -> DataFrame:
    """Class-balanced logistic probes of the labels, each under a seed; seed 0 keeps the labels as they are.

    One row a seed, ``(permutation, n_train, n_test, balanced_accuracy, auc)`` on the test rows.  All
    probes are fitted together, in one job a step.
    """
    s = train.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = s["n"], s["p"] or 0
    mixed = [k for k in seeds if k]
    rows = train.select(item, F.col(features).alias("features"), "label")
    if mixed:
        dealt = permuted_labels(train, item, mixed)
        rows = rows.join(dealt, item)
        at = {k: F.get("labels", F.lit(i)) for i, k in enumerate(mixed)}
    else:
        at = {}
    labels = F.array(*((at[k] if k else F.col("label")).cast("double") for k in seeds))
    rows = rows.select("features", labels.alias("labels")).withColumn("weights", F.transform("labels", lambda y: balanced_weight(y, n, p)))
    points = stacked.fit(rows, [1.0 / (c * max(n, 1))] * len(seeds))
    found = stacked.scored(test.select("label", F.col(features).alias("features")), points).select("label", F.posexplode("scores").alias("place", "score"))
    names = F.array(*(F.lit(k) for k in seeds))
    found = staged(found.select("label", F.get(names, F.col("place")).alias("permutation"), "score"), "probed")
    area = auc(found, ["permutation"], F.col("label") == 1).withColumn("n_test", F.col("n_pos") + F.col("n_neg"))
    return balanced_accuracy(found, ["permutation"]).join(area, "permutation").select("permutation", F.lit(n).alias("n_train"), "n_test", "balanced_accuracy", "auc")


def source_probe(train: DataFrame, test: DataFrame, features: str = "vec", c: float = 1.0) -> DataFrame:
    """Class-balanced logistic probe: one row ``(n_train, n_test, balanced_accuracy, auc)`` on the test rows."""
    return probes(train, test, "item_id", [0], features, c).drop("permutation")


def permutation_floor(train: DataFrame, test: DataFrame, item: str, times: int = 5, features: str = "vec") -> DataFrame:
    """Balanced accuracy of probes trained on permuted labels, one row a permutation."""
    return probes(train, test, item, list(range(1, times + 1)), features).select("permutation", "balanced_accuracy")


def twin_leak(neighbours: DataFrame, threshold: float) -> DataFrame:
    """Share of queries whose nearest neighbour is at or above ``threshold``."""
    first = neighbours.where("rank = 1")
    return first.agg(F.count("*").alias("n"), F.avg((F.col("similarity") >= threshold).cast("double")).alias("leak_rate"))


def same_label_rate(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of nearest neighbours with the query's label; ``labels(item_id, label)``."""
    nearest = staged(neighbours.where("rank = 1"), "nearest")  # so that no join waits for the search
    first = nearest.join(labels, "item_id").withColumnRenamed("label", "theirs")
    own = labels.select(F.col("item_id").alias("query_id"), F.col("label").alias("mine"))
    return first.join(own, "query_id").agg(F.count("*").alias("n"), F.avg((F.col("mine") == F.col("theirs")).cast("double")).alias("same_label"))
