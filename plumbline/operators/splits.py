"""Leak-safe splits: whole clusters, a temporal holdout, then positional cuts of a seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import sample_order
from plumbline.operators.ranks import positions

SPLITS = ("train", "val", "test", "temporal_test")


def temporal_holdout(info: DataFrame, anchor: str, percent: int = 15) -> DataFrame:
    """The newest ``max(1, floor(percent of n))`` clusters of the anchor brand; a missing date is the oldest."""
    rows = info.where(F.col("brand") == anchor).select("component", F.coalesce("date", F.lit(0)).alias("date"))
    ranked = positions(rows, [], [F.desc("date"), F.desc("component")])
    keep = F.greatest(F.lit(1), F.floor(F.col("of") * percent / 100))
    return ranked.where(F.col("at") <= keep).select("component", F.lit("temporal_test").alias("split"))


def positional_splits(info: DataFrame, by: list[str], seed: int = 42, train: int = 60, train_and_val: int = 75) -> DataFrame:
    """60 / 15 / 25 of each pool in MD5 order, cut at whole positions."""
    rows = positions(info, by, [sample_order(seed, "component"), F.col("component")])
    cut = lambda p: F.floor(F.col("of") * p / 100)
    split = F.when(F.col("at") <= cut(train), "train").when(F.col("at") <= cut(train_and_val), "val").otherwise("test")
    return rows.select("component", split.alias("split"))


def cluster_splits(info: DataFrame, anchor: str, seed: int = 42) -> DataFrame:
    """``(component, split)`` for all clusters: holdout of the anchor first, pools by brand and source after."""
    held = temporal_holdout(info, anchor)
    rest = info.join(held.select("component"), "component", "left_anti")
    return positional_splits(rest, ["brand", "src"], seed).unionByName(held)


def image_index(members: DataFrame, splits: DataFrame) -> DataFrame:
    return members.join(splits, "component").select("item_id", "split")


def split_leaks(splits: DataFrame) -> DataFrame:
    """Clusters that stand in more than one split: must be empty."""
    return splits.groupBy("component").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def split_counts(info: DataFrame, splits: DataFrame) -> DataFrame:
    return info.join(splits, "component").groupBy("split", "brand").agg(F.count("*").alias("clusters"), F.sum("n").alias("items"))
