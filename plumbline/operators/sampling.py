"""Deterministic samples, first-wins and last-wins removal of repeats, gates, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import sample_order
from plumbline.operators.ranks import positions


def seeded_sample(df: DataFrame, item: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``n`` rows in MD5 order of ``seed:item``, of each group or of all; a top-k of fixed size."""
    order = sample_order(seed, item)
    if not by:
        return df.orderBy(order, item).limit(n)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order, item))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def stride_sample(df: DataFrame, order: list[str], n: int, by: list[str]) -> DataFrame:
    """Every ``max(1, size // n)``-th row of each group, at most ``n``."""
    rows = positions(df, by, [F.col(c) for c in order], "_at", "_of")
    rows = rows.withColumn("_at", F.col("_at") - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_of") / n)))
    return rows.where((F.col("_at") % F.col("_step") == 0) & (F.col("_at") / F.col("_step") < n)).drop("_at", "_of", "_step")


def first_wins(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, key, [F.desc(c) for c in order])


def rungs_hold(ladder: DataFrame, base: list[str], passed: Column) -> DataFrame:
    """Rows of bases of which every rung passes: one failure rejects the base."""
    ok = F.bool_and(passed).over(Window.partitionBy(*base))
    return ladder.withColumn("_ok", ok).where("_ok").drop("_ok")


def shard_of(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(shards)).cast("int"))


def still_to_do(items: DataFrame, done: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Items without a result; with ``failed``, results that failed are tried again."""
    kept = done if failed is None else done.where(~failed)
    return items.join(kept.select(key).distinct(), key, "left_anti")
