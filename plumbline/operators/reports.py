"""The frames behind galleries, sheets, heat maps and curves; rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heatmap(cells: DataFrame, dimensions: list[str], severities: tuple = (1, 2, 3)) -> DataFrame:
    """Detection rates ``(judge, dimension, severity, det)`` as one row a judge and a column a cell."""
    wanted = [f"{d}/s{s}" for d in dimensions for s in severities]
    named = cells.withColumn("cell", F.concat("dimension", F.lit("/s"), F.col("severity").cast("string")))
    return named.groupBy("judge").pivot("cell", wanted).agg(F.first("det"))


def exemplars(scores: DataFrame, by: list[str], k: int = 6, worst: bool = False) -> DataFrame:
    """The k best (or worst) items of each group."""
    order = F.asc("score") if worst else F.desc("score")
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order, "item_id"))
    return scores.withColumn("rank", at).where(F.col("rank") <= k)


def gallery(attacked: DataFrame, others: dict[str, DataFrame], by: list[str], k: int = 6) -> DataFrame:
    """An attacked judge's best items with what other judges give them, null where they have no score."""
    rows = exemplars(attacked, by, k)
    for name, df in others.items():
        rows = rows.join(df.select("item_id", F.col("score").alias(name)), "item_id", "left")
    return rows


def contact_sheet(neighbours: DataFrame, items: DataFrame) -> DataFrame:
    """Neighbours with both sides' paths: ``items(item_id, path)``."""
    own = items.select(F.col("item_id").alias("query_id"), F.col("path").alias("query_path"))
    return neighbours.join(items.select("item_id", "path"), "item_id").join(own, "query_id")
