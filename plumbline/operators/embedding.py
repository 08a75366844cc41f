"""Embedding judges: centroids, directions, neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import platt
from plumbline.functions.vectors import dot, let, minus, normalised, project_out

#: Queries of a cell that are scored together.
SLICE = 256


def mean_vector(df: DataFrame, by: list[str], vec: str = "vec", out: str = "mean") -> DataFrame:
    """Componentwise mean of each group, summed map-side by position."""
    parts = df.where(F.col(vec).isNotNull()).select(*by, F.posexplode(vec).alias("_at", "_x"))
    cells = parts.groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"])
    return cells.groupBy(*by).agg(ordered.alias(out))


def centroid(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Unit mean vector of each group."""
    return mean_vector(df, by, vec).select(*by, normalised("mean").alias("centroid"))


def similarity(df: DataFrame, to: DataFrame, vec: str = "vec", name: str = "centroid") -> DataFrame:
    """Rows of ``df`` with their inner product with each row of ``to`` (a small dimension table)."""
    return df.join(F.broadcast(to)).withColumn("similarity", dot(vec, name))


def embedding_scores(df: DataFrame, params: DataFrame, vec: str = "vec") -> DataFrame:
    """``params(judge, centroid, platt_a, platt_b)`` -> long ``(judge, item_id, score)``."""
    return similarity(df, params, vec).select("judge", "item_id", platt("similarity", F.col("platt_a"), F.col("platt_b")).alias("score"))


def difference_of_means(df: DataFrame, positive: Column | str, vec: str = "vec") -> DataFrame:
    """One row: the unit direction from the negatives' mean to the positives'."""
    positive = F.expr(positive) if isinstance(positive, str) else positive
    both = mean_vector(df.withColumn("_side", positive), ["_side"], vec).groupBy().pivot("_side", [True, False]).agg(F.first("mean"))
    return both.select(normalised(minus(F.col("true"), F.col("false"))).alias("direction"))


def without_direction(df: DataFrame, direction: DataFrame, vec: str = "vec", out: str = "projected") -> DataFrame:
    """Vectors with the direction taken out, made unit again (length + 1e-9)."""
    rows = df.join(F.broadcast(direction))  # one row
    rows = rows.withColumn(out, project_out(vec, "direction"))
    return rows.withColumn(out, let(F.col(out), lambda v: normalised(v, 1e-9))).drop("direction")


def single_direction(base_drop: Column, tuned_drop: Column) -> Column:
    """Whether one direction carries the judge: the drop is large, and larger than the base's twice over."""
    return (tuned_drop > 2 * F.greatest(base_drop, F.lit(0.02))) & (tuned_drop > 0.1)


def _best(k: int):
    """One cell: the ``k`` best of its base rows for each of its queries, scored a slice of queries at a time."""

    def vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = rows.column("vec").combine_chunks()
        return rows.column("item_id").to_numpy(), np.asarray(held.flatten(), float).reshape(len(held), -1)

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if len(queries) and len(base):
            (mine, a), (theirs, b) = vectors(queries), vectors(base)
            order = np.argsort(theirs, kind="stable")  # the first of equal scores has the smallest id
            theirs, b = theirs[order], b[order]
            for at in range(0, len(mine), SLICE):
                some = mine[at : at + SLICE]
                score = a[at : at + SLICE] @ b.T
                score[~np.isfinite(score)] = -np.inf
                low, high = np.searchsorted(theirs, some, "left"), np.searchsorted(theirs, some, "right")
                for i in np.flatnonzero(low < high):
                    score[i, low[i] : high[i]] = -np.inf
                rows = np.arange(len(some))
                for _ in range(min(k, len(theirs))):
                    top = score.argmax(1)
                    best = score[rows, top]
                    real = np.isfinite(best)
                    for held, values in zip(found, (some, theirs[top], best), strict=True):
                        held.append(values[real])
                    score[rows, top] = -np.inf
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, kinds, strict=True)]
        return pa.table(columns, names=["query_id", "item_id", "similarity"])

    return run


def neighbours(queries: DataFrame, base: DataFrame, k: int, block: int = 16384) -> DataFrame:
    """Exact k nearest by inner product: ``(query_id, rank, item_id, similarity)``.

    Both sides are ``(item_id, vec)`` with vectors of one length.  Each side is dealt into parts of at most about ``block`` rows, and every part of
    the queries meets every part of the base in one cell, a task's work, which holds its two parts and
    ``SLICE`` rows of products at a time.  So memory does not grow with the tables, products are
    queries times rows, and a row is shuffled once for each part of the other side.  At most ``k`` rows a query leave a cell.
    An item is no neighbour of itself.  Rows without a vector, and products that are not finite, take no part.
    """
    queries, base = (df.where("vec is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "vec") for df in (queries, base))
    q_parts, b_parts = (max(-(-n // block), min(4, -(-n // 1024)), 1) for n in (queries.count(), base.count()))
    part = lambda n: F.pmod(F.xxhash64("item_id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("q_part", part(q_parts)).withColumn("b_part", every(b_parts))
    b = base.withColumn("b_part", part(b_parts)).withColumn("q_part", every(q_parts))
    cells = q.groupBy("q_part", "b_part").cogroup(b.groupBy("q_part", "b_part"))
    found = cells.applyInArrow(_best(k), "query_id long, item_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "similarity")
