"""Judge metrics over long frames: any number of judges in one job.

A frame has grouping columns, a ``score`` and what the metric needs beside it.
Undefined values are null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranks import joined, percentile, running
from plumbline.staging import staged

TARGET_FPR = 0.05
BINS = 10


def auc(df: DataFrame, by: list[str], positive: Column | str, score: str = "score", buckets: int | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve: ``(by, n_pos, n_neg, auc)``.

    Integer-exact: twice the wins of positives over negatives, ties counted
    once, over twice the number of pairs.  Null where either side is empty.
    """
    positive = F.expr(positive) if isinstance(positive, str) else positive
    counted = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count(F.when(positive, 1)).alias("pos"), F.count(F.when(~positive, 1)).alias("neg")
    )
    sums = running(counted, by, score, {"neg_below": "neg"}, buckets)
    wins = F.sum((F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))).cast("decimal(38,0)"))
    found = sums.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("w"))
    pairs = 2.0 * F.col("n_pos") * F.col("n_neg")
    return found.select(*by, "n_pos", "n_neg", F.when(pairs > 0, F.col("w").cast("double") / pairs).alias("auc"))


def detection(df: DataFrame, by: list[str], positive: str, target: float = TARGET_FPR, buckets: int | None = None) -> DataFrame:
    """``(by, threshold, fpr_realized)``: detected is a score strictly below the threshold."""
    pos = df.where(positive).where("score is not null")
    thr = percentile(pos, by, "score", target, "threshold", buckets)
    return pos.join(thr, by).groupBy(*by).agg(F.first("threshold").alias("threshold"), F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("fpr_realized"))


def detection_rates(df: DataFrame, by: list[str], thresholds: DataFrame, corrupt: str, cell: list[str]) -> DataFrame:
    """Share of corrupted items below the threshold for each cell, as ``(by, cell, det)``."""
    rows = df.where(corrupt).where("score is not null").join(thresholds.select(*by, "threshold"), by)
    return rows.groupBy(*by, *cell).agg(F.count("*").alias("n"), F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("det"))


def ece_bin(score: Column, bins: int = BINS) -> Column:
    """Bin of a score by the double edges of an even grid; the last bin is closed, outside is null."""
    edges = np.linspace(0, 1, bins + 1).tolist()
    found = F.when(score < edges[0], F.lit(None).cast("int"))
    for k in range(bins - 1):
        found = found.when(score < edges[k + 1], F.lit(k))
    return found.when((score <= edges[-1]) & ~F.isnan(score), F.lit(bins - 1))


def ece(df: DataFrame, by: list[str], label: str = "label", bins: int = BINS) -> DataFrame:
    """Expected calibration error; scores outside the grid only count in the denominator."""
    rows = df.where("score is not null").withColumn("bin", ece_bin(F.col("score"), bins))
    cells = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg(F.col(label).cast("double")).alias("l"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("s") - F.col("l"))).otherwise(0.0)
    return cells.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def spearman(df: DataFrame, by: list[str], x: str, y: str = "score") -> DataFrame:
    """Rank correlation in each group; a constant side gives 0.

    Equal (x, y) are counted first, each side is ranked over its own values, and the moments are sums
    about the middle rank, which is known: a group of any size is spread over tasks.
    """
    cells = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")), "cells")
    for side in ("_x", "_y"):
        counted = cells.groupBy(*by, side).agg(F.sum("_c").alias("_n"))
        ranked = running(counted, by, side, {"_below": "_n"}, totals={"_all": "_below"})
        middle = F.col("_below") + (F.col("_n") - F.col("_all")) / 2  # the mean rank less the middle one
        cells = joined(cells, ranked.select(*by, side, middle.alias(f"{side}_r"), *(["_all"] if side == "_x" else [])), [*by, side])
    a, b, c = F.col("_x_r"), F.col("_y_r"), F.col("_c")
    moments = cells.groupBy(*by).agg(F.max("_all").alias("n"), F.sum(c * a * b).alias("ab"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb"))
    return moments.select(*by, "n", F.coalesce(F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)).alias("rho"))


def spearman_summary(groups: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation and share above zero of the groups' correlations."""
    return groups.groupBy(*by).agg(
        F.avg("rho").alias("rho_mean"), F.stddev_pop("rho").alias("rho_sd"), F.avg((F.col("rho") > 0).cast("double")).alias("rho_positive")
    )


def complete_judges(scores: DataFrame, least: int = 2000) -> DataFrame:
    """Judges with more than ``least`` scores."""
    return scores.where("score is not null").groupBy("judge").agg(F.count("*").alias("n")).where(F.col("n") > least)


#: What each AUC of the report compares.
COMPARED = {
    "auc_vs_competitor": ("pos_real", "neg_competitor"),
    "auc_vs_masked": ("pos_real", "neg_masked"),
    "auc_vs_clean": ("pos_real", "neg_clean"),
    "auc_temporal_vs_competitor": ("pos_temporal", "neg_competitor"),
}


def report_card(items: DataFrame) -> DataFrame:
    """One row a judge from ``(judge, instrument, score, dimension, severity, prompt_idx, seed, adapter_scale)``."""
    by = ["judge"]
    pairs = None
    for name, (pos, neg) in COMPARED.items():
        part = items.where(F.col("instrument").isin(pos, neg)).select("judge", F.lit(name).alias("which"), (F.col("instrument") == pos).alias("is_pos"), "score")
        pairs = part if pairs is None else pairs.unionByName(part)
    areas = auc(pairs, ["judge", "which"], F.col("is_pos")).groupBy("judge").pivot("which", list(COMPARED)).agg(F.first("auc"))
    areas = areas.withColumn("logo_delta", F.col("auc_vs_competitor") - F.col("auc_vs_masked"))
    thr = detection(items, by, "instrument = 'pos_real'")
    cells = detection_rates(items, by, thr, "instrument in ('corrupt_prog', 'corrupt_gen')", ["dimension", "severity"])
    mean_det = cells.groupBy("judge").agg(F.avg("det").alias("mean_det"))
    dial = spearman(items.where("instrument = 'dial'"), ["judge", "prompt_idx", "seed"], "adapter_scale")
    calibrated = items.where("instrument in ('pos_real', 'neg_competitor')").withColumn("label", (F.col("instrument") == "pos_real").cast("int"))
    out = items.select("judge").distinct()
    for part in (areas, thr, mean_det, spearman_summary(dial, by), ece(calibrated, by)):
        out = out.join(part, "judge", "left")
    return out
