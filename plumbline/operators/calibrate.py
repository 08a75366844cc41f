"""Fits of small models: sufficient statistics come from Spark, the few numbers are solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import sigmoid
from plumbline.functions.vectors import dot
from plumbline.operators.ranks import joined
from plumbline.staging import staged

#: Bins of a group's values in descents over many values, terms of the sigmoid's series in a bin, and how far it may reach: the
#: series has radius pi, so what is left out is under (0.05 / pi) ** 8, below the rounding of a double.
BINS = 4096
TERMS = 8
STEEP = 0.05


def _counted(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(by, x, y, n)``, written: equal values are counted once for all steps."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return staged(rows.groupBy(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")), "platt-values")


def _with_fits(counted: DataFrame, by: list[str], fits: dict[tuple, tuple[float, float]]) -> DataFrame:
    """The rows of the groups that are still fitted, with their parameters ``a`` and ``b`` (a row a group)."""
    frame = _fitted(counted.sparkSession, by, counted.schema, {k: (*map(float, v), 0) for k, v in fits.items()}).drop("steps")
    return joined(counted, F.broadcast(frame), by)


def _fitted(spark: SparkSession, by: list, schema: T.StructType, fits: dict[tuple, tuple]) -> DataFrame:
    kinds = T.StructType([*(schema[c] for c in by), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("steps", T.IntegerType())])
    return spark.createDataFrame([(*k, *v) for k, v in fits.items()], kinds)


def platt_newton_by(df: DataFrame, by: list[str], x: str = "similarity", y: str = "label", steps: int = 200, ridge: float = 1e-9, tolerance: float = 1e-12) -> DataFrame:
    """``(by, a, b, steps)``: slope and intercept of each group by Newton's method.

    One job a step takes the five sums of all groups; a group that has settled leaves
    the next steps' rows.  The driver holds a row a group.  Groups without rows do not appear.
    """
    counted = _counted(df, by, x, y)
    done: dict[tuple, tuple] = {}
    fits = {tuple(r): (0.0, 0.0) for r in counted.select(*by).distinct().collect()}
    for k in range(1, steps + 1):
        if not fits:
            break
        p = sigmoid(F.col("a") * F.col("x") + F.col("b"))
        rows = _with_fits(counted, by, fits).withColumn("r", F.col("n") * (p - F.col("y"))).withColumn("w", F.col("n") * p * (1 - p))
        sums = {"ga": F.col("r") * F.col("x"), "gb": F.col("r"), "haa": F.col("w") * F.col("x") * F.col("x"), "hab": F.col("w") * F.col("x"), "hbb": F.col("w")}
        for s in rows.groupBy(*by).agg(*(F.sum(e).alias(f"_{n}") for n, e in sums.items())).collect():
            key = tuple(s[c] for c in by)
            h = np.array([[s["_haa"] + ridge, s["_hab"]], [s["_hab"], s["_hbb"] + ridge]])
            step = np.linalg.solve(h, np.array([s["_ga"], s["_gb"]]))
            fits[key] = fits[key][0] - float(step[0]), fits[key][1] - float(step[1])
            if np.abs(step).max() < tolerance or k == steps:
                done[key] = (*fits.pop(key), k)
    return _fitted(df.sparkSession, by, counted.schema, done)


def _binned(counted: DataFrame, by: list[str]) -> DataFrame:
    """``(by, _bin, c, h, m0 .. m<TERMS>)``: sums of n and of n times powers of (x - c) / h over the values in each of a group's bins, ``h`` half as wide as a bin."""
    ends = counted.groupBy(*by).agg(F.min("x").alias("_lo"), ((F.max("x") - F.min("x")) / BINS).alias("_w"))
    rows = joined(counted, F.broadcast(ends), by)  # a row a group
    at = F.when(F.col("_w") > 0, F.least(F.floor((F.col("x") - F.col("_lo")) / F.col("_w")), F.lit(BINS - 1))).otherwise(0)
    rows = rows.withColumn("_bin", at).withColumns({"c": F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_w"), "h": F.col("_w") / 2})
    t = F.when(F.col("h") > 0, (F.col("x") - F.col("c")) / F.col("h")).otherwise(0.0)
    rows = rows.withColumn("_t0", F.col("n").cast("double"))
    for k in range(1, TERMS + 1):
        rows = rows.withColumn(f"_t{k}", F.col(f"_t{k - 1}") * t)
    return rows.groupBy(*by, "_bin").agg(F.first("c").alias("c"), F.first("h").alias("h"), *(F.sum(f"_t{k}").alias(f"m{k}") for k in range(TERMS + 1)))


def _binned_descent(counted: DataFrame, by: list[str], steps: int, rate: float, start: tuple[float, float]) -> dict[tuple, tuple[float, float]] | None:
    """Each group's ``a, b`` from its bins, at most ``BINS`` rows a group; None where a slope is too steep for them or values are not finite."""
    fits: dict[tuple, tuple[float, float]] = {}
    whole = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y"), F.sum(F.col("n") * F.col("x") * F.col("y")).alias("xy")).collect()
    bins: dict[tuple, list] = {}
    for r in _binned(counted, by).collect():
        bins.setdefault(tuple(r[c] for c in by), []).append([r["c"], r["h"], *(r[f"m{k}"] for k in range(TERMS + 1))])
    for s in whole:
        key = tuple(s[c] for c in by)
        held = np.array(bins[key], float).T
        c, h, m = held[0], held[1], held[2:]
        if not (np.isfinite(held).all() and np.isfinite([s["y"], s["xy"]]).all()):
            return None
        a, b = start
        for _ in range(steps):
            if abs(a) * h.max() > STEEP:
                return None
            terms = [1 / (1 + np.exp(-(a * c + b)))]  # p' = p - p * p, so the series follows term by term
            for k in range(TERMS - 1):
                terms.append((terms[k] - sum(terms[i] * terms[k - i] for i in range(k + 1))) / (k + 1))
            powers = [t * (a * h) ** k for k, t in enumerate(terms)]
            p = sum(v * m[k] for k, v in enumerate(powers))
            px = c * p + h * sum(v * m[k + 1] for k, v in enumerate(powers))
            a, b = a - rate * (px.sum() - s["xy"]) / s["n"], b - rate * (p.sum() - s["y"]) / s["n"]
        fits[key] = float(a), float(b)
    return fits


def platt_descent_by(df: DataFrame, by: list[str], x: str = "similarity", y: str = "label", steps: int = 2000, rate: float = 0.5, start: tuple[float, float] = (20.0, -10.0), most_values: int = 100_000) -> DataFrame:
    """``(by, a, b, steps)`` by the fixed-budget variant: plain gradient descent, stopped after ``steps`` whether it has settled or not.

    All groups take a step together.  Equal (x, y) are counted first.  Up to ``most_values``
    counted values of all groups take the steps on the driver.  More are summed up once by Spark, as moments of ``BINS`` narrow
    bins of x in each group (``_binned``), from which the sums of a step follow to rounding, as a series of
    the sigmoid in each bin; should a slope grow so steep that the series is too coarse, all steps are done
    by Spark, one job a step.  All give the same numbers.
    """
    counted = _counted(df, by, x, y)
    if counted.count() > most_values:
        fits = _binned_descent(counted, by, steps, rate, start)
        if fits is not None:
            return _fitted(df.sparkSession, by, counted.schema, {k: (*v, steps) for k, v in fits.items()})
        fits = {tuple(r): start for r in counted.select(*by).distinct().collect()}
        for _ in range(steps):
            r = F.col("n") * (sigmoid(F.col("a") * F.col("x") + F.col("b")) - F.col("y"))
            sums = _with_fits(counted, by, fits).groupBy(*by).agg(F.sum(r * F.col("x")).alias("_ga"), F.sum(r).alias("_gb"), F.sum("n").alias("_n")).collect()
            for s in sums:
                key = tuple(s[c] for c in by)
                fits[key] = fits[key][0] - rate * s["_ga"] / s["_n"], fits[key][1] - rate * s["_gb"] / s["_n"]
        return _fitted(df.sparkSession, by, counted.schema, {k: (*map(float, v), steps) for k, v in fits.items()})
    got = counted.collect()
    number = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[c] for c in by) for r in got))}
    of = np.array([number[tuple(r[c] for c in by)] for r in got], np.int64)
    v, t, n = (np.array([r[c] for r in got], float) for c in ("x", "y", "n"))
    a, b, total = np.full(len(number), start[0]), np.full(len(number), start[1]), np.bincount(of, n, len(number))
    for _ in range(steps if len(got) else 0):
        r = n * (1 / (1 + np.exp(-(a[of] * v + b[of]))) - t)
        a, b = a - rate * np.bincount(of, r * v, len(number)) / total, b - rate * np.bincount(of, r, len(number)) / total
    return _fitted(df.sparkSession, by, counted.schema, {k: (float(a[i]), float(b[i]), steps) for k, i in number.items()})


def _one(fits: DataFrame, start: tuple[float, float]) -> tuple[float, float]:
    row = fits.first()
    return (row["a"], row["b"]) if row else start


def platt_newton(df: DataFrame, x: str = "similarity", y: str = "label", steps: int = 200, ridge: float = 1e-9, tolerance: float = 1e-12) -> tuple[float, float]:
    """Slope and intercept of all rows by Newton's method."""
    return _one(platt_newton_by(df.withColumn("_all", F.lit(1)), ["_all"], x, y, steps, ridge, tolerance), (0.0, 0.0))


def platt_descent(df: DataFrame, x: str = "similarity", y: str = "label", steps: int = 2000, rate: float = 0.5, start: tuple[float, float] = (20.0, -10.0), most_values: int = 100_000) -> tuple[float, float]:
    """Slope and intercept of all rows by the fixed-budget variant."""
    return _one(platt_descent_by(df.withColumn("_all", F.lit(1)), ["_all"], x, y, steps, rate, start, most_values), start)


def logistic(df: DataFrame, features: str, label: str = "label", penalty: float = 1e-3, weight: str | None = None) -> tuple[list[float], float]:
    """L2-penalised logistic weights and intercept over an array column."""
    rows = df.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"), *([weight] if weight else []))
    fit = LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10, **({"weightCol": weight} if weight else {})).fit(rows)
    return fit.coefficients.tolist(), float(fit.intercept)


def standardised(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[float], list[float]]:
    """Columns less their mean over their population deviation + 1e-9."""
    s = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    mu, sd = [s[f"m_{c}"] or 0.0 for c in columns], [(s[f"s_{c}"] or 0.0) + 1e-9 for c in columns]
    return df.withColumns({c: (F.col(c) - m) / d for c, m, d in zip(columns, mu, sd, strict=True)}), mu, sd


def balanced_weight(label: Column, n: int, n_pos: int) -> Column:
    """Weights under which both classes count alike."""
    return F.when(label == 1, n / (2.0 * max(n_pos, 1))).otherwise(n / (2.0 * max(n - n_pos, 1)))


def probabilities(df: DataFrame, features: str, weights: list[float], intercept: float) -> DataFrame:
    return df.withColumn("score", sigmoid(dot(features, F.array(*map(F.lit, weights))) + F.lit(intercept)))

