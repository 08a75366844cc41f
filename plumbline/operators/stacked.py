"""Several logistic models over the same features, fitted together: one job evaluates all of them.

A row has features, a label for each model (null: the row is not in it) and a weight for each.
A model's objective is the weighted mean of the log loss plus half its penalty times the squared
length of its weights, the intercept left out.  Tasks add up each model's loss and gradient
over their rows; models times (features + 3) sums reach the driver, which moves every model that
has not settled and asks again.  ``fit`` searches by limited-memory BFGS with halved steps, ``descend``
takes a fixed number of plain gradient steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.staging import staged

MEMORY = 10
#: A step must bring down the objective by this share of what its slope promises.
SHARE = 1e-4


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _evaluated(points: np.ndarray):
    """Loss, weight and gradient of each model over a task's rows; ``points`` has an intercept last in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, d = points.shape[0], points.shape[1] - 1
        sums = np.zeros((m, d + 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w = (_matrix(batch.column(c)) for c in ("features", "labels", "weights"))
            held = ~np.isnan(y)
            y, w = np.where(held, y, 0.0), np.where(held, w, 0.0)
            z = x @ points[:, :d].T + points[:, d]
            r = w * (1 / (1 + np.exp(-z)) - y)
            sums[:, :d] += r.T @ x
            sums[:, d] += r.sum(0)
            sums[:, d + 1] += (w * (np.logaddexp(0, z) - y * z)).sum(0)
            sums[:, d + 2] += w.sum(0)
        model, at = np.divmod(np.arange(sums.size), d + 3)
        yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(at), pa.array(sums.ravel())], names=["model", "at", "s"])

    return run


class Evaluator:
    """The objective of each model over a frame ``(features, labels, weights)``."""

    def __init__(self, rows: DataFrame, penalties: list[float]):
        double = lambda c: F.transform(c, lambda v: v.cast("double")).alias(c)
        self.rows = staged(rows.select(*(double(c) for c in ("features", "labels", "weights"))), "stacked")
        widths = self.rows.agg(F.max(F.size("features")).alias("w")).first()
        self.width, self.penalties, self.jobs = max(0, widths["w"] or 0), np.array(penalties), 0

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Objective and gradient of each model at its point."""
        self.jobs += 1
        found = self.rows.mapInArrow(_evaluated(points), "model long, at long, s double").groupBy("model", "at").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros((len(points), self.width + 3))
        for r in found:
            sums[r["model"], r["at"]] = r["s"]
        total = np.maximum(sums[:, -1], 1e-300)
        gradient = sums[:, : self.width + 1] / total[:, None]
        gradient[:, :-1] += self.penalties[:, None] * points[:, :-1]
        return sums[:, -2] / total + self.penalties / 2 * (points[:, :-1] ** 2).sum(1), gradient


class Search:
    """One model's search: ``point`` is where it wants to be evaluated next."""

    def __init__(self, size: int, tolerance: float):
        self.at, self.value, self.slope, self.tolerance = np.zeros(size), np.inf, np.zeros(size), tolerance
        self.point, self.step, self.turn, self.pairs, self.done = self.at, 0.0, np.zeros(size), [], False

    def _direction(self) -> np.ndarray:
        q, used = self.slope.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ q / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(used), strict=True):
            q += (a - y @ q / (s @ y)) * s
        return -q

    def take(self, value: float, slope: np.ndarray) -> None:
        """What was found at ``point``: go there, or come half way back."""
        if self.value < np.inf and value > self.value + SHARE * self.step * (self.slope @ self.turn) + 1e-15 * abs(self.value):
            self.step /= 2
            self.done = self.step < 1e-14
            self.point = self.at + self.step * self.turn
            return
        s, y = self.point - self.at, slope - self.slope
        if self.value < np.inf and s @ y > 1e-300:
            self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.at, self.value, self.slope = self.point, value, slope
        self.done = bool(np.abs(slope).max(initial=0) < self.tolerance)
        self.turn = self._direction()
        if self.slope @ self.turn >= 0:
            self.pairs, self.turn = [], -slope
        self.step = 1.0 if self.pairs else 1 / max(1.0, float(np.sqrt(slope @ slope)))
        self.point = self.at + self.step * self.turn


def fit(rows: DataFrame, penalties: list[float], tolerance: float = 1e-9, most: int = 300) -> np.ndarray:
    """Weights of each model, its intercept last: one row a model."""
    evaluate = Evaluator(rows, penalties)
    searches = [Search(evaluate.width + 1, tolerance) for _ in penalties]
    for _ in range(most):
        values, slopes = evaluate(np.array([s.at if s.done else s.point for s in searches]))
        for s, value, slope in zip(searches, values, slopes, strict=True):
            if not s.done:
                s.take(float(value), slope)
        if all(s.done for s in searches):
            break
    return np.array([s.at for s in searches])


def descend(rows: DataFrame, penalties: list[float], steps: int, rate: float) -> np.ndarray:
    """Weights of each model, its intercept last, after ``steps`` plain gradient steps from zero."""
    evaluate = Evaluator(rows, penalties)
    points = np.zeros((len(penalties), evaluate.width + 1))
    for _ in range(steps):
        points = points - rate * evaluate(points)[1]
    return points


def scored(rows: DataFrame, points: np.ndarray, features: str = "features") -> DataFrame:
    """``rows`` with ``scores``, each model's probability."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(features)) if batch.num_rows else np.zeros((0, points.shape[1] - 1))
            z = 1 / (1 + np.exp(-(x @ points[:, :-1].T + points[:, -1])))
            scores = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * len(points), z.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "scores"])

    return rows.mapInArrow(run, schema)
