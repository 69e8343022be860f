"""Linear multi-class support vector machine with squared hinge loss, solved in the primal.

Each class is told from the rest by minimising ``lambda / 2 |w|^2 + 1/2 sum max(0, 1 - y x'w)^2`` with conjugate gradients.
The loss along a direction is convex and piecewise quadratic, so Newton steps over sums of all rows find its minimum. All
classes, costs and folds of a search are columns of one weight matrix and advance in the same passes over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .factor import matrix_of

#: Newton steps on a line, and their least size, relative to the step so far, as a share of the solver's tolerance.
LINE_STEPS, LINE_SHARE = 20, 0.01

#: Least and most cells of features in one stored partition, and margins of a batch that are worked on at once (1 MB).
LEAST_CELLS, PART_CELLS, BLOCK_CELLS = 1 << 17, 1 << 22, 1 << 17


@dataclass
class Fits:
    """Columns of a joint fit: class, cost and the fold that is left out (-1: none) of each."""

    label: np.ndarray
    cost: np.ndarray
    fold: np.ndarray
    weights: np.ndarray  # features x columns

    def of(self, cost: float, fold: int = -1) -> np.ndarray:
        """Weights (features x classes) of one fit."""
        at = np.flatnonzero((self.cost == cost) & (self.fold == fold))
        return self.weights[:, at[np.argsort(self.label[at])]]


def design(features: np.ndarray, intercept: bool) -> np.ndarray:
    return np.hstack([features, np.ones((len(features), 1))]) if intercept else features


def fit_columns(
    rows: DataFrame, width: int, classes: int, costs: Sequence[float], folds: Sequence[int] = (-1,), intercept: bool = False,
    tol: float = 0.01, max_iter: int = 10,
) -> Fits:
    """Joint fit over ``rows`` (x array<double>, label int, fold int) for every class, cost and left-out fold.

    A column ends when a step gains less than ``tol`` of the objective, or after ``max_iter`` steps.
    """
    ship_package(rows.sparkSession)
    cells = [(c, cost, f) for f in folds for cost in costs for c in range(classes)]
    label, cost, fold = (np.array(x) for x in zip(*cells))
    wide = width + int(intercept)
    weights, direction = np.zeros((wide, len(cells))), np.zeros((wide, len(cells)))
    before = np.ones(len(cells))
    live = np.arange(len(cells))
    gradient = _gradient(rows, width, intercept, weights, label, fold)[0]
    direction[:] = gradient
    before = (gradient * gradient).sum(axis=0)
    live = live[before > 0]
    for _ in range(max_iter):
        if not len(live):
            break
        w, d, lam = weights[:, live], direction[:, live], cost[live]
        step = _line_minimum(rows, width, intercept, w, d, lam, label[live], fold[live], max(LINE_SHARE * tol, 1e-8))
        weights[:, live] = w + step * d
        slope = (d * gradient[:, live]).sum(axis=0)
        pulled, loss = _gradient(rows, width, intercept, weights[:, live], label[live], fold[live])
        new = pulled - lam * weights[:, live]
        objective = 0.5 * loss + 0.5 * lam * (weights[:, live] ** 2).sum(axis=0)
        size = (new * new).sum(axis=0)
        turn = np.maximum(size - (new * gradient[:, live]).sum(axis=0), 0.0) / before[live]
        direction[:, live] = new + d * turn
        gradient[:, live], before[live] = new, size
        # A direction that no longer descends starts again from the gradient.
        lost = (direction[:, live] * new).sum(axis=0) <= 0
        direction[:, live[lost]] = new[:, lost]
        live = live[(step * slope >= tol * objective) & (size > 0)]
    return Fits(label, cost, fold, weights)


def _pass(rows: DataFrame, measure, length: int, columns: int) -> np.ndarray:
    """Sum over all rows of what ``measure(x, label, fold)`` gives for a block of rows; tasks send one row each."""
    block = max(64, BLOCK_CELLS // max(columns, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), len(batch.column(0)[0]))
                labels, folds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                if len(x) != len(labels):
                    raise ValueError("feature vectors differ in length")
                for k in range(0, len(x), block):
                    total += measure(x[k : k + block], labels[k : k + block], folds[k : k + block])
        values = pa.ListArray.from_arrays(pa.array([0, length], type=pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([values], names=["v"])

    parts = rows.select("x", "label", "fold").mapInArrow(run, "v array<double>")
    sums = parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(length)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out


def _sides(labels: np.ndarray, folds: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """+1 or -1, and whether the row is in the training part, of every row and column."""
    return np.where(labels[:, None] == label, 1.0, -1.0), folds[:, None] != fold


def _gradient(rows: DataFrame, width: int, intercept: bool, weights: np.ndarray, label: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sum y max(0, 1 - y x'w) x`` and ``sum max(0, 1 - y x'w)^2`` of every column."""
    wide, columns = weights.shape

    def measure(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> np.ndarray:
        x = design(x, intercept)
        y, inside = _sides(labels, folds, label, fold)
        out = np.maximum(1.0 - y * (x @ weights), 0.0) * inside
        return np.concatenate([(x.T @ (out * y)).ravel(), (out * out).sum(axis=0)])

    total = _pass(rows, measure, (wide + 1) * columns, columns)
    return total[: wide * columns].reshape(wide, columns), total[wide * columns :]


def _line_minimum(
    rows: DataFrame, width: int, intercept: bool, weights: np.ndarray, direction: np.ndarray, lam: np.ndarray, label: np.ndarray, fold: np.ndarray,
    tol: float,
) -> np.ndarray:
    """Step along each column's direction with the least objective."""
    columns = weights.shape[1]
    linear, square = lam * (weights * direction).sum(axis=0), lam * (direction * direction).sum(axis=0)
    step, moving = np.zeros(columns), np.arange(columns)
    for _ in range(LINE_STEPS):
        here, w, d = step[moving], weights[:, moving], direction[:, moving]
        own, left = label[moving], fold[moving]

        def measure(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, here=here, w=w, d=d, own=own, left=left) -> np.ndarray:
            x = design(x, intercept)
            y, inside = _sides(labels, folds, own, left)
            along = x @ d
            out = np.maximum(1.0 - y * (x @ w + here * along), 0.0) * inside
            return np.concatenate([(out * y * along).sum(axis=0), ((out > 0) * along * along).sum(axis=0)])

        total = _pass(rows, measure, 2 * len(moving), len(moving)).reshape(2, -1)
        g = linear[moving] + here * square[moving] - total[0]
        h = square[moving] + total[1]
        change = np.divide(g, h, out=np.zeros_like(g), where=h > 0)
        step[moving] = here - change
        moving = moving[np.abs(change) > tol * np.abs(step[moving])]
        if not len(moving):
            break
    return step


class SquaredHingeModel(Model):
    """Predicts the class of the largest margin; the lower class number wins a tie."""

    def __init__(self, weights: np.ndarray, intercept: bool, features: str) -> None:
        super().__init__()
        self.weights, self.intercept, self.features = weights, intercept, features

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        lists = [F.array(*[F.lit(float(v)) for v in column]) for column in self.weights.T]
        x = vector_to_array(self.features)
        x = F.concat(x, F.array(F.lit(1.0))) if self.intercept else x
        margins = F.array(*[F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) for w in lists])
        named = df.withColumn("_m", margins)
        best = (F.array_position("_m", F.array_max("_m")) - 1).cast("double")
        return named.withColumn("rawPrediction", array_to_vector("_m")).withColumn("prediction", best).drop("_m")


def training_rows(df: DataFrame, features: str, label: str, folds: int, seed: int) -> tuple[DataFrame, int]:
    """(x, label, fold) stored for many passes, and the number of features; equal rows lie in one fold."""
    x = vector_to_array(features)
    picked = df.select(x.alias("x"), F.col(label).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "x", "label"), F.lit(max(folds, 1))).cast("int")
    rows = cut_lineage(picked.withColumn("fold", fold))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = width or 0
    # Every pass is a job of its own: one even task a core, fewer if the rows are few, more if they are too many for a task.
    cells, cores = count * width, df.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-cells // LEAST_CELLS), max(-(-cells // PART_CELLS), cores))
    return rows.repartition(max(1, parts)).persist(), width


def fold_scores(rows: DataFrame, fits: Fits, intercept: bool, classes: int) -> dict[tuple[float, int], float]:
    """Weighted F1 of every cost on the fold it was not fitted on, from confusion counts summed in one pass."""
    pairs = sorted({(float(c), int(f)) for c, f in zip(fits.cost, fits.fold) if f >= 0}, key=lambda p: (p[1], p[0]))
    if not pairs:
        return {}
    held = [fits.of(*p) for p in pairs]

    def measure(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> np.ndarray:
        x = design(x, intercept)
        out = np.zeros((len(pairs), classes, classes))
        for k, (_, f) in enumerate(pairs):
            inside = folds == f
            np.add.at(out[k], (labels[inside], (x[inside] @ held[k]).argmax(axis=1)), 1.0)
        return out.ravel()

    counts = _pass(rows, measure, len(pairs) * classes * classes, len(pairs) * classes).reshape(len(pairs), classes, classes)
    return {p: weighted_f1(c) for p, c in zip(pairs, counts)}


def weighted_f1(counts: np.ndarray) -> float:
    hit, actual, named = np.diag(counts), counts.sum(axis=1), counts.sum(axis=0)
    f1 = np.divide(2 * hit, actual + named, out=np.zeros_like(hit), where=actual + named > 0)
    return float((f1 * actual).sum() / actual.sum()) if actual.sum() else float("nan")
