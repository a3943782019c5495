"""Many logistic models at once by Newton's method.

A pass over the row blocks adds the loss, gradient and Hessian of every model that may see a block's rows, so the number of jobs
does not depend on the number of models. The objective is the usual one with C = 1: the sum of (weighted) losses plus half the
squared length of the coefficients, without the intercept. Every model scales its features by the mean and population
deviation of its own rows. A step that does not lower the objective is halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.operators import blocks

TOLERANCE = 1e-9
CHUNK = 4096


@dataclass(frozen=True)
class Plan:
    """One model: the features it may use (all, if None) and the parts of the rows it learns from (all, if None)."""
    columns: tuple[int, ...] | None = None
    parts: frozenset[int] | None = None


@dataclass
class Model:
    """Coefficients for unscaled features (0 for those not used). ``transform`` adds ``probability`` as a vector of two."""
    weights: np.ndarray
    intercept: float
    gradient: float   # largest part of the objective's gradient at the end
    features: str = "features"

    @property
    def numFeatures(self) -> int:
        return len(self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        z = _dot(blocks.feature_array(df, self.features), F.lit(self.weights.tolist()).cast("array<double>")) + F.lit(float(self.intercept))
        p = 1 / (1 + F.exp(-z))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def _dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


class _Sums:
    def __init__(self, *arrays: np.ndarray):
        self.arrays = arrays

    def __add__(self, other: _Sums) -> _Sums:
        return _Sums(*[a + b for a, b in zip(self.arrays, other.arrays)])


def fit_many(df: DataFrame, plans: Sequence[Plan], features: str = "features", label: str = "label", part: str | None = None,
             weight: str | None = None, iterations: int = 500, scale: bool = True) -> list[Model]:
    """A model for every plan. ``part`` is an integer column that plans choose rows by.

    NULL labels, parts, weights or features are not trained on. A model without rows is the constant one half; with rows of one
    class its intercept grows until the steps end.
    """
    rows = df.select(blocks.feature_array(df, features).alias("x"), F.col(label).alias("y"), (F.col(part) if part else F.lit(0)).alias("part"),
                     (F.col(weight) if weight else F.lit(1.0)).alias("weight")).filter(
                         "x IS NOT NULL AND y IS NOT NULL AND part IS NOT NULL AND weight IS NOT NULL")
    table, count, width = blocks.write_blocks(rows, lambda x: x)
    if not count:
        return [Model(np.zeros(width), 0.0, 0.0, features) for _ in plans]
    held = blocks.partitions(table, count).map(_arrays).persist(StorageLevel.MEMORY_AND_DISK)
    used = [np.arange(width) if p.columns is None else np.array(p.columns) for p in plans]

    def seen(part_: np.ndarray, plan: Plan) -> np.ndarray:
        return np.arange(len(part_)) if plan.parts is None else np.flatnonzero(np.isin(part_, list(plan.parts)))

    def summed(one) -> _Sums:
        def run(parts: Iterator) -> Iterator[_Sums]:
            out = None
            for block in parts:
                found = one(block)
                out = found if out is None else out + found
            if out is not None:
                yield out
        return blocks.total(held.mapPartitions(run))

    def first_moments(block) -> _Sums:
        x, _, part_, _ = block
        at = [seen(part_, p) for p in plans]
        return _Sums(np.array([len(a) for a in at], float), np.stack([x[a].sum(axis=0) for a in at]))

    n, sums = summed(first_moments).arrays
    mean = sums / np.maximum(n, 1)[:, None] if scale else np.zeros_like(sums)

    def second_moments(block) -> _Sums:
        x, _, part_, _ = block
        return _Sums(np.stack([((x[seen(part_, p)] - m) ** 2).sum(axis=0) for p, m in zip(plans, mean)]))

    deviation = np.sqrt(summed(second_moments).arrays[0] / np.maximum(n, 1)[:, None]) if scale else np.ones_like(sums)
    inverse = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)   # constant features become 0

    def objective(points: list[np.ndarray]):
        def one(block) -> _Sums:
            x, y, part_, wt = block
            size = len(plans)
            loss, gradient, hessian = np.zeros(size), np.zeros((size, width + 1)), np.zeros((size, width + 1, width + 1))
            for m, (plan, at) in enumerate(zip(plans, used)):
                rows_ = seen(part_, plan)
                where = np.append(at, width)
                for first in range(0, len(rows_), CHUNK):
                    r = rows_[first:first + CHUNK]
                    z = np.hstack([(x[np.ix_(r, at)] - mean[m, at]) * inverse[m, at], np.ones((len(r), 1))])
                    s = z @ points[m][where]
                    p = 1 / (1 + np.exp(-s))
                    loss[m] += (wt[r] * (np.logaddexp(0, s) - y[r] * s)).sum()
                    gradient[m, where] += z.T @ (wt[r] * (p - y[r]))
                    hessian[m][np.ix_(where, where)] += (z * (wt[r] * p * (1 - p))[:, None]).T @ z
            return _Sums(loss, gradient, hessian)
        return one

    points = [np.zeros(width + 1) for _ in plans]
    before, steps, slope = [np.inf] * len(plans), [np.zeros(width + 1) for _ in plans], [0.0] * len(plans)
    done = [False] * len(plans)
    for _ in range(iterations):
        loss, gradient, hessian = summed(objective(points)).arrays
        for m, at in enumerate(used):
            if done[m]:
                continue
            where = np.append(at, width)
            penalty = np.zeros(width + 1)
            penalty[at] = 1.0
            now = loss[m] + 0.5 * (points[m][at] ** 2).sum()
            if now > before[m] * (1 + 1e-12) + 1e-12:
                steps[m] = steps[m] / 2
                points[m] = points[m] - steps[m]
                done[m] = np.abs(steps[m]).max() < TOLERANCE
                continue
            slope_now = gradient[m] + penalty * points[m]
            before[m], slope[m] = now, float(np.abs(slope_now).max())
            curve = (hessian[m] + np.diag(penalty))[np.ix_(where, where)]
            curve[-1, -1] += 1e-12
            steps[m] = np.zeros(width + 1)
            steps[m][where] = -np.linalg.solve(curve, slope_now[where])
            if np.abs(steps[m]).max() < TOLERANCE:
                done[m] = True
            else:
                points[m] = points[m] + steps[m]
        if all(done):
            break
    held.unpersist()
    raw = [p[:-1] * i for p, i in zip(points, inverse)]
    return [Model(w, float(p[-1] - (w * m).sum()), g, features) for w, p, m, g in zip(raw, points, mean, slope)]


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["x"]).reshape(row["rows"], row["width"]), np.frombuffer(row["y"]), np.frombuffer(row["part"], np.int32),
            np.frombuffer(row["weight"]))


def scored_by_part(df: DataFrame, models: Sequence[Model], part: str, name: str = "y_prob") -> DataFrame:
    """Every row scored by the model whose number is its part; rows of other parts are left out."""
    spark = df.sparkSession
    # One row for each model.
    table = spark.createDataFrame([(i, m.weights.tolist(), m.intercept) for i, m in enumerate(models)], "_model int, _w array<double>, _b double")
    joined = df.join(F.broadcast(table), F.col(part) == F.col("_model"))
    z = _dot(blocks.feature_array(df, models[0].features), F.col("_w")) + F.col("_b")
    return joined.withColumn(name, 1 / (1 + F.exp(-z))).drop("_model", "_w", "_b")
