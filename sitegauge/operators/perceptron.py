"""Perceptrons of sigmoid layers by L-BFGS, many models at once.

The model is MLlib's: sigmoid hidden layers, softmax over two outputs, mean log loss over all rows, no penalty, the same range of first weights.
A pass over the row blocks adds loss and gradient of every model at its own point, as matrix products over some thousand rows, so
the number of jobs does not depend on the number of models. The driver holds the weights and the last few steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.operators import blocks

CHUNK = 1024            # rows of one matrix product
PARTITION_ROWS = 1024   # a row costs far more here than in the other fits
MEMORY = 10             # steps that the curvature is taken from
TOLERANCE = 1e-6        # of the loss, over as many steps
HALVINGS = 30


@dataclass(frozen=True)
class Plan:
    """One model: the features it may use (all, if None) and the parts of the rows it learns from (all, if None)."""
    columns: tuple[int, ...] | None = None
    parts: frozenset[int] | None = None


def layers(point: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (in, out) and biases of every layer, as views of one flat array."""
    out, at = [], 0
    for fan_in, fan_out in zip(sizes, sizes[1:]):
        end = at + fan_in * fan_out
        out.append((point[at:end].reshape(fan_in, fan_out), point[end:end + fan_out]))
        at = end + fan_out
    return out


def first_point(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, fan_in * fan_out + fan_out) / np.sqrt(max(fan_in, 1)) for fan_in, fan_out in zip(sizes, sizes[1:])])


def _activations(z: np.ndarray, of: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Input, hidden layers, and the scores of both classes."""
    out = [z]
    for i, (w, b) in enumerate(of):
        z = z @ w
        z += b
        if i < len(of) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):   # infinity becomes 0 below
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
        out.append(z)
    return out


def loss_and_gradient(point: np.ndarray, sizes: Sequence[int], z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows of the log loss and of its gradient."""
    loss, gradient = 0.0, np.zeros_like(point)
    of, slopes = layers(point, sizes), layers(gradient, sizes)
    for first in range(0, len(y), CHUNK):
        label = y[first:first + CHUNK]
        act = _activations(z[first:first + CHUNK], of)
        margin = act[-1][:, 1] - act[-1][:, 0]
        loss += (np.logaddexp(0, margin) - label * margin).sum()
        off = 1 / (1 + np.exp(-np.clip(margin, -700, None))) - label
        delta = np.stack([-off, off], axis=1)
        for i in range(len(of) - 1, -1, -1):
            slopes[i][0][...] += act[i].T @ delta
            slopes[i][1][...] += delta.sum(axis=0)
            if i:
                delta = delta @ of[i][0].T
                delta *= act[i]
                delta *= 1 - act[i]
    return loss, gradient


@dataclass
class Model:
    """Weights over scaled features. ``transform`` adds ``probability`` as a vector of two."""
    point: np.ndarray
    sizes: tuple[int, ...]
    columns: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    width: int
    features: str = "features"

    @property
    def numFeatures(self) -> int:
        return self.width

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for first in range(0, len(x), CHUNK):
            scores = _activations((x[first:first + CHUNK, self.columns] - self.mean) * self.inverse, layers(self.point, self.sizes))[-1]
            out[first:first + CHUNK] = 1 / (1 + np.exp(np.clip(scores[:, 0] - scores[:, 1], None, 700)))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                matrix = np.stack(x.to_numpy()) if len(x) else np.zeros((0, model.width))
                yield pd.Series(model.probabilities(matrix.astype(np.float64)))
        p = score(blocks.feature_array(df, self.features))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


class _Sums:
    def __init__(self, *arrays: np.ndarray):
        self.arrays = arrays

    def __add__(self, other: _Sums) -> _Sums:
        return _Sums(*[a + b for a, b in zip(self.arrays, other.arrays)])


@dataclass
class _Search:
    """L-BFGS of one model. ``trial`` is the point whose loss and gradient it waits for; None at the end."""
    trial: np.ndarray | None
    iterations: int
    point: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = None
    step: np.ndarray | None = None
    size: float = 1.0
    halvings: int = 0
    done: int = 0
    past: list[float] = field(default_factory=list)
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def take(self, loss: float, slope: np.ndarray) -> None:
        if self.point is not None and not loss <= self.loss + 1e-4 * self.size * (self.slope @ self.step):
            self.size, self.halvings = self.size / 2, self.halvings + 1
            self.trial = self.point + self.size * self.step if self.halvings <= HALVINGS else None
            return
        if self.point is not None:
            moved, turned = self.trial - self.point, slope - self.slope
            if moved @ turned > 1e-12 * (turned @ turned):
                self.pairs = [*self.pairs[1 - MEMORY:], (moved, turned)]
            self.done += 1
        self.point, self.loss, self.slope = self.trial, loss, slope
        self.past = [*self.past[-MEMORY:], loss]
        flat = len(self.past) > MEMORY and self.past[0] - loss <= TOLERANCE * max(abs(loss), 1e-12)
        if self.done >= self.iterations or flat or np.abs(slope).max() < 1e-10:
            self.trial = None
            return
        self.step = self._direction()
        self.size = 1.0 if self.pairs else min(1.0, 1 / np.linalg.norm(slope))
        self.halvings = 0
        self.trial = self.point + self.size * self.step

    def _direction(self) -> np.ndarray:
        """The usual two loops over the last steps."""
        q, kept = self.slope.copy(), []
        for s, t in reversed(self.pairs):
            a = (s @ q) / (s @ t)
            q -= a * t
            kept.append(a)
        if self.pairs:
            s, t = self.pairs[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(self.pairs, reversed(kept)):
            q += (a - (t @ q) / (s @ t)) * s
        return -q


def fit_many(df: DataFrame, plans: Sequence[Plan], hidden: Sequence[int] = (256, 128), iterations: int = 100, seed: int = 42,
             features: str = "features", label: str = "label", part: str | None = None, scale: bool = True) -> list[Model]:
    """A model for every plan. ``part`` is an integer column that plans choose rows by.

    Labels are 0 or 1; NULL labels, parts or features are not trained on. ``scale`` divides every feature by the population
    deviation of the model's own rows, around their mean; constant features become 0. A model without rows keeps its first weights.
    """
    if any(p.columns == () for p in plans):
        raise ValueError("a model needs at least one feature")
    rows = df.select(blocks.feature_array(df, features).alias("x"), F.col(label).alias("y"), (F.col(part) if part else F.lit(0)).alias("part"),
                     F.lit(1.0).alias("weight")).filter("x IS NOT NULL AND y IS NOT NULL AND part IS NOT NULL")
    table, count, width = blocks.write_blocks(rows, lambda x: x)
    used = [np.arange(width) if p.columns is None else np.array(p.columns) for p in plans]
    sizes = [(len(u), *hidden, 2) for u in used]
    held = blocks.partitions(table, count, PARTITION_ROWS).map(_arrays).persist(StorageLevel.MEMORY_AND_DISK)

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

    def moments(around: np.ndarray | None):
        def one(block) -> _Sums:
            x, _, part_ = block
            at = [seen(part_, p) for p in plans]
            return _Sums(np.array([len(a) for a in at], float), np.stack(
                [x[a].sum(axis=0) if around is None else ((x[a] - m) ** 2).sum(axis=0) for a, m in zip(at, around if around is not None else at)]))
        return one

    searches = [_Search(first_point(s, seed), iterations) for s in sizes]
    mean, inverse = np.zeros((len(plans), width)), np.ones((len(plans), width))
    if count:
        n, sums = summed(moments(None)).arrays
        if scale:
            mean = sums / np.maximum(n, 1)[:, None]
            deviation = np.sqrt(summed(moments(mean)).arrays[1] / np.maximum(n, 1)[:, None])
            inverse = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)

    def objective(points: list[np.ndarray | None]):
        def one(block) -> _Sums:
            x, y, part_ = block
            out = []
            for m, (plan, at, point) in enumerate(zip(plans, used, points)):
                if point is not None:
                    r = seen(part_, plan)
                    loss, gradient = loss_and_gradient(point, sizes[m], (x[np.ix_(r, at)] - mean[m, at]) * inverse[m, at], y[r])
                    out.append(np.append(gradient, loss))
            return _Sums(*out)
        return one

    for m in range(len(plans) if count else 0):
        if not n[m]:
            searches[m].point, searches[m].trial = searches[m].trial, None
    while count and any(s.trial is not None for s in searches):
        waiting = [m for m, s in enumerate(searches) if s.trial is not None]
        for m, found in zip(waiting, summed(objective([s.trial for s in searches])).arrays):
            searches[m].take(found[-1] / n[m], found[:-1] / n[m])
    held.unpersist()
    return [Model(s.point if s.point is not None else s.trial, size, at, mean[m, at], inverse[m, at], width, features)
            for m, (s, size, at) in enumerate(zip(searches, sizes, used))]


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["x"]).reshape(row["rows"], row["width"]), np.frombuffer(row["y"]), np.frombuffer(row["part"], np.int32)
