"""Second-order gradient boosting on binned features, many models in one pass.

Bin edges are quantiles of a mergeable sketch. Rows are written once as one byte for each feature. A tree grows level by level: a pass
adds gradient and Hessian histograms of the smaller child of every split; the larger child is its parent less its sibling. Every tree
draws rows by a hash of the row and columns by a seed. Leaves hold the Newton step.

Models do not depend on each other. Where the bins of all rows fit one task (``TASK_CELLS``), every model is a task that reads its
rows and columns from a shuffle and grows all its trees: one job for all models, without a job for each tree or level. Beyond, every
level is a job over all rows that counts for all models together, so their number does not change the number of jobs.
Margins then travel with the rows from tree to tree (kept in memory, spilled to disk) and are checkpointed every ``CHECKPOINT`` trees, so
a lost executor costs the trees since then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.operators import blocks
from sitegauge.session import shared_root

CHECKPOINT = 25
CHUNK = 4096           # rows scored together, so that their bins stay in the cache
TASK_CELLS = 2 ** 26   # bins (rows by features, a byte each) that one task holds; more are spread over many
SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class Boosting:
    """The defaults are the published training configuration; ``l2`` and ``least_hessian`` are those usual for it."""
    trees: int = 300
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    l2: float = 1.0
    least_hessian: float = 1.0
    bins: int = 64
    seed: int = 42


@dataclass(frozen=True)
class Plan:
    """One model: the features it may use (all, if None) and the parts of the rows it learns from (all, if None)."""
    columns: tuple[int, ...] | None = None
    parts: frozenset[int] | None = None


@dataclass
class Tree:
    """A complete binary tree: feature of each node (-1 at leaves), last bin that goes left, value, gain."""
    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size))

    def step(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows at inner nodes go on to a child. ``x`` holds the bins, a line for each feature."""
        feature = self.feature[at]
        right = x[np.maximum(feature, 0), np.arange(len(at))] > self.last[at]
        return np.where(feature >= 0, 2 * at + 1 + right, at)

    def values(self, x: np.ndarray) -> np.ndarray:
        """The value of the leaf where every row of bins ends (a line of ``x`` for each feature)."""
        n = x.shape[1]
        feature, last, value = self.feature.astype(np.int64), self.last.copy(), self.value.copy()
        inner = len(value) // 2
        for node in np.flatnonzero(feature[:inner] < 0):   # a leaf hands its value down, so every row takes as many steps
            feature[node], last[node] = 0, np.iinfo(np.uint8).max
            value[2 * node + 1:2 * node + 3] = value[node]
        flat, rows, line, at = x.ravel(), np.arange(n), feature * n, np.zeros(n, np.int64)
        for _ in range(inner.bit_length()):
            at = 2 * at + 1 + (flat.take(line[at] + rows) > last[at])
        return value[at]


@dataclass
class Model:
    """Trees over binned features. ``transform`` adds ``probability`` as a vector of two."""
    edges: np.ndarray
    width: int
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    features: str = "features"

    @property
    def numFeatures(self) -> int:
        return self.width

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for first in range(0, len(x) if self.trees else 0, CHUNK):
            binned = np.ascontiguousarray(bin_rows(x[first:first + CHUNK], self.edges).T)
            for tree in self.trees:
                out[first:first + CHUNK] += tree.values(binned)
        return out

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of the splits of every feature, scaled to a total of one."""
        gain, uses = np.zeros(self.width), np.zeros(self.width)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(uses, tree.feature[inner], 1)
        mean = gain / np.maximum(uses, 1)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                matrix = np.stack(x.to_numpy()) if len(x) else np.zeros((0, model.width))
                yield pd.Series(1 / (1 + np.exp(-model.margins(matrix.astype(np.float64)))))
        p = score(blocks.feature_array(df, self.features))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


def bin_edges(rows: DataFrame, bins: int) -> np.ndarray:
    """Edges of every feature, (features, bins - 1); bin b holds values in (edge[b-1], edge[b]]."""
    probes = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(
        F.percentile_approx("v", probes, SKETCH_ACCURACY).alias("edges")).orderBy("dim").collect()   # a row for each feature
    return np.array([r["edges"] for r in found], np.float64).reshape(len(found), bins - 1)


def bin_rows(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins as bytes; NaN goes to bin 0."""
    out = np.empty(x.shape, np.uint8)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], np.nan_to_num(x[:, j], nan=-np.inf))
    return out


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row keys."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2 ** 53


@dataclass
class Rows:
    """One block: bins (a line for each feature), labels, parts, keys, and the margins of every model."""
    x: np.ndarray
    y: np.ndarray
    part: np.ndarray
    key: np.ndarray
    margin: np.ndarray

    @classmethod
    def of(cls, row, starts: np.ndarray) -> Rows:
        n, width = row["rows"], row["width"]
        x = np.ascontiguousarray(np.frombuffer(row["x"], np.uint8).reshape(n, width).T)
        return cls(x, np.frombuffer(row["y"]), np.frombuffer(row["part"], np.int32), np.frombuffer(row["key"], np.int64),
                   np.tile(starts[:, None], (1, n)))

    def grown(self, trees: Sequence[Tree]) -> Rows:
        margin = np.stack([m + t.values(self.x) for m, t in zip(self.margin, trees)])
        return Rows(self.x, self.y, self.part, self.key, margin)

    def of_model(self, model: int, plan: Plan) -> Rows:
        """The rows and features that one model learns from."""
        seen = np.arange(len(self.y)) if plan.parts is None else np.flatnonzero(np.isin(self.part, list(plan.parts)))
        x = self.x if plan.columns is None else self.x[list(plan.columns)]
        return Rows(x.take(seen, axis=1), self.y[seen], self.part[seen], self.key[seen], self.margin[model:model + 1, seen])


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def histogram(x: np.ndarray, lines: Sequence[int], use: np.ndarray, slot: np.ndarray, slots: int, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """(slots, lines, bins, 2) sums of gradient and Hessian over the rows ``use``, by the slot of every row. ``lines`` are features' places in ``x``."""
    out = np.zeros((slots, len(lines), bins, 2))
    if len(use):
        base, g, h = slot[use] * bins, g[use], h[use]
        for j, line in enumerate(lines):
            cell = base + x[line].take(use)
            out[:, j, :, 0] = np.bincount(cell, g, slots * bins).reshape(slots, bins)
            out[:, j, :, 1] = np.bincount(cell, h, slots * bins).reshape(slots, bins)
    return out


def slot_numbers(tree: Tree, slots: dict[int, int]) -> np.ndarray:
    """The slot of every node, -1 for nodes that are not counted."""
    out = np.full(len(tree.feature), -1, np.int64)
    out[list(slots)] = list(slots.values())
    return out


def best_splits(hist: np.ndarray, settings: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every node: gain, column and last bin of its best split; gain 0 where none helps. Ties go to the first column and bin."""
    left = hist.cumsum(axis=2)[:, :, :-1]
    whole = hist.sum(axis=2, keepdims=True)
    right = whole - left

    def quality(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + settings.l2)
    gain = 0.5 * (quality(left) + quality(right) - quality(whole))
    gain = np.where((left[..., 1] >= settings.least_hessian) & (right[..., 1] >= settings.least_hessian), gain, 0.0)
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(hist)), best], best // gain.shape[2], best % gain.shape[2]


def drawn_columns(plan: Plan, width: int, tree: int, settings: Boosting) -> np.ndarray:
    """Columns of one tree, a seeded draw without repetition."""
    usable = np.arange(width) if plan.columns is None else np.array(plan.columns)
    take = max(1, int(settings.column_share * len(usable)))
    return np.sort(np.random.default_rng([settings.seed, tree]).choice(usable, take, replace=False))


def fit_many(df: DataFrame, plans: Sequence[Plan], settings: Boosting = Boosting(), features: str = "features", label: str = "label",
             part: str | None = None) -> list[Model]:
    """A model for every plan. ``part`` is an integer column that plans choose rows by.

    Labels are 0 or 1. NULL labels, parts or features are not trained on. Rows equal in features, label and part are drawn together.
    A model whose rows are of one class, or that has none, is close to the constant it starts from.
    """
    if any(p.columns == () for p in plans):
        raise ValueError("a model needs at least one feature")
    rows = df.select(blocks.feature_array(df, features).alias("x"), F.col(label).alias("y"), (F.col(part) if part else F.lit(0)).alias("part"),
                     F.lit(1.0).alias("weight")).filter("x IS NOT NULL AND y IS NOT NULL AND part IS NOT NULL")
    edges = bin_edges(rows, settings.bins)
    models = [Model(edges, len(edges), features=features) for _ in plans]
    if not len(edges):
        return models
    table, count, width = blocks.write_blocks(rows, lambda x: bin_rows(x, edges))
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    starts = np.array([m.start for m in models])
    blocks_ = blocks.partitions(table, count).map(lambda r: Rows.of(r, starts))
    if count * width <= TASK_CELLS:
        for number, trees in _fit_in_tasks(blocks_, plans, width, settings).items():
            models[number].trees = trees
        return models
    state = blocks_.persist(StorageLevel.MEMORY_AND_DISK)
    held = [state]
    for number in range(settings.trees):
        trees = _grow(state, plans, width, number, settings)
        for model, tree in zip(models, trees):
            model.trees.append(tree)
        state = state.map(lambda rows, trees=trees: rows.grown(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT == CHECKPOINT - 1:
            state.checkpoint()
        held.append(state)
        if len(held) > 2:   # the next pass reads the one before the last
            held.pop(0).unpersist()
    for old in held:
        old.unpersist()
    return models


def _fit_in_tasks(blocks_, plans: Sequence[Plan], width: int, settings: Boosting) -> dict[int, list[Tree]]:
    """All trees of every model, a task for each model."""
    def of_models(rows: Rows) -> Iterator[tuple[int, Rows]]:
        for model, plan in enumerate(plans):
            own = rows.of_model(model, plan)
            if len(own.y):
                yield model, own

    def fit(pairs: Iterator[tuple[int, Rows]]) -> Iterator[tuple[int, list[Tree]]]:
        pieces: dict[int, list[Rows]] = {}
        for model, rows in pairs:
            pieces.setdefault(model, []).append(rows)
        for model in list(pieces):
            yield model, _all_trees(pieces.pop(model), plans[model], width, settings)
    found = dict(blocks_.flatMap(of_models).partitionBy(len(plans), lambda model: model).mapPartitions(fit).collect())   # trees only
    return {model: found.get(model) or [Tree.empty(settings.depth) for _ in range(settings.trees)] for model in range(len(plans))}


def _all_trees(pieces: list[Rows], plan: Plan, width: int, settings: Boosting) -> list[Tree]:
    """The trees of one model from all its rows."""
    pieces.sort(key=lambda r: (len(r.key), int(r.key[0])))   # the shuffle's order is open, and sums depend on it in their last digits
    x, y, key = np.concatenate([r.x for r in pieces], axis=1), np.concatenate([r.y for r in pieces]), np.concatenate([r.key for r in pieces])
    margin = np.concatenate([r.margin[0] for r in pieces])
    pieces.clear()
    line_of = np.zeros(width, np.int64)
    line_of[np.arange(width) if plan.columns is None else list(plan.columns)] = np.arange(len(x))
    out = []
    for number in range(settings.trees):
        columns, salt = _draws(plan, width, number, settings)
        drawn = mixed(key, salt) < settings.row_share
        g, h = gradients(y, margin)
        at = np.zeros(len(y), np.int64)

        def step(tree: Tree) -> None:
            nonlocal at
            local = Tree(np.where(tree.feature >= 0, line_of[tree.feature], -1), tree.last, tree.value, tree.gain)
            at = local.step(x, at)

        def sums(trees: list[Tree], slots: list[dict[int, int]]) -> _Sums:
            if trees[0].feature[0] >= 0:
                step(trees[0])
            slot = slot_numbers(trees[0], slots[0])[at]
            return _Sums([histogram(x, line_of[columns], np.flatnonzero(drawn & (slot >= 0)), slot, len(slots[0]), g, h, settings.bins)])
        tree = _levels(sums, 1, [columns], settings)[0]
        step(tree)   # to the children that the last level opened
        margin = margin + tree.value[at]
        out.append(tree)
    return out


def _draws(plan: Plan, width: int, number: int, settings: Boosting) -> tuple[np.ndarray, int]:
    """Columns of a tree and the salt of its draw of rows."""
    return drawn_columns(plan, width, number, settings), settings.seed * 1_000_003 + number


def _partial(block_rows: Iterable[Rows], plans: Sequence[Plan], trees: list[Tree], slots: list[dict[int, int]], columns: list[np.ndarray],
             salt: int, settings: Boosting) -> _Sums | None:
    """Histograms of all models over some blocks: the rows that a model may see and the tree draws."""
    def of_model(rows: Rows, drawn: np.ndarray, m: int) -> np.ndarray:
        use = drawn
        if plans[m].parts is not None:
            use = use[np.isin(rows.part[use], list(plans[m].parts))]
        at = np.zeros(len(rows.y), np.int64)
        x = rows.x.take(use, axis=1)
        place = at[use]
        while (trees[m].feature[place] >= 0).any():
            place = trees[m].step(x, place)
        at[use] = place
        slot = slot_numbers(trees[m], slots[m])[at]
        use = use[slot[use] >= 0]
        return histogram(rows.x, columns[m], use, slot, len(slots[m]), *gradients(rows.y, rows.margin[m]), settings.bins)
    sums = None
    for rows in block_rows:
        drawn = np.flatnonzero(mixed(rows.key, salt) < settings.row_share)
        found = _Sums([of_model(rows, drawn, m) for m in range(len(plans))])
        sums = found if sums is None else sums + found
    return sums


def _grow(state, plans: Sequence[Plan], width: int, number: int, settings: Boosting) -> list[Tree]:
    """One tree for every plan. Every level is a job that adds up the partitions' sums."""
    columns = [_draws(p, width, number, settings)[0] for p in plans]
    salt = settings.seed * 1_000_003 + number

    def over_all(trees: list[Tree], slots: list[dict[int, int]]) -> _Sums:
        def partial(block_rows: Iterator[Rows]) -> Iterator[_Sums]:
            sums = _partial(block_rows, plans, trees, slots, columns, salt, settings)
            if sums is not None:
                yield sums
        return blocks.total(state.mapPartitions(partial))
    return _levels(over_all, len(plans), columns, settings)


def _levels(sums_of: Callable[[list[Tree], list[dict[int, int]]], _Sums], models: int, columns: list[np.ndarray], settings: Boosting) -> list[Tree]:
    """Trees of all models, level by level, from sums for the nodes in each model's ``slots``."""
    trees = [Tree.empty(settings.depth) for _ in range(models)]
    parents: list[dict[int, np.ndarray]] = [{} for _ in trees]   # histograms of nodes that were split
    open_: list[list[int]] = [[0] for _ in trees]
    for _ in range(settings.depth):
        # Of two siblings the one with fewer rows is counted. The leaves of the last level need no histograms.
        counted = [[n for n in nodes if n == 0 or n == _smaller(tree, n)] for nodes, tree in zip(open_, trees)]
        if not any(counted):
            break
        slots = [{n: i for i, n in enumerate(c)} for c in counted]
        sums = sums_of(trees, slots).arrays
        for m, tree in enumerate(trees):
            hists = {n: sums[m][i] for n, i in slots[m].items()}
            for n in open_[m]:
                if n not in hists:
                    sibling = n + 1 if n % 2 else n - 1
                    hists[n] = parents[m][(n - 1) // 2] - hists[sibling]
            parents[m], open_[m] = _split(tree, open_[m], hists, columns[m], settings)
    return trees


class _Sums:
    """Arrays that are added one by one."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays = arrays

    def __add__(self, other: _Sums) -> _Sums:
        return _Sums([a + b for a, b in zip(self.arrays, other.arrays)])


def _smaller(tree: Tree, node: int) -> int:
    """Of ``node`` and its sibling, the one with the smaller sum of Hessians, which ``gain`` holds until the node is looked at."""
    sibling = node + 1 if node % 2 else node - 1
    low, high = min(node, sibling), max(node, sibling)
    return low if tree.gain[low] <= tree.gain[high] else high


def _split(tree: Tree, nodes: list[int], hists: dict[int, np.ndarray], columns: np.ndarray, settings: Boosting) -> tuple[dict[int, np.ndarray], list[int]]:
    """Split what gains, set the values of the children; the split nodes' histograms, and the children to look at next."""
    kept: dict[int, np.ndarray] = {}
    opened: list[int] = []
    if not nodes:
        return kept, opened
    stack = np.stack([hists[n] for n in nodes])
    gains, column, bin_ = best_splits(stack, settings)
    for node, hist, gain, c, b in zip(nodes, stack, gains, column, bin_):
        if node == 0:
            tree.value[0] = _step(hist[0].sum(axis=0), settings)
        tree.gain[node] = 0.0
        if gain <= 1e-12:
            continue
        tree.feature[node], tree.last[node], tree.gain[node] = columns[c], b, gain
        left = hist[c, :b + 1].sum(axis=0)
        for child, s in ((2 * node + 1, left), (2 * node + 2, hist[c].sum(axis=0) - left)):
            tree.value[child] = _step(s, settings)
            tree.gain[child] = s[1]
            opened.append(child)
        kept[node] = hist
    if opened and opened[0] >= 2 ** settings.depth - 1:
        tree.gain[opened] = 0.0   # leaves of the last level
    return kept, opened


def _step(sums: np.ndarray, settings: Boosting) -> float:
    """Newton step of a leaf, scaled by the rate."""
    return float(-settings.rate * sums[0] / (sums[1] + settings.l2))


def feature_columns(names: Sequence[str], wanted: Sequence[str]) -> tuple[int, ...]:
    at = {n: i for i, n in enumerate(names)}
    return tuple(at[n] for n in wanted)


def part_column(values: Sequence[Column]) -> Column:
    """Number of the first condition that holds; -1 for none."""
    out = F.lit(-1)
    for i, condition in reversed(list(enumerate(values))):
        out = F.when(condition, F.lit(i)).otherwise(out)
    return out
