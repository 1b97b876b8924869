"""Path-dependent Shapley values of a boosted tree ensemble.

The margin of the ensemble is a sum over leaves. A leaf contributes its value times, for
every feature on its path, an indicator (the row satisfies the path's conditions on the
feature) or, where the feature is absent, the share of training rows that do. That is a
product game, whose Shapley value has a closed form over the few features of one path, so
no recursion over the tree is needed and whole batches of rows are one array expression.

A tree's cuts divide the features into few cells, in each of which its attributions are the
same. They are worked out once a cell, so a row takes one look-up a tree. Trees of more
cells than ``CELLS``, and rows with a value that isn't finite, go through the leaves.

The tables are small by construction (of the size of the trees) and go to the tasks with the
function; rows are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradpath.operators.attribution import impact_array
from gradpath.operators.trees import Trees
from gradpath.schema import FEATURES

CHUNK = 512  # rows per array expression, to bound a task's memory
#: Cells of one tree, and of all together, whose attributions are held at most.
CELLS, ALL_CELLS = 1 << 13, 1 << 20


@dataclass
class LeafGroup:
    """Leaves whose paths use the same number of features, as aligned arrays."""

    value: np.ndarray  # (leaves,)
    feature: np.ndarray  # (leaves, d)
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves_of(nodes: dict[int, dict], weight: float) -> list[tuple]:
    """(value, {feature: (low, high, share)}) per leaf of one tree, root first."""
    out = []
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["left"] < 0:
            out.append((weight * node["prediction"], path))
            continue
        f, cut = node["feature"], node["threshold"]
        for child, is_left in ((node["left"], True), (node["right"], False)):
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            part = nodes[child]["cover"] / node["cover"]
            bound = (low, min(high, cut)) if is_left else (max(low, cut), high)
            todo.append((child, {**path, f: (*bound, share * part)}))
    return out


def group_leaves(leaves: list[tuple]) -> tuple[list[LeafGroup], float]:
    """Leaf groups by path width, and the expected margin."""
    by_width: dict[int, list] = {}
    base = 0.0
    for value, path in leaves:
        base += value * float(np.prod([s for _, _, s in path.values()]))
        if path:
            by_width.setdefault(len(path), []).append((value, path))
    groups = []
    for members in by_width.values():
        pick = lambda i: np.array([[b[i] for b in p.values()] for _, p in members])
        groups.append(
            LeafGroup(
                np.array([v for v, _ in members]), np.array([list(p) for _, p in members]), pick(0), pick(1), pick(2)
            )
        )
    return groups, base


def shapley(x: np.ndarray, groups: list[LeafGroup]) -> np.ndarray:
    """(rows, features) attributions of a block of rows."""
    phi = np.zeros_like(x)
    for g in groups:
        d = g.feature.shape[1]
        vals = x[:, g.feature]
        one = ((vals > g.low) & (vals <= g.high)).astype(float)
        weights = [factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)]
        for i in range(d):
            # coefficients, by coalition size, of the product over the other features
            poly = [np.ones(one.shape[:2])]
            for j in range(d):
                if j == i:
                    continue
                absent, present = g.share[:, j], one[:, :, j]
                poly = [
                    (poly[s] * absent if s < len(poly) else 0.0) + (poly[s - 1] * present if s > 0 else 0.0)
                    for s in range(len(poly) + 1)
                ]
            total = sum(w * c for w, c in zip(weights, poly))
            gain = g.value * (one[:, :, i] - g.share[:, i]) * total
            columns = np.zeros((len(g.value), x.shape[1]))
            columns[np.arange(len(g.value)), g.feature[:, i]] = 1.0
            phi += gain @ columns
    return phi


@dataclass
class Cells:
    """Attributions of trees by the cell a row is in."""

    cuts: list[np.ndarray]  # of each feature, of all trees together, ascending
    steps: list[np.ndarray]  # (intervals between the cuts, trees): what a feature's interval adds to the place of the cell
    phi: np.ndarray  # (cells, features), tree after tree
    first: np.ndarray  # the place of each tree's first cell

    def of(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) attributions of a block of finite rows."""
        place = np.tile(self.first, (len(x), 1))
        for f, cuts in enumerate(self.cuts):
            if len(cuts):
                place += self.steps[f][np.searchsorted(cuts, x[:, f], "left")]
        out = np.zeros((len(x), self.phi.shape[1]))
        for tree in place.T:
            out += self.phi[tree]
        return out


def cells_of(trees: list[list[tuple]], features: int) -> tuple[Cells, list[tuple]]:
    """Cells of the trees, given by their leaves, and the leaves of the trees that have too many."""
    own, rest, total = [], [], 0
    for leaves in trees:
        cuts = [np.unique([b for _, path in leaves for g, (low, high, _) in path.items() if g == f for b in (low, high) if np.isfinite(b)]) for f in range(features)]
        size = int(np.prod([len(c) + 1.0 for c in cuts]))
        if size > CELLS or total + size > ALL_CELLS:
            rest += leaves
        else:
            own.append((leaves, cuts))
            total += size
    joint = [np.unique(np.concatenate([np.zeros(0), *(cuts[f] for _, cuts in own)])) for f in range(features)]
    steps = [np.zeros((len(c) + 1, len(own)), np.int64) for c in joint]
    tables, first = [np.zeros((0, features))], np.zeros(len(own), np.int64)
    for t, (leaves, cuts) in enumerate(own):
        first[t] = sum(map(len, tables))
        sizes = [len(c) + 1 for c in cuts]
        # an interval holds its upper end
        inside = np.meshgrid(*[np.append(c, np.inf) for c in cuts], indexing="ij")
        points = np.stack([p.ravel() for p in inside], axis=1)
        groups = group_leaves(leaves)[0]
        tables.append(np.concatenate([shapley(points[i : i + CHUNK], groups) for i in range(0, len(points), CHUNK)]))
        for f in range(features):
            interval = np.searchsorted(cuts[f], np.append(joint[f], np.inf), "left")
            steps[f][:, t] = interval * int(np.prod(sizes[f + 1 :], dtype=np.int64))
    return Cells(joint, steps, np.concatenate(tables), first), rest


@dataclass
class TreeAttribution:
    groups: list[LeafGroup]
    base_value: float
    inputs: Callable[[], Column] | None = None  # the model's inputs from a profile's features
    cells: Cells | None = None  # what the groups give, for the trees of few cells
    others: list[LeafGroup] | None = None  # the groups of the other trees

    @classmethod
    def from_trees(cls, trees: Trees) -> "TreeAttribution":
        """Of an ensemble's margin; what is absent is weighed by the cover of the nodes."""
        each = [leaves_of(trees.nodes(t), 1.0) for t in range(len(trees.feature))]
        groups, base = group_leaves([leaf for leaves in each for leaf in leaves])
        used = max([len(FEATURES) - 1, *(f for leaves in each for _, path in leaves for f in path)]) + 1
        cells, rest = cells_of(each, used)
        return cls(groups, base + trees.start, cells=cells, others=group_leaves(rest)[0])

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) attributions of a matrix of model inputs."""
        out = np.zeros_like(x)
        for i in range(0, len(x), CHUNK):
            block, part = x[i : i + CHUNK], out[i : i + CHUNK]
            known = np.isfinite(block).all(axis=1) if self.cells is not None else np.zeros(len(block), bool)
            if known.any():
                part[known] = self.cells.of(block[known]) + shapley(block[known], self.others)
            if not known.all():
                part[~known] = shapley(block[~known], self.groups)
        return out

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with ``impacts`` and ``base_value``; base plus impacts is the margin."""
        phi = df.withColumn("_phi", self.column(self.inputs()))
        shap = {f: F.col("_phi")[i] for i, f in enumerate(FEATURES)}
        return phi.withColumns({"impacts": impact_array(shap), "base_value": F.lit(self.base_value)}).drop("_phi")

    def column(self, features: Column) -> Column:
        """Array of attributions for an array column of model inputs, in feature order."""
        values = TreeAttribution(self.groups, 0.0, None, self.cells, self.others).values  # what tasks need

        @F.arrow_udf("array<double>")
        def attribute(batch: pa.Array) -> pa.Array:
            x = np.asarray(batch.flatten(), dtype=float).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
            ends = np.arange(len(batch) + 1, dtype=np.int32) * x.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(values(x).ravel()))

        return attribute(features)
