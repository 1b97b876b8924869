"""Ensembles of binary trees as flat arrays, evaluated for whole blocks of rows.

Nodes lie in heap order: the children of node i are 2 i + 1 and 2 i + 2, so an ensemble is a
few rectangular arrays and a block of rows goes down all trees at once, one step a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: (row, tree) pairs that are followed at once.
BLOCK = 1 << 17


@dataclass
class Trees:
    """One ensemble. ``feature`` is -1 where a tree has a leaf or nothing; a row goes left if its
    feature is at most ``cut``. ``value`` is what a row that ends in the node adds."""

    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # weight of the training rows that a node holds
    rows: np.ndarray  # their number
    start: float = 0.0
    mean: bool = False  # the average of the trees is a probability; else the sum is its log-odds
    gain: np.ndarray | None = None  # what splitting the node gained

    @property
    def depth(self) -> int:
        return int(self.feature.shape[1] + 1).bit_length() - 2

    def ends(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the node in which each row ends."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.intp)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, at]
            down = 2 * at + 1 + (x[row, np.maximum(f, 0)] > self.cut[trees, at])
            at = np.where(f >= 0, down, at)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The start value and what the trees add (their average, for ``mean``)."""
        out = np.full(len(x), self.start)
        trees = np.arange(len(self.feature))
        step = max(BLOCK // max(len(trees), 1), 1)
        for i in range(0, len(x) if len(trees) else 0, step):
            got = self.value[trees, self.ends(x[i : i + step])]
            out[i : i + step] += got.mean(axis=1) if self.mean else got.sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return m if self.mean else 1 / (1 + np.exp(-m))

    def nodes(self, tree: int) -> dict[int, dict]:
        """The nodes of one tree by number, as the attribution takes them."""
        out, todo = {}, [0]
        while todo:
            i = todo.pop()
            inner = self.feature[tree, i] >= 0
            out[i] = {
                "prediction": float(self.value[tree, i]), "cover": float(self.cover[tree, i]), "left": 2 * i + 1 if inner else -1,
                "right": 2 * i + 2 if inner else -1, "feature": int(self.feature[tree, i]), "threshold": float(self.cut[tree, i]) if inner else None,
            }
            todo += [2 * i + 1, 2 * i + 2] if inner else []
        return out

    def to_rows(self, name: str) -> list[tuple]:
        """(ensemble, tree, node, feature, cut, value, cover, rows, gain) of the nodes that exist."""
        return [
            (name, t, i, int(self.feature[t, i]), *(float(a[t, i]) for a in (self.cut, self.value, self.cover)), int(self.rows[t, i]), float(self.gain[t, i]))
            for t in range(len(self.feature)) for i in sorted(self.nodes(t))
        ]

    @classmethod
    def from_rows(cls, rows: list, start: float, mean: bool, trees: int, nodes: int) -> "Trees":
        out = empty(trees, nodes, start, mean)
        for r in rows:
            at = r["tree"], r["node"]
            out.feature[at], out.cut[at], out.value[at], out.cover[at], out.rows[at], out.gain[at] = (r[c] for c in ("feature", "cut", "value", "cover", "rows", "gain"))
        return out


NODE = "ensemble string, tree int, node int, feature int, cut double, value double, cover double, rows bigint, gain double"


def empty(trees: int, nodes: int, start: float = 0.0, mean: bool = False) -> Trees:
    zeros = lambda kind: np.zeros((trees, nodes), kind)
    return Trees(np.full((trees, nodes), -1, np.int32), zeros(float), zeros(float), zeros(float), zeros(np.int64), start, mean, zeros(float))
