"""Tree ensembles grown together: all learners and all folds share one aggregation a level.

Every feature is cut into quantile bins once, and a row becomes its bin numbers, kept in
blocks that the tasks hold. Growing a level of all trees is one job of one stage: tasks add
up, for each (fit, tree, node, feature, bin), the first-order term, the second-order term and
the number of the rows they hold, Spark sums these over the tasks, and the driver, which
holds sums of the size of the model only, picks the splits. A fit leaves the rows of its held-out fold aside, so five folds and the full
model of each learner cost the jobs of one.

Learners:

* ``forest``: rows weighted by a Poisson number of their key and the tree, a random third of
  the features a node (their square root), splits by Gini impurity, leaves hold class shares;
* ``gradient``: trees on the residuals, splits by their variance, leaves take a Newton step;
* ``newton``: second-order boosting; gain and leaves use gradient and hessian sums with an
  L2 penalty, and a child needs a least hessian.

Terms are summed as whole numbers (24 bits behind the point), so sums, and with them the
trees, do not depend on partitions or their order. Of equal gains the first feature and
the lowest cut win. The log-odds of the boosted fits are kept with the rows; each round adds its
trees to them, and every few rounds the rows are written anew.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradpath.operators.trees import Trees, empty
from gradpath.session import cut_lineage

#: Bins a feature is cut into at most; bin numbers are one byte.
BINS = 64
#: Rounds after which the rows are written with their new log-odds.
KEPT = 10
#: Trees that a forest grows at once.
TOGETHER = 10
UNIT = float(1 << 24)
#: A split that gains no more than this is none.
LEAST_GAIN = 1e-9
#: Bytes of a level's sums up to which the driver adds up those of all tasks.
DIRECT = 1 << 22
#: (row, tree) pairs of a level that are worth a task of their own.
SHARE = 1 << 16


@dataclass(frozen=True)
class Learner:
    """One kind of ensemble. ``least`` is the hessian that a child needs."""

    kind: str
    trees: int
    depth: int
    rate: float = 1.0
    l2: float = 0.0
    least: float = 0.0


@dataclass(frozen=True)
class Fit:
    """A learner trained on all rows but those of fold ``held``."""

    learner: Learner
    held: int | None = None


def cut_points(df: DataFrame, x: str, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each place of the array ``x``: half way between all its values if they are
    no more than ``bins``, else at quantiles."""
    seen = df.select(F.posexplode(x).alias("at", "v"))
    values = seen.filter("v is not null").distinct()
    few = cut_lineage(values.groupBy("at").agg(F.count("*").alias("n"))).collect()  # a row a column
    small = [r["at"] for r in few if r["n"] <= bins]
    cuts = [np.zeros(0) for _ in range(features)]
    if small:
        for r in values.filter(F.col("at").isin(small)).groupBy("at").agg(F.sort_array(F.collect_set("v")).alias("v")).collect():  # bins values a column
            v = np.array(r["v"])
            cuts[r["at"]] = (v[1:] + v[:-1]) / 2
    large = [r["at"] for r in few if r["n"] > bins]
    if large:
        shares = [k / bins for k in range(1, bins)]
        found = df.agg(*[F.percentile_approx(F.col(x)[i], shares, 100_000).alias(f"q{i}") for i in large]).first()
        for i in large:
            cuts[i] = np.unique(np.array(found[f"q{i}"], float))
    return cuts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)]))


def poisson_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree; fixed by its key."""
    mixed = _mixed(key.view(np.uint64) + _mixed(np.array([(seed << 20) + tree + 1], np.uint64)))
    return np.searchsorted(POISSON, (mixed >> np.uint64(11)).astype(float) / 2.0**53, "right")


#: A block of rows: key, label, fold, bins (features x rows), log-odds (boosted fits x rows).
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _down(tree: tuple[list[np.ndarray], list[np.ndarray]], b: np.ndarray) -> np.ndarray:
    """The place in its level that each row of ``b`` (features x rows) reaches, as many levels down as given."""
    at, row, flat = np.zeros(b.shape[1], np.int64), np.arange(b.shape[1]), b.ravel()
    for feature, place in zip(*tree):
        at = 2 * at + (flat[feature[at] * b.shape[1] + row] > place[at])
    return at


def _written(rows: RDD, spark: SparkSession) -> RDD:
    """The blocks, written to the shared folder and read again."""
    df = spark.createDataFrame(rows.map(lambda block: (bytearray(pickle.dumps(block)),)), "block binary")
    return _blocks(df)


def _blocks(df: DataFrame) -> RDD:
    return cut_lineage(df).rdd.map(lambda r: pickle.loads(r[0]))


@dataclass
class _Growing:
    """A tree under construction: which fit, which of its trees, nodes that may still be split."""

    fit: int
    tree: int
    open_: list[int]


class Grower:
    """Grows ``fits`` on rows (key bigint, label, fold, x array of features)."""

    def __init__(self, rows: DataFrame, cuts: list[np.ndarray], fits: list[Fit], seed: int = 42, kept: int = KEPT):
        self.cuts, self.fits, self.seed, self.kept = cuts, fits, seed, kept
        self.bins = max((len(c) for c in cuts), default=0) + 1
        self.boosted = [i for i, f in enumerate(fits) if f.learner.kind != "forest"]
        shares = {r["fold"]: (r["n"], r["ones"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()}  # a row a fold
        self.chosen: dict[tuple[int, int], np.ndarray] = {}
        self.trees = []
        for f in fits:
            n, ones = (sum(v[k] for fold, v in shares.items() if fold != f.held) for k in (0, 1))
            prior = np.log(ones / (n - ones)) if f.learner.kind == "gradient" and 0 < ones < n else 0.0
            self.trees.append(empty(f.learner.trees, 2 ** (f.learner.depth + 1) - 1, float(prior), f.learner.kind == "forest"))
        self.places = [np.zeros(t.cut.shape) for t in self.trees]  # the cuts as bin numbers
        starts = np.array([self.trees[i].start for i in self.boosted])

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(len(batch), len(cuts))
                b = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8)
                m = np.tile(starts[:, None], (1, len(batch)))
                block = np.array(batch.column("key")), np.asarray(batch.column("y")).astype(float), np.array(batch.column("fold")), b, m
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

        self.spark = rows.sparkSession
        typed = rows.select(F.col("key").cast("bigint"), F.col("y").cast("int"), F.col("fold").cast("int"), "x")
        # a level has no more tasks than its rows and trees are worth, since it lasts as long as its job takes to start
        together = sum(min(TOGETHER, f.learner.trees) if f.learner.kind == "forest" else 1 for f in fits)
        worth = -(-sum(n for n, _ in shares.values()) * together // SHARE)
        dealt = typed.repartition(max(min(self.spark.sparkContext.defaultParallelism, worth), 1))
        self.state = _blocks(dealt.mapInArrow(coded, "block binary")).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None  # what the rows come from until they are computed

    def close(self) -> None:
        self._forget()
        self.state.unpersist()

    def _forget(self) -> None:
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def _levels(self, fit: int, tree: int, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(features, bin numbers) of the upper levels of a tree; a row in a leaf goes left."""
        feature, place = self.trees[fit].feature[tree], self.places[fit][tree]
        parts = [slice(2**k - 1, 2 ** (k + 1) - 1) for k in range(depth)]
        return [np.maximum(feature[p], 0).astype(np.int64) for p in parts], [np.where(feature[p] >= 0, place[p], 255).astype(np.uint8) for p in parts]

    def _level(self, growing: list[_Growing], level: int) -> np.ndarray:
        """(slot, feature, bin, 3) sums of the open nodes, slots numbered through all growing trees."""
        features, bins, seed = len(self.cuts), self.bins, self.seed
        of, tasks, slots = {i: k for k, i in enumerate(self.boosted)}, [], 0
        for g in growing:
            slot = np.full(2**level, len(g.open_))  # rows outside the open nodes go to one slot more
            slot[np.array(g.open_) - (2**level - 1)] = np.arange(len(g.open_))
            used = np.flatnonzero(np.any([self._allowed(g, node) for node in g.open_], axis=0))
            tasks.append((self._levels(g.fit, g.tree, level), slot, slots, len(g.open_), self.fits[g.fit].held, of.get(g.fit), g.tree, used))
            slots += len(g.open_)

        def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
            total = np.zeros((slots, features, bins, 3))
            for key, y, fold, b, m in blocks:
                drawn = {}
                for tree, slot, first, count, held, column, number, used in tasks:
                    at = slot[_down(tree, b)]
                    if held is not None:
                        at[fold == held] = count
                    if column is None:
                        if number not in drawn:
                            drawn[number] = poisson_weights(key, number, seed).astype(float)
                        n = drawn[number]
                        terms = [np.round(n * y * UNIT), np.round(n * UNIT), n]
                    else:
                        p = 1 / (1 + np.exp(-m[column]))
                        terms = [np.round((y - p) * UNIT), np.round(p * (1 - p) * UNIT), None]
                    at *= bins
                    for f in used:
                        cell = at + b[f]
                        for k, term in enumerate(terms):
                            total[first : first + count, f, :, k] += np.bincount(cell, term, (count + 1) * bins)[: count * bins].reshape(count, bins)
            yield total.astype(np.int64)

        summed = self.state.mapPartitions(run)
        # small sums are added up in the driver, large ones by tasks first
        size = slots * features * bins * 24
        # open nodes x features x bins, whatever the number of rows
        got = summed.treeReduce(np.add, depth=2) if size > DIRECT else sum(summed.collect())
        self._forget()
        return got / np.array([UNIT, UNIT, 1.0])

    def _split(self, growing: list[_Growing], sums: np.ndarray) -> None:
        """Splits the open nodes where that gains anything; the children become the open ones."""
        nodes = [(g, node) for g in growing for node in g.open_]
        kinds = [self.fits[g.fit].learner for g, _ in nodes]
        allowed = np.array([self._allowed(g, node) for g, node in nodes])
        any_ = allowed.argmax(axis=1)  # one that was added up
        feature, place, gain = best_splits(sums, kinds, allowed)
        for g in growing:
            g.open_ = []
        for k, (g, node) in enumerate(nodes):
            t, learner, tree = self.trees[g.fit], kinds[k], g.tree
            whole = sums[k, any_[k]].sum(axis=0)
            if not node:
                self._set(t, learner, tree, 0, whole)
            if gain[k] <= LEAST_GAIN:
                continue
            left = sums[k, feature[k], : place[k] + 1].sum(axis=0)
            t.feature[tree, node], t.cut[tree, node], t.gain[tree, node] = feature[k], self.cuts[feature[k]][place[k]], gain[k]
            self.places[g.fit][tree, node] = place[k]
            for child, part in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                self._set(t, learner, tree, child, part)
                g.open_.append(child)

    def _allowed(self, g: _Growing, node: int) -> np.ndarray:
        """Which features a node may be split by: all, or the square root of their number for forests."""
        n = len(self.cuts)
        if self.fits[g.fit].learner.kind != "forest":
            return np.ones(n, bool)
        if (g.tree, node) not in self.chosen:  # the same for the fits of all folds
            chosen = np.random.default_rng([self.seed, g.tree, node]).permutation(n)[: max(int(np.sqrt(n)), 1)]
            self.chosen[g.tree, node] = np.isin(np.arange(n), chosen)
        return self.chosen[g.tree, node]

    @staticmethod
    def _set(t: Trees, learner: Learner, tree: int, node: int, sums: np.ndarray) -> None:
        a, h, n = sums
        below = n if learner.kind == "forest" else h + learner.l2
        t.value[tree, node] = learner.rate * a / below if below > 0 else 0.0
        t.cover[tree, node], t.rows[tree, node] = (h if learner.kind == "newton" else n), int(n)

    def _margins(self, r: int) -> None:
        """The rows with what the trees of round ``r`` add to their log-odds. They are computed by the
        next level's job, and written every ``kept`` rounds, which keeps their lineage short."""
        added = []
        for k, i in enumerate(self.boosted):
            learner, trees = self.fits[i].learner, self.trees[i]
            if r < learner.trees:
                value = trees.value[r].copy()
                for node in np.flatnonzero(trees.feature[r, : 2**learner.depth - 1] < 0):
                    value[2 * node + 1] = value[node]  # rows in a leaf go left
                added.append((k, self._levels(i, r, learner.depth), value[2**learner.depth - 1 :]))

        def run(block: Block) -> Block:
            m = block[4].copy()
            for k, tree, value in added:
                m[k] += value[_down(tree, block[3])]
            return *block[:4], m

        self._forget()
        moved = self.state.map(run)
        if (r + 1) % self.kept == 0:
            moved = _written(moved, self.spark)
        self.before, self.state = self.state, moved.persist(StorageLevel.MEMORY_AND_DISK)

    def grow(self) -> list[Trees]:
        """All trees of all fits."""
        rounds = max([self.fits[i].learner.trees for i in self.boosted] + [-(-f.learner.trees // TOGETHER) for f in self.fits if f.learner.kind == "forest"], default=0)
        for r in range(rounds):
            growing = []
            for i, f in enumerate(self.fits):
                now = range(r * TOGETHER, (r + 1) * TOGETHER) if f.learner.kind == "forest" else (r,)
                growing += [_Growing(i, k, [0]) for k in now if k < f.learner.trees]
            level = 0
            while growing:
                self._split(growing, self._level(growing, level))
                level += 1
                growing = [g for g in growing if g.open_ and level < self.fits[g.fit].learner.depth]
            if self.boosted and r + 1 < rounds:
                self._margins(r)
        return self.trees


def best_splits(sums: np.ndarray, kinds: list[Learner], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin on the left, gain) of each node from its (feature, bin, 3) sums."""
    second = np.array([k.kind == "newton" for k in kinds])[:, None, None]
    l2, least = (np.array([getattr(k, c) if k.kind == "newton" else 0.0 for k in kinds])[:, None, None] for c in ("l2", "least"))
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:]
    right = whole - left

    def score(s: np.ndarray) -> np.ndarray:
        below = np.where(second, s[..., 1] + l2, s[..., 2])
        return s[..., 0] * s[..., 0] / np.where(below > 0, below, 1)

    gain = score(left) + score(right) - score(whole)
    enough = (left[..., 2] > 0) & (right[..., 2] > 0) & allowed[:, :, None] & (left[..., 1] >= least) & (right[..., 1] >= least)
    gain = np.where(enough, gain, -np.inf).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    return at // sums.shape[2], at % sums.shape[2], gain[np.arange(len(at)), at]


def grow(rows: DataFrame, cuts: list[np.ndarray], fits: list[Fit], seed: int = 42, kept: int = KEPT) -> list[Trees]:
    """The ensembles of ``fits`` on ``rows`` (key bigint, y, fold, x)."""
    grower = Grower(rows, cuts, fits, seed, kept)
    try:
        return grower.grow()
    finally:
        grower.close()
