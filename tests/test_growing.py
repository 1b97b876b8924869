"""Tree ensembles grown together, against plain recursive versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradpath.operators import growing as gw
from gradpath.operators.growing import Fit, Learner
from gradpath.operators.trees import Trees

NEWTON, GRADIENT, FOREST = Learner("newton", 3, 3, 0.3, 1.0, 1.0), Learner("gradient", 3, 3, 0.1), Learner("forest", 4, 4)


def table(spark, n=240, seed=3, parts=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 2, n), np.round(rng.normal(size=n), 1), rng.normal(size=n)], axis=1)
    y = (x[:, 0] + 2 * x[:, 1] + x[:, 2] + rng.normal(size=n) > 6).astype(int)
    data = [(i * 7919, int(y[i]), int(rng.integers(0, 3)), [float(v) for v in x[i]]) for i in range(n)]
    return data, spark.createDataFrame(data, "key bigint, y int, fold int, x array<double>").repartition(parts)


def plain_tree(x, terms, learner, cuts, depth, kind, at=0, level=0):
    """{node: (feature, cut, value, rows)} by recursion over the rows of each node."""
    a, h, n = (t.sum() for t in terms)
    below = h + learner.l2 if kind == "newton" else (n if kind == "forest" else h)
    out, best = {at: (-1, 0.0, learner.rate * a / below if below else 0.0, int(n))}, (1e-9, None)
    if level == depth:
        return out
    score = lambda s, m: s[0][m].sum() ** 2 / d if (d := (s[1][m].sum() + learner.l2 if kind == "newton" else s[2][m].sum())) > 0 else 0.0
    every = np.ones(len(x), bool)
    for f, c in enumerate(cuts):
        for cut in c:
            left = x[:, f] <= cut
            if not terms[2][left].sum() or not terms[2][~left].sum():
                continue
            if kind == "newton" and min(terms[1][left].sum(), terms[1][~left].sum()) < learner.least:
                continue
            gain = score(terms, left) + score(terms, ~left) - score(terms, every)
            if gain > best[0] + 1e-12:
                best = (gain, (f, cut, left))
    if best[1] is None:
        return out
    f, cut, left = best[1]
    out[at] = (f, cut, *out[at][2:])
    for child, m in ((2 * at + 1, left), (2 * at + 2, ~left)):
        out |= plain_tree(x[m], [t[m] for t in terms], learner, cuts, depth, kind, child, level + 1)
    return out


def plain_boosting(x, y, learner, cuts):
    ones = y.sum()
    margin = np.full(len(y), math.log(ones / (len(y) - ones)) if learner.kind == "gradient" else 0.0)
    trees = []
    for _ in range(learner.trees):
        p = 1 / (1 + np.exp(-margin))
        tree = plain_tree(x, [y - p, p * (1 - p), np.ones(len(y))], learner, cuts, learner.depth, learner.kind)
        for i, row in enumerate(x):
            at = 0
            while tree[at][0] >= 0:
                at = 2 * at + 1 + (row[tree[at][0]] > tree[at][1])
            margin[i] += tree[at][2]
        trees.append(tree)
    return trees, margin


@pytest.mark.parametrize("learner", [NEWTON, GRADIENT])
@pytest.mark.parametrize("bins", [64, 6])
def test_three_rounds_against_recursion(spark, learner, bins):
    data, df = table(spark)
    cuts = gw.cut_points(df, "x", 4, bins)
    assert all(len(c) < bins for c in cuts)
    got = gw.grow(df, cuts, [Fit(learner)])[0]
    x, y = np.array([r[3] for r in data]), np.array([r[1] for r in data])
    trees, margin = plain_boosting(x, y, learner, cuts)
    for t, tree in enumerate(trees):
        assert set(got.nodes(t)) == set(tree)
        for node, (feature, cut, value, rows) in tree.items():
            assert got.feature[t, node] == feature and got.rows[t, node] == rows
            assert got.value[t, node] == pytest.approx(value, abs=1e-5) and (feature < 0 or got.cut[t, node] == cut)
    assert np.allclose(got.margin(x), margin, atol=1e-5)


def same(a: Trees, b: Trees) -> bool:
    return all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "cut", "value", "cover", "rows"))


def test_folds_grown_together_equal_fits_of_their_own(spark):
    """Also whatever the partitions, and however often the log-odds are written."""
    data, df = table(spark)
    cuts = gw.cut_points(df, "x", 4)
    fits = [Fit(learner, held) for learner in (FOREST, GRADIENT, NEWTON) for held in (None, 0, 1, 2)]
    together = gw.grow(df, cuts, fits, kept=2)
    for fit, trees in zip(fits, together):
        rest = df.filter(F.col("fold") != fit.held) if fit.held is not None else df
        alone = gw.grow(rest.repartition(5), cuts, [Fit(fit.learner)])[0]
        assert same(trees, alone), fit
        assert trees.rows[0, 0] == rest.count() or fit.learner.kind == "forest"


def test_forest_against_recursion_over_drawn_rows(spark, monkeypatch):
    monkeypatch.setattr(gw.Grower, "_allowed", lambda self, g, node: np.ones(4, bool))
    data, df = table(spark)
    cuts = gw.cut_points(df, "x", 4, 10)
    got = gw.grow(df, cuts, [Fit(FOREST)])[0]
    x, y, key = np.array([r[3] for r in data]), np.array([r[1] for r in data]), np.array([r[0] for r in data])
    for t in range(FOREST.trees):
        w = gw.poisson_weights(key, t, 42).astype(float)
        tree = plain_tree(x, [w * y, w, w], FOREST, cuts, FOREST.depth, "forest")
        assert {i: (n["feature"], round(n["prediction"], 6)) for i, n in got.nodes(t).items()} == {i: (v[0], round(v[2], 6)) for i, v in tree.items()}
    assert np.all((got.probability(x) >= 0) & (got.probability(x) <= 1))


def test_poisson_weights_have_mean_and_variance_one():
    w = gw.poisson_weights(np.arange(200_000, dtype=np.int64), 7, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w, gw.poisson_weights(np.arange(200_000, dtype=np.int64), 8, 42))[0, 1]) < 0.01


def test_one_class_one_row_and_constant_features(spark):
    schema = "key bigint, y int, fold int, x array<double>"
    for data in ([(1, 1, 0, [1.0, 2.0])], [(k, 0, 0, [1.0, 2.0]) for k in range(5)], [(k, k % 2, 0, [1.0, 2.0]) for k in range(6)]):
        df = spark.createDataFrame(data, schema)
        for trees in gw.grow(df, gw.cut_points(df, "x", 2), [Fit(learner) for learner in (FOREST, GRADIENT, NEWTON)]):
            assert np.isfinite(trees.probability(np.array([[1.0, 2.0]]))).all() and (trees.feature == -1).all()


def test_a_level_is_one_job_of_one_stage_without_a_shuffle(spark):
    """Hundreds of levels follow each other, so what a job costs decides how long a training takes."""
    _, df = table(spark)
    grower, jobs = gw.Grower(df, gw.cut_points(df, "x", 4), [Fit(NEWTON), Fit(GRADIENT)]), []
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    try:
        grower.state.count()
        sc.setJobGroup("grow-levels", "levels")
        grower.grow()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("grow-levels")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        grower.close()
    assert 0 < len(jobs) <= 3 * 3 and all(len(j.stageIds) <= 2 for j in jobs)


def test_a_level_has_no_more_tasks_than_it_is_worth(spark, monkeypatch):
    data, df = table(spark)
    cuts = gw.cut_points(df, "x", 4, 8)
    grown = []
    for share, parts in ((gw.SHARE, 1), (len(data) * 2 // 3, 2)):
        monkeypatch.setattr(gw, "SHARE", share)
        grower = gw.Grower(df, cuts, [Fit(NEWTON)])
        assert grower.state.getNumPartitions() == parts
        grown.append(grower.grow()[0])
        grower.close()
    assert np.array_equal(grown[0].cut, grown[1].cut) and np.array_equal(grown[0].value, grown[1].value)
