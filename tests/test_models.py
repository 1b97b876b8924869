"""Trained models: stack, bundle, Shapley values, the plain variant."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradpath.catalog import model_queries as mq
from gradpath.operators import balance as ba
from gradpath.operators import treeshap as ts
from gradpath.operators.growing import Fit, cut_points, grow
from gradpath.operators.models import Settings, fit_booster, fit_preprocessor, fit_stack, learners, safe_score, training_rows
from gradpath.operators.scoring import score
from gradpath.operators.validate import encode
from gradpath.plans import train as tr
from gradpath.plans import answers
from gradpath.schema import FEATURES, LABEL
from gradpath.sources.views import load

D = "/root/testdata/sf0.001"
TINY = Settings(forest_trees=4, forest_depth=3, rounds=3, folds=2)
EDGE = "job string, skill string, ord_row bigint, ord_pos int"


@pytest.fixture(scope="module")
def profiles(spark):
    return load(spark, D, "unbalanced").cache()


@pytest.fixture(scope="module")
def bundle(spark, profiles):
    edges = spark.createDataFrame([("J", "T1", 0, 0), ("J", "T2", 0, 1)], EDGE)
    return tr.train(profiles, edges, TINY)


def coded(bundle, profiles):
    return encode(profiles, bundle.gender, bundle.stream)


def test_full_size_is_the_default():
    s = Settings()
    assert (s.forest_trees, s.forest_depth, s.rounds, s.gradient_rate, s.gradient_depth, s.booster_depth, s.folds, s.seed) == (100, 5, 100, 0.1, 3, 4, 5, 42)


def test_report_counts(bundle, profiles):
    r = bundle.report
    assert r["true_pos"] + r["false_pos"] + r["true_neg"] + r["false_neg"] == r["n"]
    assert r["n"] == ba.split(profiles).filter("not in_train").count()
    assert r["accuracy"] > 0.5


def test_the_report_has_the_base_value_of_the_booster(spark, bundle, profiles, monkeypatch):
    """What the booster's trees are expected to add, node by node, weighed by cover."""
    held = tr.balanced_split(coded(bundle, profiles).select("id", *FEATURES, LABEL))[1]
    monkeypatch.setattr(mq, "bundle", lambda spark, d: bundle)
    monkeypatch.setattr(mq, "training", lambda spark, d: (None, held))
    model = bundle.booster.model

    def expected(nodes, at=0):
        node = nodes[at]
        if node["left"] < 0:
            return node["prediction"]
        return sum(nodes[c]["cover"] / node["cover"] * expected(nodes, c) for c in (node["left"], node["right"]))

    base = model.start + sum(expected(model.nodes(t)) for t in range(len(model.feature)))
    got = {r["item"]: r["value"] for r in mq.train_report(spark, D).collect()}
    assert got["base_value"] == pytest.approx(base, abs=1e-6)
    counts = {c: bundle.report[c] for c in ("n", "true_pos", "false_pos", "true_neg", "false_neg", "accuracy")}
    assert got == {**counts, "base_value": got["base_value"], "jobs": 1, "skills": 2, "nodes": 3, "edges": 2}


def test_balancing_before_and_after_the_split(bundle, profiles):
    rows = coded(bundle, profiles).select("id", *FEATURES, LABEL)
    counts = lambda df: {r[LABEL]: r["count"] for r in df.groupBy(LABEL).count().collect()}
    train, test = tr.balanced_split(rows)
    c = counts(train)
    assert c[0] == c[1] and test.filter("copy > 0").count() == 0
    train, test = tr.balanced_split(rows, "reference")
    both = counts(train.unionByName(test))
    assert both[0] == both[1] and test.filter("copy > 0").count() > 0


def test_out_of_fold_covers_every_row_once(bundle, profiles):
    """Each row once, with the chances that ensembles fitted without its fold alone give."""
    rows = coded(bundle, profiles).withColumn("copy", F.lit(0))
    fitted = fit_stack(rows, "id", TINY)
    oof = {r["key"]: r for r in fitted.oof.collect()}
    data = training_rows(ba.assign_folds(rows, TINY.folds), "id", fitted.model.preprocessor).collect()
    assert fitted.oof.count() == len(data) == len(oof)
    table = rows.sparkSession.createDataFrame(data)
    cuts = cut_points(table, "x", len(FEATURES))
    for fold in range(TINY.folds):
        held = [r for r in data if r["fold"] == fold]
        rest = table.filter(F.col("fold") != fold)
        for name, learner in learners(TINY).items():
            p = grow(rest, cuts, [Fit(learner)])[0].probability(np.array([r["x"] for r in held]))
            assert [oof[r["key"]][f"p_{name}"] for r in held] == pytest.approx(list(p), abs=1e-12)
        assert {oof[r["key"]]["trained_on"] for r in held} == {rest.count()}


def test_bundle_round_trip(spark, bundle, profiles, tmp_path):
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        tr.load_bundle(spark, path)
    tr.save_bundle(bundle, path)
    again = tr.load_bundle(spark, path)
    assert again.report == bundle.report and again.stream.values == bundle.stream.values
    a = {r["id"]: r["p"] for r in score(coded(bundle, profiles), bundle.stack).collect()}
    b = {r["id"]: r["p"] for r in score(coded(again, profiles), again.stack).collect()}
    assert a == b
    skills = spark.createDataFrame([(r["id"], 0, "T1") for r in profiles.limit(5).collect()], "id bigint, pos int, skill string")
    desired = load(spark, D, "desired")
    assert answers.predict(again.engine(), profiles, skills, desired).count() == profiles.count()


def test_whatif_with_the_trained_model_equals_scoring_the_changed_row(bundle, profiles):
    engine = answers.Engine(bundle.stack, bundle.gender, bundle.stream, None)
    rows = answers.whatif(engine, profiles).collect()
    changed = coded(bundle, profiles).withColumn("Internships", F.col("Internships") + 1)
    want = {r["id"]: round(r["p"] * 100, 6) for r in score(changed, bundle.stack).collect()}
    checked = 0
    for r in rows:
        for s in r["scenarios"]:
            if s["title"] == "Extra Internship":
                assert s["modified_risk"] == pytest.approx(want[r["id"]], abs=1e-5)
                checked += 1
    assert checked > 10


def expectation(nodes, weight, x, known, at=0):
    """Margin of one tree when only the features in ``known`` are fixed, by recursion."""
    n = nodes[at]
    if n["left"] < 0:
        return weight * n["prediction"]
    if n["feature"] in known:
        return expectation(nodes, weight, x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    left, right = nodes[n["left"]], nodes[n["right"]]
    return (left["cover"] * expectation(nodes, weight, x, known, n["left"]) + right["cover"] * expectation(nodes, weight, x, known, n["right"])) / n["cover"]


def random_tree(rng, features, depth, cover):
    nodes = {}

    def grow(level, cover):
        i = len(nodes)
        nodes[i] = {"prediction": float(rng.normal()), "cover": cover, "left": -1, "right": -1, "feature": -1, "threshold": None}
        if level < depth and cover > 3:
            nodes[i].update(feature=int(rng.integers(features)), threshold=float(rng.normal()))
            part = int(rng.integers(1, cover))
            nodes[i]["left"] = grow(level + 1, part)
            nodes[i]["right"] = grow(level + 1, cover - part)
        return i

    grow(0, cover)
    return nodes


def test_shapley_equals_the_sum_over_all_coalitions():
    rng = np.random.default_rng(7)
    m, trees = 4, [(random_tree(rng, 4, 4, 60), w) for w in (1.0, 0.3, 0.3)]
    groups, base = ts.group_leaves([leaf for nodes, w in trees for leaf in ts.leaves_of(nodes, w)])
    x = rng.normal(size=(6, m))
    got = ts.shapley(x, groups)
    value = lambda row, s: sum(expectation(n, w, row, s) for n, w in trees)
    assert base == pytest.approx(value(x[0], set()))
    for r in range(len(x)):
        for i in range(m):
            others = [j for j in range(m) if j != i]
            phi = sum(
                factorial(k) * factorial(m - 1 - k) / factorial(m) * (value(x[r], {*s, i}) - value(x[r], set(s)))
                for k in range(m) for s in combinations(others, k)
            )
            assert got[r, i] == pytest.approx(phi, abs=1e-12)


@pytest.mark.parametrize("cells", [ts.CELLS, 9])
def test_cells_give_what_the_leaves_give(monkeypatch, cells):
    monkeypatch.setattr(ts, "CELLS", cells)
    rng = np.random.default_rng(11)
    trees = [ts.leaves_of(random_tree(rng, 4, depth, 60), 1.0) for depth in (4, 4, 1, 0, 2)]
    groups = ts.group_leaves([leaf for leaves in trees for leaf in leaves])[0]
    found, rest = ts.cells_of(trees, 4)
    assert bool(rest) == (cells == 9)
    x = rng.normal(size=(700, 4))
    cuts = [(f, b) for leaves in trees for _, path in leaves for f, (low, high, _) in path.items() for b in (low, high) if np.isfinite(b)]
    for r, (f, cut) in enumerate(cuts):
        x[r, f] = cut  # on a cut
    x[-4:, 1] = [np.nan, np.inf, -np.inf, 1e300]
    attribution, met, plain = ts.TreeAttribution(groups, 0.0, None, found, ts.group_leaves(rest)[0]), [], ts.shapley
    monkeypatch.setattr(ts, "shapley", lambda x, g: met.append(len(x) * sum(len(i.value) for i in g)) or plain(x, g))
    got = attribution.values(x)
    assert np.allclose(got, plain(x, groups), rtol=0, atol=1e-12)
    if not rest:
        assert sum(met) == 3 * sum(len(g.value) for g in groups)  # only the rows that aren't finite go through the leaves


def test_attribution_adds_up_to_the_margin(bundle, profiles):
    explainer = bundle.attribution()
    out = coded(bundle, profiles).withColumn("x", bundle.booster.inputs()).withColumn("phi", explainer.column(F.col("x"))).select("x", "phi").collect()
    assert len(out) == profiles.count()
    margins = bundle.booster.model.margin(np.array([r["x"] for r in out]))
    for r, margin in zip(out, margins):
        assert explainer.base_value + sum(r["phi"]) == pytest.approx(margin, abs=1e-9)


def test_the_explainer_is_the_booster_fitted_alone(bundle, profiles):
    rows, _ = tr.balanced_split(coded(bundle, profiles).select("id", *FEATURES, LABEL))
    alone = fit_booster(rows, TINY, fit_preprocessor(rows)).model
    assert np.array_equal(alone.feature, bundle.booster.model.feature) and np.array_equal(alone.value, bundle.booster.model.value)


def test_many_variants_in_one_call_equal_one_by_one(bundle, profiles):
    """A sweep of fifty points: each equals the changed row scored on its own."""
    rows = coded(bundle, profiles).limit(40).cache()
    own = {f: F.col(f) for f in FEATURES}
    variants = {f"v{k}": {**own, "CGPA": F.lit(k / 5), "Internships": F.lit(k % 4)} for k in range(50)}
    got = {r["id"]: r for r in bundle.stack.score_many(rows, variants).collect()}
    for k in (0, 7, 23, 49):
        changed = rows.withColumn("CGPA", F.lit(k / 5)).withColumn("Internships", F.lit(k % 4))
        for r in score(changed, bundle.stack).collect():
            assert got[r["id"]][f"v{k}"] == r["p"]


def test_a_save_that_fails_leaves_the_old_version(spark, bundle, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    first = tr.save_bundle(bundle, path)
    calls = []

    def fail(df):
        calls.append(df)
        if len(calls) == 3:  # in the midst of the parts
            raise RuntimeError("lost")
        return 0, 0

    with monkeypatch.context() as m:
        m.setattr(tr, "_checksum", fail)
        with pytest.raises(RuntimeError):
            tr.save_bundle(tr.Bundle(bundle.stack, bundle.booster, bundle.gender, bundle.stream, bundle.edges, {"n": -1}), path)
    assert tr.load_bundle(spark, path).report == bundle.report
    second = tr.save_bundle(tr.Bundle(bundle.stack, bundle.booster, bundle.gender, bundle.stream, bundle.edges, {"n": -2}), path)
    assert tr.load_bundle(spark, path).report == {"n": -2} and tr.load_bundle(spark, path, first).report == bundle.report
    bundle.edges.limit(1).write.mode("append").parquet(f"{path}/{second}/edges")
    with pytest.raises(ValueError, match="edges of the model bundle"):
        tr.load_bundle(spark, path)
    with pytest.raises(FileNotFoundError):
        tr.load_bundle(spark, path, "v-unknown")


def test_plain_variant_scores_unusable_rows_zero(spark, bundle, profiles):
    model = fit_booster(coded(bundle, profiles), TINY, scale=False)
    assert len(model.preprocessor.stages) == 1
    schema = "id bigint, Age int, Gender string, Stream string, Internships int, CGPA double, Hostel int, HistoryOfBacklogs int"
    df = spark.createDataFrame([(1, 20, "Male", "Civil", 2, 8.0, 1, 0), (2, 20, "Other", "Civil", 2, 8.0, 1, 0), (3, 20, "Male", "Civil", 2, None, 1, 0)], schema)
    got = {r["id"]: r["p"] for r in safe_score(df, model, bundle.gender, bundle.stream).collect()}
    assert got[1] > 0 and got[2] == 0.0 and got[3] == 0.0


def test_a_bundle_explains_with_its_booster(bundle, profiles, spark, tmp_path):
    tr.save_bundle(bundle, str(tmp_path / "b"))
    again = tr.load_bundle(spark, str(tmp_path / "b"))
    attribution = again.attribution()
    margin = score(encode(profiles, again.gender, again.stream), again.booster).select("id", F.log(F.col("p") / (1 - F.col("p"))).alias("m"))
    for sign in ("additive", "reference"):
        done = answers.explain(again.engine(), profiles, attribution, sign, k=None)
        got = done.join(margin, "id").collect()
        assert len(got) == profiles.count()
        for r in got:
            assert len(r["factors"]) == 7
            total = r["base_value"] + sum(f["impact"] for f in r["factors"])
            assert abs(total - r["prediction_value"]) < 2e-3
            if sign == "additive":
                assert abs(r["prediction_value"] - r["m"]) < 2e-3


def test_from_csv_to_answers(spark, profiles, tmp_path):
    from gradpath.sources import readers

    profiles.drop("id").coalesce(1).write.csv(str(tmp_path / "p"), header=True)
    read = readers.read_profiles(spark, str(tmp_path / "p"))
    edges = spark.createDataFrame([("J", "T1", 0, 0), ("J", "T2", 0, 1)], EDGE)
    tr.save_bundle(tr.train(read, edges, TINY), str(tmp_path / "m"))
    again = tr.load_bundle(spark, str(tmp_path / "m"))
    body = '{"id": 7, "Age": 22, "Gender": "Male", "Stream": "Civil", "Internships": 1, "CGPA": 7.1, "Hostel": 0, "HistoryOfBacklogs": 1, "skills": ["T1"], "desired_role": null}'
    (tmp_path / "r.json").write_text(body + "\n")
    got = answers.answer_all(again.engine(), readers.read_requests(spark, str(tmp_path / "r.json")), again.attribution()).collect()
    assert len(got) == 1 and got[0]["recommended_job"] == "J" and got[0]["missing_skills"] == ["T2"] and got[0]["factors"] and got[0]["scenarios"]
