"""Validation, encoding, scoring, what-if and attribution on hand-made profiles."""

import math

import pytest
from pyspark.sql import functions as F

from gradpath.functions import bands, numeric, text
from gradpath.operators import attribution as at
from gradpath.operators import validate as va
from gradpath.operators import whatif as wi
from gradpath.operators.scoring import CARD, ExpressionScorer, score, with_bands
from gradpath.plans import answers
from gradpath.schema import FEATURES

PROFILE = "id bigint, Age int, Gender string, Stream string, Internships int, CGPA double, Hostel int, HistoryOfBacklogs int"
STREAMS = ["Civil", "Computer Science", "Electrical", "Information Technology", "Mechanical"]


@pytest.fixture(scope="module")
def labels(spark):
    return va.LabelDictionary.of(spark, "Gender", ["Female", "Male"]), va.LabelDictionary.of(spark, "Stream", STREAMS)


def people(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PROFILE)


def test_one_unknown_class_clears_both_codes(spark, labels):
    df = people(spark, (20, "Male", "Electrical", 1, 7.0, 1, 0), (20, "Other", "Electrical", 1, 7.0, 2, 1), (20, "Male", "Marine", 1, 7.0, 0, 3))
    rows = [(r["Gender"], r["Stream"], r["Hostel"], r["HistoryOfBacklogs"]) for r in va.encode(df, *labels).orderBy("id").collect()]
    assert rows == [(1, 2, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)]


def test_large_dictionary_is_joined(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",), (None,)], "Stream string")
    small, large = va.LabelDictionary.fit(df, "Stream"), va.LabelDictionary.fit(df, "Stream", inline_limit=2)
    assert small.values == ["B", "a", "b"] and large.values is None
    for d in (small, large):
        assert {r["Stream"]: r["c"] for r in d.attach(df, "c").collect()} == {"B": 0, "a": 1, "b": 2, None: None}


def test_age_limits_are_those_of_the_request(spark):
    df = people(spark, *[(a, "Male", "Civil", 0, 5.0, 0, 0) for a in (14, 15, 40, 41)], (20, "Male", "Civil", -1, 10.5, 2, 1))
    valid, rejected = va.split_valid(df)
    assert {r["Age"] for r in valid.collect()} == {15, 40}
    assert {r["id"]: r["violations"] for r in rejected.collect()}[4] == ["Internships below 0", "CGPA above 10", "Hostel above 1"]
    assert va.split_valid(df, {"Age": (15, 50)})[0].count() == 4


def test_yes_no(spark):
    values = [" TRUE ", "yes", "1", "01", "1.0", "0", "no", "", "maybe", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(text.yes_no(F.col("v"))).collect()]
    assert got == ["Yes"] * 4 + ["No"] * 6
    numbers = spark.createDataFrame([(1.0,), (1.5,), (0.0,), (None,)], "v double").select(text.yes_no(F.col("v"), numeric=True))
    assert [r[0] for r in numbers.collect()] == ["Yes", "Yes", "No", "No"]


@pytest.mark.parametrize("p,band", [
    (0.7, ("LOW", "Very High Confidence")), (0.6999, ("LOW", "High Confidence")), (0.5, ("LOW", "High Confidence")),
    (0.4999, ("MEDIUM", "Moderate Confidence")), (0.3, ("MEDIUM", "Moderate Confidence")), (0.2999, ("HIGH", "High Confidence")),
])
def test_bands(spark, p, band):
    row = spark.range(1).select(bands.risk_level(F.lit(p)), bands.confidence(F.lit(p)), bands.hard_class(F.lit(p))).first()
    assert (row[0], row[1]) == band and row[2] == int(p > 0.5)


def scenarios_of(spark, labels, row, card=None, graph=None):
    engine = answers.Engine(ExpressionScorer(card or dict(CARD)), *labels, graph)
    return answers.whatif(engine, people(spark, row)).first()


def test_cgpa_edges(spark, labels):
    for cgpa, new in ((8.99, "9.99"), (8.5, "9.5"), (9.0, None), (10.0, None)):
        got = scenarios_of(spark, labels, (20, "Male", "Computer Science", 3, cgpa, 1, 0))
        assert [s["suggested_value"] for s in got["scenarios"]] == ([new] if new else [])
        assert (got["best"] is None) == (new is None)


def test_scenarios_are_numbered_after_drops_and_ranked_by_gain(spark, labels):
    got = scenarios_of(spark, labels, (20, "Male", "Civil", 1, 6.0, 0, 1))
    rows = [(s["scenario_id"], s["title"]) for s in got["scenarios"]]
    assert sorted(rows) == [(1, "+1.0 CGPA"), (2, "Extra Internship"), (3, "Clear Backlogs"), (4, "Switch to CS")]
    deltas = [s["risk_delta"] for s in got["scenarios"]]
    assert deltas == sorted(deltas, reverse=True) and got["best"] == got["scenarios"][0]
    for s in got["scenarios"]:
        assert s["risk_delta"] == pytest.approx(s["modified_risk"] - s["original_risk"], abs=1e-5)
    assert got["combined_risk"] > max(s["modified_risk"] for s in got["scenarios"])


def test_streams_that_do_not_gain_are_dropped(spark, labels):
    worse = scenarios_of(spark, labels, (20, "Male", "Mechanical", 3, 9.5, 1, 0))
    assert worse["scenarios"] == []
    hostel = scenarios_of(spark, labels, (20, "Male", "Mechanical", 3, 9.5, 0, 0), {**CARD, "Hostel": 0.2})
    assert [(s["title"], s["original_value"], s["suggested_value"]) for s in hostel["scenarios"]] == [("Stay in Hostel", "No", "Yes")]


def test_zero_probability_uses_divisor_one(spark):
    row = spark.range(1).select(numeric.percent_of(F.lit(5.0), F.lit(0.0), F.lit(5.0) * 100), numeric.percent_of(F.lit(5.0), F.lit(20.0), F.lit(0.0))).first()
    assert tuple(row) == (500.0, 25.0)


def test_whatif_is_a_narrow_map(spark, labels):
    engine = answers.Engine(ExpressionScorer(), *labels, None)
    plan = answers.whatif(engine, people(spark, (20, "Male", "Civil", 1, 6.0, 0, 1)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_cgpa_sweep_rises(spark, labels):
    df = va.encode(people(spark, (22, "Male", "Computer Science", 1, 7.5, 1, 0)), *labels)
    grid = {"CGPA": [7.5, 7.6, 7.7, 7.8]}
    swept = wi.sweep(df, ExpressionScorer(), grid)
    values = [r["percent"] for r in wi.sweep_rows(swept).orderBy("value").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))
    assert not any(r["plateau"] for r in wi.sweep_plateaus(swept).collect())
    flat = wi.sweep(df, ExpressionScorer(), {"Age": [20, 21, 22], "CGPA": [7.5, 7.5]})
    assert [r["plateau"] for r in wi.sweep_plateaus(flat).collect()] == [False, True, True, False, True]
    assert {r["sense"] for r in wi.sweep_delta(flat).collect()} == {"same"}


def impact_frame(spark, shap):
    df = spark.createDataFrame([(1, *[0.0] * 7)], "id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    return df.withColumn("impacts", at.impact_array({f: F.lit(float(v)) for f, v in zip(FEATURES, shap)}))


def test_factor_order_sign_and_texts(spark):
    df = impact_frame(spark, [0.1, -0.5, 0.5, 0.31, 0.0, -0.05, 0.11])
    add = at.factor_rows(at.signed(df), None).orderBy("rank").collect()
    assert [r["feature"] for r in add] == ["Gender", "Stream", "Internships", "HistoryOfBacklogs", "Age", "Hostel", "CGPA"]
    ref = at.factor_rows(at.signed(df, "reference"), 5).orderBy("rank").collect()
    assert [r["impact"] for r in ref] == [0.5, -0.5, -0.31, -0.11, -0.1]
    texts = at.signed(df).select(F.inline(at.factors(None))).collect()
    by = {r["feature"]: r for r in texts}
    assert by["0 Internships"]["interpretation"] == "Internships significantly improves placement chances"
    assert by["No Backlogs"]["interpretation"] == "Historyofbacklogs moderately improves placement chances"
    assert by["CGPA (0.0)"]["direction"] == "Reduces Chances"
    assert by["Hostel"]["interpretation"] == "Hostel slightly reduces placement chances"


def test_all_zero_attribution(spark):
    df = at.signed(impact_frame(spark, [0.0] * 7), "reference")
    assert all(r["share"] is None for r in at.factor_shares(df).collect())
    assert {r["direction"] for r in df.select(F.inline(at.factors())).collect()} == {"Reduces Chances"}
    assert {r["text"] for r in at.signed_text(df).collect()} == {"0.000"}


def test_linear_attribution_adds_up_and_internships_help(spark, labels):
    df = people(spark, (21, "Female", "Information Technology", 3, 8.5, 0, 0), (22, "Male", "Civil", 0, 6.1, 1, 1), (19, "Male", "Civil", 1, 7.2, 0, 0))
    engine = answers.Engine(ExpressionScorer(), *labels, None)
    coded = engine.encode(df)
    attribution = at.LinearAttribution.fit(ExpressionScorer(), coded)
    rows = at.signed(attribution.attach(coded)).select("id", at.prediction_value().alias("v"), "impacts").collect()
    probs = {r["id"]: r["p"] for r in score(coded, ExpressionScorer()).collect()}
    for r in rows:
        assert 1 / (1 + math.exp(-r["v"])) == pytest.approx(probs[r["id"]], abs=1e-5)
    first = {s["feature"]: s["impact"] for s in next(r for r in rows if r["id"] == 0)["impacts"]}
    assert first["Internships"] > 0
    told = answers.explain(engine, df, attribution).filter("id = 0").first()
    assert "3 Internships" in [f["feature"] for f in told["factors"]]


def test_rounding_is_half_up_with_the_known_ties(spark):
    row = spark.range(1).select(F.round(F.lit(0.125), 2), numeric.half_up(F.lit(-0.25), 1), numeric.signed_fixed(F.lit(0.1234), 3), numeric.signed_fixed(F.lit(-0.0001), 3)).first()
    assert tuple(row) == (0.13, -0.3, "+0.123", "0.000")


def test_form_coercion(spark):
    row = ("x", "Male", "Civil", "many", " 7.5 ", 1, 0, " a ,, b,", "")
    df = spark.createDataFrame([row], "age_text string, Gender string, Stream string, internships_text string, cgpa_text string, Hostel int, HistoryOfBacklogs int, skills_text string, role_text string")
    got = va.coerce_form(df).first()
    assert (got["Age"], got["Internships"], got["CGPA"], got["skills"], got["desired_role"]) == (None, 0, 7.5, ["a", "b"], None)


def test_clamp(spark):
    df = spark.createDataFrame([(None,), (0.0,), (3.0,), (99.0,), (16.0,)], "v double")
    assert [r[0] for r in df.select(numeric.clamp(F.col("v"), 15, 40)).collect()] == [15.0, 15.0, 15.0, 40.0, 16.0]


def test_career_scenario_comes_first(spark, labels, tiny_catalogue):
    from gradpath.operators.graph import SkillGraph

    engine = answers.Engine(ExpressionScorer(), *labels, SkillGraph.from_catalogue(tiny_catalogue))
    df = people(spark, *[(20, "Male", "Computer Science", 3, 8.0, 1, 0)] * 4)
    skills = spark.createDataFrame([(0, 0, "y1"), (1, 0, "y1"), (2, 0, "none"), (3, 0, "lone1")], "id bigint, pos int, skill string")
    desired = spark.createDataFrame([(0, "Job C"), (1, ""), (2, "Job C"), (3, "Job C")], "id bigint, desired_role string")
    got = {r["id"]: r["scenarios"] for r in answers.whatif(engine, df, skills, desired).collect()}
    career = [s for s in got[0] if s["title"] == "Career Path Suggestion"][0]
    assert (career["scenario_id"], career["risk_delta"], career["change_summary"]) == (1, 0.0, "Learn: Go")
    assert [[s["scenario_id"] for s in got[i]] for i in (1, 2, 3)] == [[1]] * 3


def test_predict_without_skills_has_no_role(spark, labels, tiny_catalogue):
    from gradpath.operators.graph import SkillGraph

    engine = answers.Engine(ExpressionScorer(), *labels, SkillGraph.from_catalogue(tiny_catalogue))
    df = people(spark, *[(20, "Male", "Computer Science", 3, 8.0, 1, 0)] * 2)
    skills = spark.createDataFrame([(0, 0, "w1")], "id bigint, pos int, skill string")
    desired = spark.createDataFrame([(1, "Job C")], "id bigint, desired_role string")
    rows = {r["id"]: r for r in answers.predict(engine, df, skills, desired).collect()}
    assert (rows[0]["recommended_job"], rows[0]["missing_skills"], rows[0]["target_role"]) == ("Job C", ["Go", "x1"], "Job C")
    assert (rows[1]["recommended_job"], rows[1]["missing_skills"], rows[1]["target_role"]) == (None, [], None)


def test_bands_of_the_demo_profile(spark, labels):
    df = people(spark, (21, "Female", "Information Technology", 1, 7.5, 1, 1))
    row = with_bands(score(va.encode(df, *labels), ExpressionScorer())).first()
    margin = -7 + 0.05 * 3 + 0.9 + 0.8 * 7.5 - 0.2 - 0.7
    assert row["probability_percentage"] == pytest.approx(100 / (1 + math.exp(-margin)), abs=0.006)


def test_dictionary_of_any_size_gives_the_same(spark):
    names = [f"Stream {i:04}" for i in range(1201)] + ["Computer Science"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "id bigint, Stream string")
    small, large = va.LabelDictionary.fit(df, "Stream", inline_limit=5000), va.LabelDictionary.fit(df, "Stream")
    assert large.values is None and small.code_of_value("Computer Science") == large.code_of_value("Computer Science") == 0
    assert large.code_of_value("none") is None
    one, two = small.attach(df, "code"), large.attach(df, "code")
    assert one.dtypes == two.dtypes
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_form_values_that_no_number_holds(spark):
    df = spark.createDataFrame([(1, "21.5", "NaN", "x", " a ,　b ", ""), (2, "x", "1e12", "7.5", None, "r")], "id int, age_text string, internships_text string, cgpa_text string, skills_text string, role_text string")
    got = [(r["Age"], r["Internships"], r["CGPA"], r["skills"]) for r in va.coerce_form(df).orderBy("id").collect()]
    assert got == [(21, 0, 0.0, ["a", "b"]), (None, 0, 7.5, None)]
