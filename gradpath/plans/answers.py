"""Predict, explain, what-if and options for whole tables of profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.functions.text import blank_to_null
from gradpath.operators import attribution as at
from gradpath.operators import graph as gr
from gradpath.operators import paths, whatif as wi
from gradpath.operators.scoring import Scorer, score, with_bands
from gradpath.operators.validate import LabelDictionary, class_listing, encode, mark_violations, split_valid
from gradpath.session import cut_lineage


@dataclass
class Engine:
    """What a served model needs: scorer, dictionaries and graph."""

    scorer: Scorer
    gender: LabelDictionary
    stream: LabelDictionary
    graph: gr.SkillGraph

    @property
    def cs_code(self) -> int | None:
        return self.stream.code_of_value(wi.CS)

    def encode(self, profiles: DataFrame) -> DataFrame:
        valid, _ = split_valid(profiles)
        return encode(valid, self.gender, self.stream)


def long_skills(requests: DataFrame) -> DataFrame:
    """(id, pos, skill) from the ``skills`` array of requests."""
    return requests.select("id", F.posexplode("skills").alias("pos", "skill"))


def predict(engine: Engine, profiles: DataFrame, skills: DataFrame, desired: DataFrame) -> DataFrame:
    """Class, percentage, band, recommended role, its gap and the target of the gap map.

    Roles are looked up only for people who list skills.
    """
    scored = with_bands(score(engine.encode(profiles), engine.scorer))
    # several steps start from it, so it is worked out once
    best = cut_lineage(gr.recommend(engine.graph, skills))
    lacking = gr.gaps(engine.graph, best.select("id", F.col("recommended").alias("job")), skills)
    roles = lacking.select("id", F.col("job").alias("recommended_job"), F.col("missing").alias("missing_skills"))
    target = gr.target_roles(skills.select("id").distinct(), desired, best)
    return (
        scored.select("id", "prediction", "probability_percentage", "risk_level", "confidence")
        .join(roles, "id", "left")
        .join(target.withColumnRenamed("target", "target_role"), "id", "left")
        .withColumn("missing_skills", F.coalesce("missing_skills", F.array().cast("array<string>")))
    )


def predict_maps(engine: Engine, predictions: DataFrame, skills: DataFrame) -> DataFrame:
    """Gap map nodes for the target roles of ``predict``'s result."""
    targets = predictions.filter(F.col("target_role").isNotNull()).select("id", F.col("target_role").alias("job"))
    return gr.gap_map_nodes(engine.graph, targets, skills)


def explain(engine: Engine, profiles: DataFrame, attribution, sign: str = "additive", k: int | None = at.TOP) -> DataFrame:
    """(id, factors, base_value, prediction_value) with rounded values.

    ``attribution`` is a linear one or that of a trained booster (``Bundle.attribution``).
    """
    attributed = at.signed(attribution.attach(engine.encode(profiles)), sign)
    return attributed.select(
        "id", at.factors(k).alias("factors"), F.round("base_value", 4).alias("base_value"),
        F.round(at.prediction_value(), 4).alias("prediction_value"),
    )


def career_skills(graph: gr.SkillGraph, skills: DataFrame, desired: DataFrame) -> DataFrame:
    """(id, recommended, desired_role, path, skills_to_learn) for people with both roles and
    a path between them that has skills on it. Each pair of roles is searched once."""
    wanted = desired.select("id", blank_to_null(F.col("desired_role")).alias("target")).filter(F.col("target").isNotNull())
    both = cut_lineage(gr.recommend(graph, skills).select("id", F.col("recommended").alias("source")).join(wanted, "id"))
    found = paths.transitions(paths.shortest_paths(graph, both), graph).filter(F.size("skills_to_learn") > 0)
    known = broadcast_if_small(cut_lineage(found.select("source", "target", "path", "skills_to_learn")))
    return both.join(known, ["source", "target"]).select(
        "id", F.col("source").alias("recommended"), F.col("target").alias("desired_role"), "path", "skills_to_learn"
    )


def whatif(engine: Engine, profiles: DataFrame, skills: DataFrame | None = None, desired: DataFrame | None = None) -> DataFrame:
    """Scenarios, best and combined case per profile; with skills and desired roles also the
    career suggestion."""
    coded = engine.encode(profiles)
    if skills is None or desired is None:
        return wi.whatif(coded, engine.scorer, engine.cs_code)
    learn = career_skills(engine.graph, skills, desired).select("id", "skills_to_learn")
    return wi.whatif(coded.join(learn, "id", "left"), engine.scorer, engine.cs_code, "skills_to_learn")


def assess(engine: Engine, profiles: DataFrame, skills: DataFrame, desired: DataFrame, attribution) -> DataFrame:
    """Everything the assessment report of a profile needs, in one row.

    Scoring, factors and scenarios are worked out in the profile's own row; only the
    recommended role, the skills and the desired role are joined to it.
    """
    own = with_bands(score(engine.encode(profiles), engine.scorer))
    own = wi.whatif(own, engine.scorer, engine.cs_code)
    own = at.signed(attribution.attach(own)).withColumn("factors", at.factors())
    listed = cut_lineage(skills.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "skill")))["skill"].alias("skills")))
    long = listed.select("id", F.posexplode("skills").alias("pos", "skill"))
    best = gr.recommend(engine.graph, long).select("id", "recommended")
    wish = desired.select("id", blank_to_null(F.col("desired_role")).alias("desired_role"))
    return own.join(best, "id", "left").join(listed, "id", "left").join(wish, "id", "left")


def answer_all(engine: Engine, requests: DataFrame, attribution=None) -> DataFrame:
    """One row for every request, with its skills and desired role inside: the reasons it was
    rejected for, or prediction, factors (with an attribution) and scenarios."""
    marked = mark_violations(requests)
    good = marked.filter(F.size("violations") == 0)
    skills, desired = long_skills(good), good.select("id", "desired_role")
    rows = predict(engine, good, skills, desired)
    cases = whatif(engine, good, skills, desired).select("id", "scenarios", "best", "combined_risk")
    rows = rows.join(cases, "id")
    if attribution is not None:
        rows = rows.join(explain(engine, good, attribution), "id")
    return marked.select("id", "violations").join(rows, "id", "left")


def rejected(profiles: DataFrame) -> DataFrame:
    """The profiles that predict, explain and what-if leave out, with the reasons."""
    return split_valid(profiles)[1]


def options(engine: Engine, profiles: DataFrame) -> DataFrame:
    """(kind, value): streams, skills and jobs to choose from."""
    def kind(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("kind"), F.col(column).alias("value"))

    return (
        kind(class_listing(profiles, "Stream"), "value", "stream")
        .unionByName(kind(engine.graph.skill_list(), "skill", "skill"))
        .unionByName(kind(engine.graph.job_list(), "job", "job"))
    )
