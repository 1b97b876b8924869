"""Registration of queries and of their checking SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from gradpath.operators.graph import SkillGraph
from gradpath.operators.scoring import ExpressionScorer
from gradpath.operators.validate import LabelDictionary, encode
from gradpath.plans.answers import Engine
from gradpath.sources.views import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` must give the same rows from the supplied tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def catalogue_graph(spark: SparkSession, d: str) -> SkillGraph:
    return SkillGraph.from_catalogue(load(spark, d, "catalogue"))


def dictionaries(spark: SparkSession, d: str, view: str = "profiles") -> tuple[LabelDictionary, LabelDictionary]:
    people = load(spark, d, view)
    return LabelDictionary.fit(people, "Gender"), LabelDictionary.fit(people, "Stream")


def encoded(spark: SparkSession, d: str, view: str = "profiles") -> DataFrame:
    return encode(load(spark, d, view), *dictionaries(spark, d, view))


def engine(spark: SparkSession, d: str, graph: SkillGraph | None = None, scorer: ExpressionScorer | None = None) -> Engine:
    return Engine(scorer or ExpressionScorer(), *dictionaries(spark, d), graph)
