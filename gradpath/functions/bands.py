"""Placement bands and the texts that go with an attribution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def risk_level(p: Column) -> Column:
    """LOW means a high placement chance; lower bounds belong to their band."""
    return F.when(p >= 0.5, "LOW").when(p >= 0.3, "MEDIUM").otherwise("HIGH")


def confidence(p: Column) -> Column:
    return (
        F.when(p >= 0.7, "Very High Confidence")
        .when(p >= 0.5, "High Confidence")
        .when(p >= 0.3, "Moderate Confidence")
        .otherwise("High Confidence")
    )


def percentage(p: Column) -> Column:
    return F.round(p * 100, 2)


def hard_class(p: Column) -> Column:
    return (p > 0.5).cast("int")


def direction(impact: Column) -> Column:
    return F.when(impact > 0, "Improves Chances").otherwise("Reduces Chances")


def interpretation(feature: Column, impact: Column) -> Column:
    """One sentence on the strength and sense of a factor; zero counts as reducing."""
    size = F.abs(impact)
    strength = F.when(size > 0.3, "significantly").when(size > 0.1, "moderately").otherwise("slightly")
    verb = F.when(impact > 0, "improves").otherwise("reduces")
    return F.concat_ws(" ", F.initcap(F.replace(feature, F.lit("_"), F.lit(" "))), strength, verb, F.lit("placement chances"))


def factor_label(feature: Column, value: Column) -> Column:
    """Name of a factor, dependent on the profile's value of it."""
    plain = F.initcap(F.replace(feature, F.lit("_"), F.lit(" ")))
    backlogs = F.when(value == 0, "No Backlogs").otherwise("History of Backlogs")
    return (
        F.when(feature == "HistoryOfBacklogs", backlogs)
        .when(feature == "Internships", F.concat(value.cast("int").cast("string"), F.lit(" Internships")))
        .when(feature == "CGPA", F.concat(F.lit("CGPA ("), value.cast("string"), F.lit(")")))
        .otherwise(plain)
    )
