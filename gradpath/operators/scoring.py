"""Scorers: anything that adds a placement probability to rows of numeric features.

A scorer takes the features as Columns, so changed copies of a profile can be scored in
the same row. Scoring stays a narrow map over the profile table, with no join or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Protocol

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions import bands
from gradpath.schema import FEATURES


class Scorer(Protocol):
    def score_many(self, df: DataFrame, variants: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        """``df`` with one probability column per variant (name -> feature Columns)."""
        ...


def own_features() -> dict[str, Column]:
    return {f: F.col(f) for f in FEATURES}


def score(df: DataFrame, scorer: Scorer, out: str = "p") -> DataFrame:
    return scorer.score_many(df, {out: own_features()})


# A score card on raw encoded features, coefficients in feature order.
CARD = {"Age": 0.0, "Gender": 0.1, "Stream": 0.05, "Internships": 0.9, "CGPA": 0.8, "Hostel": -0.2, "HistoryOfBacklogs": -0.7}
CARD_INTERCEPT = -7.0


@dataclass
class ExpressionScorer:
    """A logistic score card written as one Column expression; its data are coefficients."""

    coefs: Mapping[str, float] = field(default_factory=lambda: dict(CARD))
    intercept: float = CARD_INTERCEPT

    def margin(self, features: Mapping[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for name in FEATURES:
            total = total + F.lit(float(self.coefs[name])) * features[name]
        return total

    def probability(self, features: Mapping[str, Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(features)))

    def score_many(self, df: DataFrame, variants: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        return df.withColumns({name: self.probability(feats) for name, feats in variants.items()})


def with_bands(df: DataFrame, p: str = "p") -> DataFrame:
    """Add class, percentage, band and confidence for a probability column."""
    return df.withColumns(
        {
            "prediction": bands.hard_class(F.col(p)),
            "probability_percentage": bands.percentage(F.col(p)),
            "risk_level": bands.risk_level(F.col(p)),
            "confidence": bands.confidence(F.col(p)),
        }
    )
