"""Per-profile attribution of a score to its features, and the texts made from it.

Attributions live in the row as ``impacts``, an array of (pos, feature, value, shap), so
ranking and labelling factors needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions import bands
from gradpath.functions.numeric import signed_fixed
from gradpath.operators.scoring import ExpressionScorer
from gradpath.schema import FEATURES

TOP = 5  # Fixed value: number of factors reported.


def impact_array(shap: Mapping[str, Column]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), shap[f].alias("shap"))
            for i, f in enumerate(FEATURES)
        ]
    )


@dataclass
class LinearAttribution:
    """Exact Shapley values of a score card's margin: coefficient times distance to the mean."""

    scorer: ExpressionScorer
    means: dict[str, float]

    @classmethod
    def fit(cls, scorer: ExpressionScorer, background: DataFrame) -> "LinearAttribution":
        row = background.agg(*[F.avg(f).alias(f) for f in FEATURES]).first()
        return cls(scorer, {f: float(row[f] or 0.0) for f in FEATURES})

    @property
    def base_value(self) -> float:
        return self.scorer.intercept + sum(self.scorer.coefs[f] * self.means[f] for f in FEATURES)

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with ``impacts`` and ``base_value``; base plus impacts is the margin."""
        shap = {f: F.round(F.lit(float(self.scorer.coefs[f])) * (F.col(f) - F.lit(self.means[f])), 6) for f in FEATURES}
        return df.withColumns({"impacts": impact_array(shap), "base_value": F.lit(self.base_value)})


def signed(df: DataFrame, sign: str = "additive") -> DataFrame:
    """Add ``impact`` to each entry of ``impacts``.

    ``"additive"`` keeps the attribution's own sign, so base plus impacts is the margin;
    ``"reference"`` negates it, before ranking, texts and sum.
    """
    if sign not in ("additive", "reference"):
        raise ValueError(f"unknown sign {sign!r}")
    turn = (lambda c: c) if sign == "additive" else (lambda c: -c)
    # adding zero turns a negated zero into plain zero
    return df.withColumn("impacts", F.transform("impacts", lambda s: s.withField("impact", turn(s["shap"]) + F.lit(0.0))))


def ranked_impacts(impacts: str | Column = "impacts", k: int | None = None) -> Column:
    """Entries by size of impact, feature order deciding ties; the first ``k`` if given."""
    keyed = F.transform(impacts, lambda s: F.struct((-F.abs(s["impact"])).alias("neg"), s["pos"].alias("pos"), s.alias("s")))
    ranked = F.transform(F.array_sort(keyed), lambda t: t["s"])
    return ranked if k is None else F.slice(ranked, 1, k)


def factors(k: int | None = TOP) -> Column:
    """Array of (feature, impact, direction, interpretation) for the strongest factors."""
    return F.transform(
        ranked_impacts(k=k),
        lambda s: F.struct(
            bands.factor_label(s["feature"], s["value"]).alias("feature"),
            F.round(s["impact"], 4).alias("impact"),
            bands.direction(s["impact"]).alias("direction"),
            bands.interpretation(s["feature"], s["impact"]).alias("interpretation"),
        ),
    )


def prediction_value() -> Column:
    """Base value plus the sum of the (signed) impacts."""
    return F.aggregate("impacts", F.col("base_value"), lambda acc, s: acc + s["impact"])


def impact_rows(df: DataFrame) -> DataFrame:
    """(id, pos, feature, value, shap, impact), one row per feature."""
    return df.select("id", F.inline_outer("impacts"))


def factor_rows(df: DataFrame, k: int | None = TOP) -> DataFrame:
    """(id, rank, pos, feature, value, shap, impact) for the strongest factors."""
    return df.select("id", F.posexplode_outer(ranked_impacts(k=k)).alias("place", "s")).select("id", (F.col("place") + 1).alias("rank"), "s.*")


def factor_shares(df: DataFrame) -> DataFrame:
    """(id, feature, share): size of an impact in percent of the row's largest; null if all are 0."""
    top = F.array_max(F.transform("impacts", lambda s: F.abs(s["impact"])))
    share = F.transform(
        "impacts",
        lambda s: F.struct(s["feature"].alias("feature"), F.when(F.col("top") > 0, F.round(F.abs(s["impact"]) / F.col("top") * 100, 6)).alias("share")),
    )
    return df.select("id", "impacts", top.alias("top")).select("id", F.inline_outer(share))


def signed_text(df: DataFrame, digits: int = 3) -> DataFrame:
    return impact_rows(df).select("id", "feature", signed_fixed(F.col("impact"), digits).alias("text"))
