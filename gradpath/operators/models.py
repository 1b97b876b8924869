"""The stacked classifier: three tree ensembles, out-of-fold columns, a logistic top.

All ensembles of all folds are grown together (``growing``), and all changed copies of a
profile go through all ensembles in one call on flat tree arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from gradpath.operators.attribution import factor_rows, signed
from gradpath.operators.balance import assign_folds
from gradpath.operators.growing import BINS, Fit, Learner, cut_points, grow
from gradpath.operators.scale import MedianImputer, PopulationScaler
from gradpath.operators.scoring import own_features
from gradpath.operators.trees import Trees
from gradpath.schema import FEATURES, LABEL
from gradpath.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """Sizes of the ensembles. The defaults are the full-size model."""

    forest_trees: int = 100
    forest_depth: int = 5
    rounds: int = 100
    gradient_rate: float = 0.1
    gradient_depth: int = 3
    booster_rate: float = 0.3
    booster_depth: int = 4
    booster_l2: float = 1.0
    booster_least: float = 1.0
    folds: int = 5
    seed: int = 42
    bins: int = BINS


def learners(s: Settings) -> dict[str, Learner]:
    """The three base learners, by name and in stacking order."""
    return {
        "rf": Learner("forest", s.forest_trees, s.forest_depth),
        "gbc": Learner("gradient", s.rounds, s.gradient_depth, s.gradient_rate),
        "xgb": Learner("newton", s.rounds, s.booster_depth, s.booster_rate, s.booster_l2, s.booster_least),
    }


def fit_preprocessor(train: DataFrame, scale: bool = True) -> PipelineModel:
    """Imputer and scaler, fitted on training rows only."""
    stages = [MedianImputer(inputCols=FEATURES)]
    if scale:
        stages.append(PopulationScaler(inputCols=FEATURES))
    return Pipeline(stages=stages).fit(train)


def processed(preprocessor: PipelineModel, features: Mapping[str, Column]) -> Column:
    """The model's inputs as an array, for any feature Columns."""
    values = []
    for name in FEATURES:
        value = features[name].cast("double")
        for stage in preprocessor.stages:
            value = stage.expression(name, value)
        values.append(value)
    return F.array(*values)


def training_rows(train: DataFrame, key: Column | str, preprocessor: PipelineModel) -> DataFrame:
    """(key, y, fold, x) as trees are grown from, written once."""
    key = F.col(key) if isinstance(key, str) else key
    return cut_lineage(train.select(F.xxhash64(key.cast("string")).alias("key"), F.col(LABEL).alias("y"), "fold", processed(preprocessor, own_features()).alias("x")))


def score_together(df: DataFrame, preprocessor: PipelineModel, variants: Mapping[str, Mapping[str, Column]], probability: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with a probability for each variant; the vectors of all variants of a batch of rows
    are one matrix."""
    width, features = len(variants), len(FEATURES)

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        x = np.asarray(vectors.flatten(), dtype=float).reshape(-1, features)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, width, dtype=np.int32)), pa.array(probability(x)))

    together = F.concat(*[processed(preprocessor, features) for features in variants.values()])
    scored = df.withColumn("_scores", run(together))
    return scored.withColumns({name: F.col("_scores")[i] for i, name in enumerate(variants)}).drop("_scores")


def out_of_fold(rows: DataFrame, names: list[str], by_fold: dict[int, list[Trees]]) -> DataFrame:
    """(key, y, fold, one probability a learner, trained_on) for ``rows``: each row is scored once, by
    the ensembles that have not seen its fold; ``trained_on`` is the number of rows they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(len(batch), -1)
            fold = np.asarray(batch.column("fold"))
            p, seen = np.zeros((len(names), len(fold))), np.zeros(len(fold), np.int64)
            for k, ensembles in by_fold.items():
                here = np.flatnonzero(fold == k)
                for j, trees in enumerate(ensembles):
                    p[j, here] = trees.probability(x[here])
                seen[here] = ensembles[-1].rows[0, 0]
            columns = [batch.column(c) for c in ("key", "y", "fold")] + [pa.array(c) for c in p] + [pa.array(seen)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "y", "fold", *(f"p_{n}" for n in names), "trained_on"])

    schema = "key bigint, y int, fold int, " + ", ".join(f"p_{n} double" for n in names) + ", trained_on bigint"
    return rows.select("key", F.col("y").cast("int").alias("y"), "fold", "x").mapInArrow(run, schema)


@dataclass
class StackedModel:
    preprocessor: PipelineModel
    bases: dict[str, Trees]
    top: LogisticRegressionModel

    def probability(self) -> Callable[[np.ndarray], np.ndarray]:
        bases, weights, intercept = list(self.bases.values()), np.array(self.top.coefficients.toArray()), float(self.top.intercept)

        def run(x: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-(np.stack([b.probability(x) for b in bases], axis=1) @ weights + intercept)))

        return run

    def score_many(self, df: DataFrame, variants: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        return score_together(df, self.preprocessor, variants, self.probability())


@dataclass
class FittedStack:
    """A stack and what it was put together from."""

    model: StackedModel
    oof: DataFrame


def fit_stack(train: DataFrame, key: Column | str, s: Settings = Settings(), preprocessor: PipelineModel | None = None) -> FittedStack:
    """Fit on rows of encoded features and label. ``key`` decides the fold of a row."""
    preprocessor = preprocessor or fit_preprocessor(train)
    rows = training_rows(assign_folds(train, s.folds, key), key, preprocessor)
    kinds = learners(s)
    fits = [Fit(learner, held) for held in (None, *range(s.folds)) for learner in kinds.values()]
    grown = grow(rows, cut_points(rows, "x", len(FEATURES), s.bins), fits, s.seed)
    at = lambda k: grown[k * len(kinds) : (k + 1) * len(kinds)]
    # written, so that the top's iterations don't score the rows again
    oof = cut_lineage(out_of_fold(rows, list(kinds), {k: at(k + 1) for k in range(s.folds)}))
    level = oof.select(F.col("y").alias(LABEL), array_to_vector(F.array(*[f"p_{b}" for b in kinds])).alias("_z")).persist()
    try:
        # unit penalty on the summed loss, as a share of the mean loss Spark minimises
        top = LogisticRegression(featuresCol="_z", labelCol=LABEL, regParam=1.0 / level.count(), standardization=False).fit(level)
    finally:
        level.unpersist()
    return FittedStack(StackedModel(preprocessor, dict(zip(kinds, at(0))), top), oof)


@dataclass
class BoosterModel:
    """A single booster; the one explanations are made from.

    With ``scale=False`` at fitting this is also the plain variant on raw features.
    """

    preprocessor: PipelineModel
    model: Trees

    def score_many(self, df: DataFrame, variants: Mapping[str, Mapping[str, Column]]) -> DataFrame:
        return score_together(df, self.preprocessor, variants, self.model.probability)

    def inputs(self) -> Column:
        return processed(self.preprocessor, own_features())


def earlier_settings(s: Settings = Settings()) -> Settings:
    """The earlier variant's booster keeps its library's default depth of 6."""
    return replace(s, booster_depth=6)


def fit_booster(train: DataFrame, s: Settings = Settings(), preprocessor: PipelineModel | None = None, scale: bool = True) -> BoosterModel:
    if preprocessor is None:
        # written, so that the passes over it don't work it out again each
        train = cut_lineage(train.select("id", *FEATURES, LABEL))
        preprocessor = fit_preprocessor(train, scale)
    rows = training_rows(train.withColumn("fold", F.lit(-1)), F.col("id"), preprocessor)
    return BoosterModel(preprocessor, grow(rows, cut_points(rows, "x", len(FEATURES), s.bins), [Fit(learners(s)["xgb"])], s.seed)[0])


def safe_score(df: DataFrame, model: BoosterModel, gender, stream, out: str = "p") -> DataFrame:
    """Score raw profiles; one with an unknown class or a missing number scores 0.0.

    ``usable`` tells which is which; for the others the list of factors is empty too.
    """
    coded = stream.attach(gender.attach(df, "_g"), "_s")
    usable = F.lit(True)
    for c in ("_g", "_s", "Age", "Internships", "CGPA", "Hostel", "HistoryOfBacklogs"):
        usable = usable & F.col(c).isNotNull()
    feats = {**own_features(), "Gender": F.col("_g"), "Stream": F.col("_s")}
    scored = model.score_many(coded, {out: feats})
    return scored.withColumns({"usable": usable, out: F.when(usable, F.col(out)).otherwise(0.0)}).drop("_g", "_s")


def safe_factors(df: DataFrame, attribution, gender, stream) -> DataFrame:
    """(id, feature, impact, rank) of raw profiles as the earlier variant lists them, strongest
    first; none for a profile that scores 0.0 because it can't be used."""
    coded = stream.attach(gender.attach(df, "_g"), "_s").filter(F.col("_g").isNotNull() & F.col("_s").isNotNull()).dropna(subset=["Age", "Internships", "CGPA", "Hostel", "HistoryOfBacklogs"])
    coded = coded.withColumns({"Gender": F.col("_g"), "Stream": F.col("_s")})
    return factor_rows(signed(attribution.attach(coded)), None).select("id", "feature", "impact", "rank")


def confusion(scored: DataFrame, p: str = "p", label: str = LABEL) -> DataFrame:
    """One row: counts of the four outcomes and the accuracy."""
    guess = (F.col(p) > 0.5).cast("int")
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if((guess == 1) & (F.col(label) == 1)).alias("true_pos"),
        F.count_if((guess == 1) & (F.col(label) == 0)).alias("false_pos"),
        F.count_if((guess == 0) & (F.col(label) == 0)).alias("true_neg"),
        F.count_if((guess == 0) & (F.col(label) == 1)).alias("false_neg"),
        F.round(F.avg((guess == F.col(label)).cast("double")), 6).alias("accuracy"),
    )
