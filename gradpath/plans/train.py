"""Training from labelled profiles to a saved bundle."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradpath.operators import balance as ba
from gradpath.operators.graph import SkillGraph
from gradpath.operators.models import BoosterModel, Settings, StackedModel, confusion, fit_preprocessor, fit_stack
from gradpath.operators.scale import MedianImputer
from gradpath.operators.scoring import score
from gradpath.operators.trees import NODE, Trees
from gradpath.operators.treeshap import TreeAttribution
from gradpath.operators.validate import LabelDictionary, encode
from gradpath.plans.answers import Engine
from gradpath.schema import FEATURES, LABEL
from gradpath.session import cut_lineage

COMMIT = "number bigint, version string"


@dataclass
class Bundle:
    """Everything training leaves behind."""

    stack: StackedModel
    booster: BoosterModel
    gender: LabelDictionary
    stream: LabelDictionary
    edges: DataFrame
    report: dict = field(default_factory=dict)

    def engine(self) -> Engine:
        return Engine(self.stack, self.gender, self.stream, SkillGraph.from_edges(self.edges))

    def attribution(self) -> TreeAttribution:
        found = TreeAttribution.from_trees(self.booster.model)
        found.inputs = self.booster.inputs
        return found


def balanced_split(coded: DataFrame, order: str = "split_first") -> tuple[DataFrame, DataFrame]:
    """(train, test), both with id, copy, features and label.

    ``"split_first"`` balances the training rows only. ``"reference"`` balances everything
    before the split, so that new rows may lie between a training and a test row.
    """
    filled = lambda fit_on, df: MedianImputer(inputCols=FEATURES).fit(fit_on).transform(df)  # noqa: E731  neighbours need every coordinate
    if order == "reference":
        coded = cut_lineage(filled(coded, coded))
        both = ba.split(cut_lineage(ba.balance(coded)), key=ba.row_key())
        return both.filter("in_train").drop("in_train"), both.filter("not in_train").drop("in_train")
    if order != "split_first":
        raise ValueError(f"unknown order {order!r}")
    parts = ba.split(coded)
    learnt = parts.filter("in_train").drop("in_train")
    train = cut_lineage(ba.balance(filled(learnt, learnt)))
    test = parts.filter("not in_train").select(
        "id", F.lit(0).alias("copy"), *[F.col(f).cast("double").alias(f) for f in FEATURES], LABEL
    )
    return train, test


def train(profiles: DataFrame, edges: DataFrame, settings: Settings = Settings(), order: str = "split_first") -> Bundle:
    """Dictionaries, balancing, split, preprocessing, stack and accuracy.

    The booster that explanations are made from has the settings, rows and seed of the
    stack's third learner; growing trees leaves nothing to chance, so that one is taken.
    """
    gender, stream = LabelDictionary.fit(profiles, "Gender"), LabelDictionary.fit(profiles, "Stream")
    coded = encode(profiles, gender, stream).select("id", *FEATURES, LABEL)
    rows, held = balanced_split(coded, order)
    preprocessor = fit_preprocessor(rows)
    fitted = fit_stack(rows, ba.row_key(), settings, preprocessor)
    explainer = BoosterModel(preprocessor, fitted.model.bases["xgb"])
    outcome = confusion(score(held, fitted.model)).first().asDict()
    outcome["train_rows"] = rows.count()
    return Bundle(fitted.model, explainer, gender, stream, edges, outcome)


def _checksum(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and a hash of them that does not depend on their order."""
    got = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("h")).first()
    return got["n"], got["h"] or 0


def save_bundle(bundle: Bundle, path: str) -> str:
    """Save a new version under ``path`` and return its name.

    A version is a folder of its own: preprocessor and top in Spark ML's format, trees,
    dictionaries and edges as tables, the manifest with their checksums. Only when all
    of it is written does a line in ``committed`` name it, so whoever loads sees the old
    version or the new one, whole; a save that fails leaves files that nothing points to.
    """
    version = f"v-{uuid.uuid4().hex}"
    home, spark = f"{path}/{version}", bundle.edges.sparkSession
    ensembles = bundle.stack.bases | {"booster": bundle.booster.model}
    label = lambda name, d: d.table.select(F.lit(name).alias("field"), "value", F.col("code").cast("int").alias("code"))
    tables = {
        "trees": spark.createDataFrame([r for name, t in ensembles.items() for r in t.to_rows(name)], NODE),
        "labels": label("Gender", bundle.gender).unionByName(label("Stream", bundle.stream)),
        "edges": bundle.edges,
    }
    bundle.stack.preprocessor.write().save(f"{home}/preprocessor")
    bundle.stack.top.write().save(f"{home}/top")
    sums = {}
    for name, df in tables.items():
        df.write.parquet(f"{home}/{name}")
        sums[name] = _checksum(spark.read.parquet(f"{home}/{name}"))
    shapes = {name: [t.start, t.mean, *t.feature.shape] for name, t in ensembles.items()}
    manifest = json.dumps({"bases": list(bundle.stack.bases), "shapes": shapes, "sums": sums, "report": bundle.report})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{home}/manifest")
    last = max((r["number"] for r in _committed(spark, path)), default=0)
    spark.createDataFrame([(last + 1, version)], COMMIT).coalesce(1).write.mode("append").json(f"{path}/committed")
    return version


def _committed(spark: SparkSession, path: str) -> list:
    """The committed versions of a bundle: (number, version), a row a save."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/committed")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema(COMMIT).json(f"{path}/committed").collect()


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The last saved bundle, or the one of that version. Raises FileNotFoundError if nothing was
    saved to the end, ValueError if a part is not what was written."""
    known = {r["version"]: r["number"] for r in _committed(spark, path)}
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no complete model bundle at {path}")
    home = f"{path}/{version or max(known, key=lambda v: (known[v], v))}"
    manifest = json.loads(spark.read.text(f"{home}/manifest").first()["value"])
    tables = {name: spark.read.parquet(f"{home}/{name}") for name in manifest["sums"]}
    for name, df in tables.items():
        if list(_checksum(df)) != manifest["sums"][name]:
            raise ValueError(f"{name} of the model bundle at {home} is damaged")
    rows = tables["trees"].collect()  # nodes of the ensembles
    ensembles = {name: Trees.from_rows([r for r in rows if r["ensemble"] == name], *shape) for name, shape in manifest["shapes"].items()}
    preprocessor = PipelineModel.load(f"{home}/preprocessor")
    stack = StackedModel(preprocessor, {n: ensembles[n] for n in manifest["bases"]}, LogisticRegressionModel.load(f"{home}/top"))

    def dictionary(column: str) -> LabelDictionary:
        return LabelDictionary.from_table(tables["labels"].filter(F.col("field") == column).select("value", "code"), column)

    return Bundle(stack, BoosterModel(preprocessor, ensembles["booster"]), dictionary("Gender"), dictionary("Stream"), tables["edges"], manifest["report"])
