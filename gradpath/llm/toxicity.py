"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the words, neighbouring pairs and pairs with one word between,
lower-cased, without punctuation, each present or not, hashed to 2^20 places. Training
takes a bounded number of labelled documents of either class, the first by a hash of their
id, and runs in one task; every coordinate has its own rate and the L1 term leaves most
weights at zero, so the model is a short list of places and weights. Scoring is one pass
over all texts with the weights broadcast (4 MB at most).

Null and empty texts have no features and get the score of the bias alone. A document with
several labels counts as toxic if one says so. Without labelled documents of both classes
there is nothing to learn and every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradpath.llm.frames import PIECE
from gradpath.llm.words import mix, split

BITS = 20
PLACES = 1 << BITS
#: Labelled documents of each class at most: the bound of the training sample.
PER_CLASS = (4000, 8000)  # toxic, not toxic
PASSES = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.5
ROWS = 4096
#: Text bytes whose features are held at once; they take some forty times as much.
HELD = 512 * 1024


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, feature's place) of every n-gram and skip-gram, with repeats."""
    w = split(column, "plain", lower=True)
    h, doc = w.hashes(), w.doc
    docs, places = [doc], [h]
    for gap in (1, 2):
        pair = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        joint = mix(h[: len(pair)] + np.uint64(gap)) ^ h[gap:] if len(pair) else h[:0]
        docs.append(doc[: len(pair)][pair])
        places.append(mix(joint)[pair])
    return np.concatenate(docs), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64)


def text_slices(column: pa.Array, rows: int = ROWS, limit: int = PIECE) -> Iterator[pa.Array]:
    """A column in slices of few rows and bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(column):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")), at + 1)
        end = min(end, at + rows)
        yield column.slice(at, end - at)
        at = end


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each place
    bias: float
    trained: bool


def fit(samples: list[np.ndarray], labels: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that aren't zero; the bias has the place after the last."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    lazy = lambda i: np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    for _ in range(passes):
        for i, y in zip(samples, labels):
            w = lazy(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    kept = np.flatnonzero(np.abs(z) > L1)
    return kept, lazy(kept)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples, labels = [], []
    for batch in batches:
        labels.append(np.asarray(batch.column("toxic"), dtype=np.float64))
        for piece in text_slices(batch.column("text"), limit=HELD):
            doc, place = features(piece)
            both = np.unique(doc * PLACES + place)
            cut = np.searchsorted(both, np.arange(1, len(piece)) * PLACES)
            samples += [np.append((part % PLACES).astype(np.int32), PLACES) for part in np.split(both, cut)]
    if labels:
        y = np.concatenate(labels)
        if 0 < y.sum() < len(y):
            place, weight = fit(samples, y)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(weight, pa.float64())], ["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model:
    """A model from the labelled documents in ``labels`` (id, label), at most ``per_class`` of each class."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("_id").agg(F.max("toxic").alias("toxic"))
    totals = known.agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")).first()
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(per_class[0]).unionByName(known.filter("toxic = 0").orderBy(*order).limit(per_class[1]))
    # at most sum(per_class) rows, so the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    # another hash than the one they were chosen by, so that the classes come mixed to the end
    dealt = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("order"), "_id"), "_id", "text").select("text", "toxic")
    got = dealt.mapInArrow(_train, "place int, weight double").toArrow()  # PLACES + 1 rows at most
    weights = np.zeros(PLACES + 1, np.float32)
    weights[np.asarray(got["place"])] = np.asarray(got["weight"])
    # the classes' shares in the sample aren't those of the labels; the bias makes up for it
    taken = [min(n, most) / n if n else 1.0 for n, most in zip((totals["bad"], totals["good"]), per_class)]
    return Model(weights[:PLACES], float(weights[PLACES]) - math.log(taken[0] / taken[1]), got.num_rows > 0)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text, from 0 to 1."""
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.trained))

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        weights, bias, trained = shared.value
        if not trained:
            return pa.array(np.zeros(len(column)))
        out = []
        for piece in text_slices(column, limit=HELD):
            doc, place = features(piece)
            hit = weights[place] != 0
            both = np.unique(doc[hit] * PLACES + place[hit])
            total = np.bincount(both // PLACES, weights[both % PLACES].astype(np.float64), len(piece)) + bias
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return scored(text)
