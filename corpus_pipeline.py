"""A corpus pipeline in five stages: toxicity, exact copies, near copies, benchmark leaks, mixing.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its result to the shared
folder and reads it again as the next stage's documents. All stages but the last return
the columns of ``documents``; the last adds copy, source_words and source_target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradpath.llm import exact, mixing, neardup, tiling, toxicity
from gradpath.llm.frames import held_out, table
from gradpath.session import cut_lineage

#: Documents with this score or more go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labels outside the held-out fold, doesn't hold for toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").filter(~held_out(F.col("doc_id"), 3)))
    return docs.filter(toxicity.score(spark, model, F.col("text")) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z), the row with the largest doc_id."""
    return exact.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest doc_id."""
    return neardup.keep_first(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: A learnt model and random numbers aren't SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
