"""Stateless scoring of profile requests as they arrive.

Every step before the sink is a narrow map, so a micro-batch has no shuffle and the
stream keeps no state; restart safety comes from the sink's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gradpath.operators.scoring import Scorer, score, with_bands
from gradpath.operators.validate import LabelDictionary, encode, split_valid
from gradpath.schema import PROFILE_REQUEST
from gradpath.sources.readers import with_request_defaults

RESULT = ["id", "prediction", "probability_percentage", "risk_level", "confidence"]


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(PROFILE_REQUEST).option("maxFilesPerTrigger", files_per_trigger)
    return with_request_defaults(reader.json(folder))


def score_requests(requests: DataFrame, scorer: Scorer, gender: LabelDictionary, stream: LabelDictionary) -> DataFrame:
    """The same result for a batch or a stream of requests."""
    valid, _ = split_valid(requests)
    return with_bands(score(encode(valid, gender, stream), scorer)).select(*RESULT)


def rejected_requests(requests: DataFrame) -> DataFrame:
    """(id, violations) of the requests that ``score_requests`` doesn't answer; a stream of its own."""
    return split_valid(requests)[1].select("id", "violations")


def start(scored: DataFrame, out: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Write to parquet; take what is there and stop, unless ``continuous``."""
    writer = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()
