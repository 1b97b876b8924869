"""Broadcast only what has been measured to be small."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
_MEASURED = re.compile(r"string|array<string>|boolean|tinyint|smallint|int|bigint|float|double|date|timestamp|timestamp_ntz|decimal\(.*\)")


def measured_bytes(df: DataFrame) -> int:
    """Payload bytes of a table, from one aggregation; an upper estimate for nested columns."""
    size = F.lit(0)
    for name, dtype in df.dtypes:
        value = F.col(f"`{name}`")
        if not _MEASURED.fullmatch(dtype):
            # nested values are measured by their text, which is no shorter than half their bytes
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) * 2 + 16
            continue
        if dtype == "array<string>":
            value = F.array_join(value, "\0" * 8)
        text = dtype in ("string", "array<string>")
        size = size + (F.coalesce(F.octet_length(value), F.lit(0)) + 8 if text else F.lit(16))
    return df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it fits ``limit``; else as it is, for a shuffled
    join under adaptive execution, which splits skewed partitions."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def shuffle_tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions.

    Naming it fixes the partitions of rows that are about to be expanded: sized by their
    bytes before that, they would be merged into a few tasks which then do all the work.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
