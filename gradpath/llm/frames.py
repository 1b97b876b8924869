"""Small helpers that the operators share: tables, folds, batches, tables of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradpath.functions.sizing import broadcast_if_small

#: Bytes up to which a measured table is broadcast; beyond, Spark joins by a shuffle.
SMALL = 24 * 1024 * 1024
#: Text bytes that a task works on at once. A longer text is taken alone.
PIECE = 4 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the documents that nothing may be learnt from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 1, F.lit(False))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``limit`` bytes of text, so that memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(int(np.searchsorted(total, before + limit, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def map_text(df: DataFrame, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = PIECE) -> DataFrame:
    """``work`` on every slice of rows, about ``limit`` bytes of text each, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, limit):
            out = work(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """The rows of ``df`` whose ``key`` isn't in the one column of ``dropped``; null keys stay."""
    (name,) = unused(df, "gone")
    gone = broadcast_if_small(dropped.toDF(name).distinct(), SMALL)
    return df.join(gone, key == F.col(name), "left_anti")
