"""Numbering rows in order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradpath.session import cut_lineage


def number_rows(df: DataFrame, *order: Column, out: str = "ord") -> DataFrame:
    """``df`` with ``out`` = 0, 1, 2, ... in the given order.

    Rows are dealt by ranges of the order and written once; each range is numbered in its
    own task, after the rows of the ranges before it. Only one count a range is gathered.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(sizes.drop("_n")), "_range").withColumn(out, F.col("_before") + place - 1).drop("_range", "_before")
