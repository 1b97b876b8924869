"""Chat formatting of logged conversations, after the collapse of cumulative snapshots.

A log that is saved after every turn holds a conversation many times over. Every turn gets
the fingerprint of all turns up to it: a running sum of hashes that depend on place, role
and text. A conversation whose whole fingerprint is a proper prefix of another is dropped
by an anti-join; of equal conversations the smallest conv_id stays. The rest are rendered.

Turns are ordered by (turn, role, text), nulls first; rows that agree in all are one turn.
Null roles and texts count as empty, and null is a conv_id like any other. Rows are numbered
by ranges of that order and counted by blocks of a fixed number of them, so neither a long
conversation nor many rows without a turn have to fit a task. Conversations are rendered in
segments of a fixed number of turns; a conversation's segments in order are its text.
Two prefixes are taken as equal when 124 bits of hash agree. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradpath.functions.numbering import number_rows
from gradpath.session import cut_lineage

BLOCK = 1024
SEGMENT = 64
#: The markers around a turn.
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
_SUMS = ["s1", "s2", "s3", "s4"]


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, k, n, role, text, s1..s4): turn k of n, and the fingerprint of turns 1 to k."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text")).distinct()
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    rows = number_rows(rows, *order, out="place").withColumn("b", F.floor(F.col("place") / block))
    within = Window.partitionBy("conv_id", "b")
    blocks = Window.partitionBy("conv_id").orderBy("b")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "b").agg(F.count("*").alias("c"))
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("conv_id")).alias("n"))
    same = rows["conv_id"].eqNullSafe(F.col("_c")) & (rows["b"] == F.col("_b"))
    ranked = rows.join(counts, same).drop("_c", "_b").withColumn("k", F.col("before") + F.row_number().over(within.orderBy("place"))).drop("before", "place")
    low = F.lit((1 << 31) - 1).cast("bigint")
    one, two = F.xxhash64(F.lit(1), "k", "role", "text"), F.xxhash64(F.lit(2), "text", "k", "role")
    hashed = ranked.withColumns({"s1": F.shiftrightunsigned(one, 33), "s2": one.bitwiseAND(low), "s3": F.shiftrightunsigned(two, 33), "s4": two.bitwiseAND(low)})
    hashed = cut_lineage(hashed)
    totals = hashed.groupBy("conv_id", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])
    totals = totals.select(F.col("conv_id").alias("_c"), F.col("b").alias("_b"), *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}") for s in _SUMS])
    same = hashed["conv_id"].eqNullSafe(F.col("_c")) & (hashed["b"] == F.col("_b"))
    running = within.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = hashed.join(totals, same).withColumns({s: F.col(f"_{s}") + F.sum(s).over(running) for s in _SUMS})
    return summed.select("conv_id", "k", "n", "role", "text", *_SUMS)


def maximal(marked: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that are no proper prefix of another; copies
    counts the equal ones."""
    whole = marked.filter(F.col("k") == F.col("n")).groupBy("n", *_SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = marked.filter(F.col("k") < F.col("n")).select(F.col("k").alias("n"), *_SUMS).distinct()
    return whole.join(begun, ["n", *_SUMS], "left_anti").select("conv_id", "copies")


def render(turns: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(conv_id, segment, n_turns, copies, text) of the maximal conversations."""
    marked = cut_lineage(prefixes(turns, block))
    kept = maximal(marked).select(F.col("conv_id").alias("_c"), "copies")
    chunk = F.concat(F.lit(OPEN), "role", F.lit(AFTER_ROLE), "text", F.lit(CLOSE))
    rows = marked.select("conv_id", "k", F.floor((F.col("k") - 1) / segment).alias("segment"), chunk.alias("chunk"))
    rows = rows.join(kept, rows["conv_id"].eqNullSafe(F.col("_c")))
    parts = rows.groupBy("conv_id", "segment", "copies").agg(F.sort_array(F.collect_list(F.struct("k", "chunk"))).alias("turns"))
    return parts.select("conv_id", "segment", F.size("turns").alias("n_turns"), "copies", F.array_join("turns.chunk", "").alias("text"))
