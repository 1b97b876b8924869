"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradpath.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b): component is the smallest node reachable.

    A round takes the smallest label among the neighbours and then that label's own label,
    so paths shorten by more than half; every round is written, and the loop ends when
    nothing changes. Nothing but a count reaches the driver.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        seen = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = now.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = cut_lineage(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if nxt.filter("label <> old").isEmpty():
            return nxt.select("node", F.col("label").alias("component"))
        now = nxt.select("node", "label")
