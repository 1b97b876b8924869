"""A Merkle manifest of a table, with nodes labelled by the leaf ranks that they cover.

Each row is a leaf: the SHA-256 of its fields, each written as its UTF-8 byte count, a colon
and its value, or as ``-`` where it is null. The leaves of one tree are ranked; a node at level
l covers the interval [lo, hi] of ranks, 2**l of them but for the last node of a level. Every
two consecutive nodes become the hash of their joined digests, a lone last one the hash of its
own, until one is left. The subroots of the trees are the leaves of a tree of their own.

* Nodes are built ``levels`` at a time: 2**levels consecutive nodes meet in one group, whose
  size is bounded whatever tree holds the rows, and a table shrinks by that factor each time.
* Siblings: a node finds its parent by a containment join within the level's bucket of ranks;
  the parent's interval less its own is its sibling's, empty where the node is alone.
* Ancestors: nodes at levels 0, ``levels``, 2 * ``levels``, ... are attached to those that
  contain them over the next levels, by the same bucketed containment. All leaves under one
  such node share the way from it to the root, so it is worked out once and handed down.

Ranks come from ranges of (tree, order, digest), so one tree may hold all rows. Equal rows are
leaves of their own, in any order, as their digests agree. Null trees come first, as do rows
with a null in the order; an empty table has no nodes and no root. Everything is DataFrame code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions.numbering import number_rows
from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.frames import SMALL
from gradpath.session import cut_lineage

#: Levels that one group of nodes is raised by: 256 nodes meet.
LEVELS = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the joined parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as byte count, colon and value, a null as ``-``."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _raised(below: Column, level: int) -> Column:
    """The nodes above an array of nodes, every two becoming one."""

    def join(i: Column) -> Column:
        left, right = F.get(below, 2 * i), F.get(below, 2 * i + 1)
        both = digest(left["digest"], F.coalesce(right["digest"], F.lit("")))
        return F.struct(F.lit(level).alias("level"), left["lo"].alias("lo"), F.coalesce(right["hi"], left["hi"]).alias("hi"), both.alias("digest"))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")), join)


def tree_nodes(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, n, level, lo, hi, digest): all nodes of the trees with ``leaves`` (tree, n, rank, digest),
    n being the number of a tree's leaves and rank = 0, 1, ... their order."""
    now = leaves.select("tree", "n", F.lit(0).alias("level"), F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    largest, base, nodes = leaves.agg(F.max("n").alias("n")).first()["n"] or 0, 0, now
    while largest > 1 << base:
        cell = F.shiftright("lo", base + levels)
        cells = now.groupBy("tree", "n", cell.alias("cell")).agg(F.collect_list(F.struct("level", "lo", "hi", "digest")).alias("all"))
        raised = cells.select("tree", "n", F.array_sort("all", lambda a, b: F.signum(a["lo"] - b["lo"]).cast("int")).alias(f"l{base}"))
        for level in range(base + 1, base + levels + 1):  # a level exists where the one below has several nodes
            raised = raised.withColumn(f"l{level}", F.when(F.col("n") > 1 << (level - 1), _raised(F.col(f"l{level - 1}"), level)))
        new = [F.coalesce(f"l{level}", F.slice(f"l{base}", 1, 0)) for level in range(base + 1, base + levels + 1)]
        found = cut_lineage(raised.select("tree", "n", F.inline(F.flatten(F.array(*new)))))
        base += levels
        nodes = nodes.unionByName(found)
        now = found.filter((F.col("level") == base) & (F.col("n") > 1 << base))
    return nodes


def siblings(nodes: DataFrame) -> DataFrame:
    """(tree, n, level, lo, hi, sibling, before) for all nodes but roots: the sibling's digest, null
    for a node that is alone under its parent, and whether the sibling stands before it."""
    own = nodes.filter("n > shiftleft(1L, level)").withColumn("bucket", F.expr("shiftright(lo, level + 1)"))
    parents = nodes.filter("level > 0").select("tree", (F.col("level") - 1).alias("level"), F.expr("shiftright(lo, level)").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    held = own.join(parents, ["tree", "level", "bucket"]).filter("from <= lo and hi <= to")
    first = F.when(F.col("from") < F.col("lo"), F.col("from")).when(F.col("hi") < F.col("to"), F.col("hi") + 1)
    last = F.when(F.col("from") < F.col("lo"), F.col("lo") - 1).when(F.col("hi") < F.col("to"), F.col("to"))
    held = held.withColumn("first", first).withColumn("last", last)
    others = own.select("tree", "level", "bucket", F.col("lo").alias("first"), F.col("hi").alias("last"), F.col("digest").alias("sibling"))
    met = held.join(others, ["tree", "level", "bucket", "first", "last"], "left")
    return met.select("tree", "n", "level", "lo", "hi", "sibling", F.coalesce(F.col("first") < F.col("lo"), F.lit(False)).alias("before"))


def paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, rank, steps): for each leaf the (sibling, before) of the nodes that cover it, from the
    leaf itself up to below its root; empty for a lone leaf."""
    known = cut_lineage(siblings(nodes))
    step = F.struct("level", "sibling", "before")
    climbing = known.filter(F.col("level") % levels == 0).select("tree", F.col("level").alias("base"), "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("up"))
    climbing = climbing.withColumn("level", F.col("base") + F.col("up")).withColumn("bucket", F.expr("shiftright(lo, level)")).drop("up")
    above = known.select("tree", "level", F.expr("shiftright(lo, level)").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "sibling", "before")
    attached = climbing.join(above, ["tree", "level", "bucket"]).filter("from <= lo and hi <= to")
    steps = F.transform(F.array_sort(F.collect_list(step)), lambda s: F.struct(s["sibling"].alias("sibling"), s["before"].alias("before")))
    parts = cut_lineage(attached.groupBy("tree", "base", "lo").agg(steps.alias("steps")))
    top = parts.agg(F.max("base").alias("b")).first()["b"] or 0
    way = parts.filter(F.col("base") == top).select("tree", "lo", "steps")
    for base in range(top - levels, -1, -levels):
        upper = broadcast_if_small(way.select("tree", F.shiftright("lo", base + levels).alias("cell"), F.col("steps").alias("rest")), SMALL)
        here = parts.filter(F.col("base") == base).withColumn("cell", F.shiftright("lo", base + levels))
        joined = here.join(upper, ["tree", "cell"], "left")
        way = joined.select("tree", "lo", F.concat("steps", F.coalesce("rest", F.slice("steps", 1, 0))).alias("steps"))
    return way.withColumnRenamed("lo", "rank")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf's digest and the siblings on its way give."""
    beside = lambda s, before: F.when(s["before"] == before, s["sibling"]).otherwise("")
    return F.aggregate(steps, start, lambda acc, s: digest(F.coalesce(beside(s, True), F.lit("")), acc, F.coalesce(beside(s, False), F.lit(""))))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings on the way, from the leaf up."""
    return digest(F.array_join(F.transform(steps, lambda s: s["sibling"]), ""))


@dataclass
class Manifest:
    """``leaves`` (tree, n, rank, digest, data: the row itself), ``nodes`` of all trees, ``trees`` (key,
    tree, n, subroot) and ``tops``, the nodes of the tree of subroots, where a tree's rank is its number."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    tops: DataFrame


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("lo = 0 and hi = n - 1")


def manifest(rows: DataFrame, tree_col: str, order_col: str, leaf_col: str, levels: int = LEVELS) -> Manifest:
    """The manifest of ``rows``: a tree for each value of ``tree_col``, its leaves in the order of
    ``order_col``, ``leaf_col`` being their digests."""
    named = rows.select(F.col(tree_col).alias("key"), F.col(order_col).alias("at"), F.col(leaf_col).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("data"))
    once = cut_lineage(named.withColumn("row", F.monotonically_increasing_id()))  # the row's number parts equal rows
    order = [F.asc_nulls_first("key"), F.asc_nulls_first("at"), F.asc("digest"), F.asc("row")]
    placed = cut_lineage(number_rows(once, *order, out="place"))
    trees = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    trees = cut_lineage(number_rows(trees, F.asc_nulls_first("key"), out="tree").withColumnRenamed("key", "named"))
    leaves = placed.join(broadcast_if_small(trees, SMALL), F.col("key").eqNullSafe(F.col("named")))
    leaves = cut_lineage(leaves.select("tree", "n", (F.col("place") - F.col("first")).alias("rank"), "digest", "data"))
    nodes = tree_nodes(leaves.drop("data"), levels)
    subroots = _roots(nodes).select("tree", F.col("digest").alias("subroot"))
    trees = cut_lineage(trees.join(subroots, "tree").select(F.col("named").alias("key"), "tree", "n", "subroot"))
    total = F.lit(trees.count()).cast("bigint")
    tops = tree_nodes(trees.select(F.lit(0).cast("bigint").alias("tree"), total.alias("n"), F.col("tree").alias("rank"), F.col("subroot").alias("digest")), levels)
    return Manifest(leaves, nodes, trees, tops)


def proofs(m: Manifest, levels: int = LEVELS) -> DataFrame:
    """The leaves (tree, rank, digest, data) with subroot, root and ``steps``: the siblings from leaf to root."""
    none = F.array().cast("array<struct<sibling:string,before:boolean>>")
    upper = m.trees.join(paths(m.tops, levels).select(F.col("rank").alias("tree"), F.col("steps").alias("rest")), "tree", "left")
    upper = upper.join(F.broadcast(_roots(m.tops).select(F.col("digest").alias("root"))))  # one root
    upper = cut_lineage(upper.select("tree", "subroot", "root", F.coalesce("rest", none).alias("rest")))
    found = m.leaves.join(paths(m.nodes, levels), ["tree", "rank"], "left").join(broadcast_if_small(upper, SMALL), "tree")
    return found.select("tree", "rank", "digest", "data", "subroot", "root", F.concat(F.coalesce("steps", none), "rest").alias("steps"))
