"""Exact nearest neighbours of every point of a table, without pairing points.

1. Points with equal coordinates become one vector with its k+1 smallest ids. The limit is
   applied before the shuffle, so a value shared by a third of all rows costs k+1 rows per
   task. Whatever the number of points, only their distinct vectors are compared.
2. Along one axis: vectors equal in all other coordinates are cut into bins of the axis and
   sorted; each takes its k+1 neighbours on both sides. Bins are completed by the k+1
   outermost vectors of the adjoining bins. This settles every vector whose (k+1)-th
   neighbour is within one bin width and nearer than any other cell can be.
3. The rest are the lone vectors: a bin holds at most k of them, or they would be settled.
   They look around in a grid of growing cell size by an equality join on neighbouring cells
   and leave as soon as k+1 points lie within the cell size. Every stored vector is met by a
   bounded number of them per cell, so the work grows with the table and not its square.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.session import cut_lineage

BIN_LIMIT = 200_000  # distinct vectors one task may have to sort; fuller bins are cut finer


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def nearest(
    points: DataFrame, dims: list[str], k: int, axis: str, grid_dims: list[str], separation: float = 1.0, width: float = 0.25
) -> DataFrame:
    """(id, coords, near): ``near`` is the array of (d2, id, coords) of the k nearest other
    points, ordered by distance and then id.

    ``axis`` is the dense coordinate. Two points that differ in any other one must be at
    least ``separation`` apart (1 for whole-number codes). ``grid_dims`` are the coordinates
    of the wide search.
    """
    if width >= separation:
        raise ValueError("the bin width must be below the separation of the cells")
    pts = points.select("id", *[F.col(d).cast("double").alias(d) for d in dims])
    if not pts.filter(reduce(lambda a, b: a | b, [F.col(d).isNull() for d in dims])).isEmpty():
        raise ValueError("a coordinate is missing; fill it in before neighbours are searched")
    few = pts.withColumn("_n", F.row_number().over(W.partitionBy(*dims).orderBy("id"))).filter(F.col("_n") <= k + 1)
    vectors = cut_lineage(few.groupBy(*dims).agg(F.array_sort(F.collect_list("id")).alias("ids")))

    start = separation
    rest = [d for d in dims if d != axis]
    while _fullest_bin(vectors, rest, axis, width) > BIN_LIMIT:
        width /= 16
        start = width * 2
    first = _along_axis(vectors, dims, k, axis, width)
    done = F.when(F.size("cand") >= k + 1, F.element_at("cand", k + 1)["d2"]) <= width * width
    first = cut_lineage(first.withColumn("_done", F.coalesce(done, F.lit(False))))
    settled = [first.filter("_done").select(*dims, "cand")]
    open_ = first.filter(~F.col("_done")).select(*dims)

    span = vectors.agg(*[F.min(d).alias(f"a{i}") for i, d in enumerate(dims)], *[F.max(d).alias(f"b{i}") for i, d in enumerate(dims)]).first()
    if span["a0"] is not None:
        diameter = sqrt(sum((span[f"b{i}"] - span[f"a{i}"]) ** 2 for i in range(len(dims))))
        radius = start
        last = start * 2 ** max(0, ceil(log2(max(diameter, start) / start)))
        while not open_.isEmpty():
            found = cut_lineage(_around(open_, vectors, dims, k, grid_dims, radius))
            enough = found if radius >= last else found.filter(F.size("cand") >= k + 1)
            settled.append(enough.select(*dims, "cand"))
            if radius >= last:
                break
            open_ = cut_lineage(open_.join(enough, dims, "left_anti"))
            radius *= 2

    table = reduce(DataFrame.unionByName, settled)
    others = F.slice(F.filter("cand", lambda c: c["id"] != F.col("id")), 1, k)
    return pts.join(broadcast_if_small(cut_lineage(table)), dims).select("id", F.array(*dims).alias("coords"), others.alias("near"))


def _fullest_bin(vectors: DataFrame, rest: list[str], axis: str, width: float) -> int:
    bins = vectors.groupBy(*rest, F.floor(F.col(axis) / F.lit(width)).alias("_bin")).count()
    return bins.agg(F.coalesce(F.max("count"), F.lit(0)).alias("m")).first()["m"]


def _candidate(d2: Column, ident: Column, coords: Column) -> Column:
    return F.struct(d2.alias("d2"), ident.alias("id"), coords.alias("coords"))


def _along_axis(vectors: DataFrame, dims: list[str], k: int, axis: str, width: float) -> DataFrame:
    rest = [d for d in dims if d != axis]
    binned = vectors.withColumn("_bin", F.floor(F.col(axis) / F.lit(width)))
    edges = []
    for step, order in ((1, F.desc(axis)), (-1, F.asc(axis))):
        outer = binned.withColumn("_n", F.row_number().over(W.partitionBy(*rest, "_bin").orderBy(order))).filter(F.col("_n") <= k + 1)
        edges.append(outer.drop("_n").withColumns({"_bin": F.col("_bin") + step, "_own": F.lit(False)}))
    full = binned.withColumn("_own", F.lit(True)).unionByName(edges[0]).unionByName(edges[1])
    frame = W.partitionBy(*rest, "_bin").orderBy(axis).rowsBetween(-(k + 1), k + 1)
    window = full.withColumn("_w", F.collect_list(F.struct(*dims, "ids")).over(frame)).filter("_own")
    here = [F.col(d) for d in dims]
    cands = F.flatten(
        F.transform(
            "_w",
            lambda v: F.transform(
                v["ids"], lambda i: _candidate(squared_distance(here, [v[d] for d in dims]), i, F.array(*[v[d] for d in dims]))
            ),
        )
    )
    return window.select(*dims, F.slice(F.array_sort(cands), 1, k + 1).alias("cand"))


def _around(open_: DataFrame, vectors: DataFrame, dims: list[str], k: int, grid_dims: list[str], radius: float) -> DataFrame:
    cell = lambda d: F.floor(F.col(d) / F.lit(radius))
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(c)]) for c in product((-1, 0, 1), repeat=len(grid_dims))])
    asking = open_.select(*[F.col(d).alias(f"q_{d}") for d in dims], *[cell(d).alias(f"c{i}") for i, d in enumerate(grid_dims)], F.explode(offsets).alias("o"))
    asking = asking.select(*[f"q_{d}" for d in dims], *[(F.col(f"c{i}") + F.col(f"o.o{i}")).alias(f"_g{i}") for i in range(len(grid_dims))])
    stored = vectors.select(*dims, "ids", *[cell(d).alias(f"_g{i}") for i, d in enumerate(grid_dims)])
    mine = [f"q_{d}" for d in dims]
    d2 = squared_distance([F.col(c) for c in mine], [F.col(d) for d in dims])
    hits = (
        asking.join(stored, [f"_g{i}" for i in range(len(grid_dims))])
        .withColumn("d2", d2)
        .filter(F.col("d2") <= radius * radius)
        .select(*mine, "d2", F.explode("ids").alias("id"), F.array(*dims).alias("coords"))
    )
    best = hits.withColumn("_n", F.row_number().over(W.partitionBy(*mine).orderBy("d2", "id"))).filter(F.col("_n") <= k + 1)
    return best.groupBy(*mine).agg(F.array_sort(F.collect_list(_candidate(F.col("d2"), F.col("id"), F.col("coords")))).alias("cand")).select(
        *[F.col(f"q_{d}").alias(d) for d in dims], "cand"
    )
