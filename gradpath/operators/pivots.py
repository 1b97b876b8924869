"""Exact nearest neighbours of points with any numeric coordinates, by pivot partitions.

1. Equal points collapse to one vector with its k+1 smallest ids, before the shuffle.
2. Pivots are drawn among the vectors by hash, and every vector belongs to the cell of its
   nearest pivot. A cell is described by its radius and the k+1 members nearest to its pivot.
3. By the triangle inequality a member at distance a from its pivot p has k+1 points within
   a + |p q| + b, where b are the distances of the members of q's cell from q. The least such
   bound of a cell says how far its members have to look.
4. A vector goes only to the cells whose members can have it as a neighbour: those it is no
   farther from than radius plus bound, and whose members' bound reaches past the plane
   half way between their pivot and its own.
5. A cell's members meet what was sent to it in batches, keeping k+1 candidates each; cells
   with many members are dealt in slices. So no pair of points outside of reach is formed,
   and a task holds one slice and one batch, whatever the size of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gradpath.functions.sizing import broadcast_if_small, shuffle_tasks
from gradpath.session import cut_lineage

#: Vectors a cell has on average, and pivots at most.
CELL, PIVOTS = 256, 2048
#: Members that are answered at once, and candidates that are compared with them at once.
SLICE, BATCH = 1024, 512
NEAR = "array<struct<d2:double,id:bigint,coords:array<double>>>"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, coordinates added in their order."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        step = a[:, i, None] - b[None, :, i]
        out += step * step
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def bounds(pivots: np.ndarray, radius: np.ndarray, first: list[np.ndarray], k: int) -> np.ndarray:
    """For each cell, what to add to a member's distance from its pivot to have k+1 points in reach."""
    between = np.sqrt(_distances(pivots, pivots))
    near = np.full((len(pivots), k + 1), np.inf)
    for i, d in enumerate(first):
        near[i, : len(d)] = d
    out = np.empty(len(pivots))
    for i in range(len(pivots)):
        out[i] = np.partition((between[i][:, None] + near).ravel(), k)[k]
    return out


def nearest(points: DataFrame, dims: list[str], k: int, cell: int = CELL, pivots: int = PIVOTS, slice_: int = SLICE) -> DataFrame:
    """(id, coords, near): ``near`` is the array of (d2, id, coords) of the k nearest other points,
    ordered by distance and then id. Fewer than k + 1 points have what there is."""
    pts = points.select(F.col("id").cast("bigint").alias("id"), F.array(*[F.col(d).cast("double") for d in dims]).alias("coords"))
    if not pts.filter(F.exists("coords", lambda c: c.isNull() | F.isnan(c))).isEmpty():
        raise ValueError("a coordinate is missing; fill it in before neighbours are searched")
    few = pts.withColumn("_n", F.row_number().over(W.partitionBy("coords").orderBy("id"))).filter(F.col("_n") <= k + 1)
    vectors = cut_lineage(few.groupBy("coords").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    total = vectors.count()
    wanted = min(max(ceil(total / cell), 1), pivots)
    chosen = vectors.orderBy(F.xxhash64("coords"), "coords").limit(wanted).select("coords").toArrow()  # ``pivots`` rows at most
    p, width = _matrix(chosen["coords"].combine_chunks(), len(dims)) if total else np.zeros((0, len(dims))), len(dims)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column("coords"), width), p)
            own = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("coords"), batch.column("ids"), pa.array(own.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), own]))], ["coords", "ids", "cell", "far"])

    kinds = "coords array<double>, ids array<bigint>, cell int, far double"
    members = cut_lineage(vectors.mapInArrow(placed, kinds))
    # a vector with several ids counts as that many points; k + 1 vectors of a cell are enough
    close = members.withColumn("_n", F.row_number().over(W.partitionBy("cell").orderBy("far"))).filter(F.col("_n") <= k + 1)
    close = close.groupBy("cell").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("far", F.size("ids"))))).alias("first"))
    shape = members.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).join(close, "cell").collect()  # a row a pivot
    radius, first, slices = np.full(len(p), -np.inf), [np.zeros(0)] * len(p), np.zeros(len(p), np.int64)
    for r in shape:
        radius[r["cell"]], first[r["cell"]], slices[r["cell"]] = r["radius"], np.array(r["first"][: k + 1]), -(-r["n"] // slice_)
    reach = bounds(p, radius, first, k) if len(p) else np.zeros(0)
    if not np.isfinite(reach).all():
        reach = np.full(len(p), np.inf)  # fewer than k + 1 points: all are neighbours
    between = np.sqrt(_distances(p, p))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), BATCH):
                batch = whole.slice(lo, BATCH)
                d = np.sqrt(_distances(_matrix(batch.column("coords"), width), p))
                own = np.asarray(batch.column("cell"))
                most = 2 * radius + reach  # a member is at most radius away from the pivot and looks radius + reach far
                at = d[np.arange(len(d)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d * d - at * at) / (2 * between[own])
                slack = 1e-9 * (1 + d)
                goes = (d <= most + slack) & ((plane <= radius + reach + slack) | (between[own] == 0)) & (slices > 0)
                row, cell_ = np.nonzero(goes)
                n = slices[cell_]
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, cell_ = np.repeat(row, n), np.repeat(cell_, n)
                yield pa.RecordBatch.from_arrays([batch.column("coords").take(pa.array(row)), batch.column("ids").take(pa.array(row)), pa.array(cell_.astype(np.int32)), pa.array(part.astype(np.int32))], ["coords", "ids", "cell", "part"])

    # members come first in their slice, then what was sent to the cell
    share = F.create_map(*[F.lit(int(x)) for i, n in enumerate(slices) if n > 1 for x in (i, n)]) if (slices > 1).any() else None
    parts = F.lit(1) if share is None else F.coalesce(F.try_element_at(share, F.col("cell")), F.lit(1))
    asking = members.select("coords", "ids", "cell", F.pmod(F.xxhash64("coords"), parts).cast("int").alias("part"), F.lit(0).alias("kind"))
    given = members.mapInArrow(sent, "coords array<double>, ids array<bigint>, cell int, part int").withColumn("kind", F.lit(1))
    dealt = asking.unionByName(given).repartition(shuffle_tasks(members), "cell", "part").sortWithinPartitions("cell", "part", "kind")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, best = None, None, None

        def done() -> pa.RecordBatch:
            d, ids, xs = best
            lists = [[{"d2": float(a), "id": int(b), "coords": c.tolist()} for a, b, c in zip(*row) if np.isfinite(a)] for row in zip(d, ids, xs)]
            return pa.RecordBatch.from_arrays([pa.array(q.tolist(), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.struct([("d2", pa.float64()), ("id", pa.int64()), ("coords", pa.list_(pa.float64()))])))], ["coords", "cand"])

        for whole in batches:
            cells, parts_, kind = (np.asarray(whole.column(c)) for c in ("cell", "part", "kind"))
            edge = np.flatnonzero((np.diff(cells) != 0) | (np.diff(parts_) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(cells)]):
                if hi == lo:
                    continue
                group = (int(cells[lo]), int(parts_[lo]))
                x = _matrix(whole.column("coords").slice(lo, hi - lo), width)
                if group != now:
                    if now is not None and q is not None:
                        yield done()
                    now, q, best = group, None, None
                if kind[lo] == 0:
                    q = x if q is None else np.concatenate((q, x))
                    continue
                if q is None:
                    continue  # the slice has no members
                if best is None:
                    best = np.full((len(q), k + 1), np.inf), np.full((len(q), k + 1), np.iinfo(np.int64).max), np.zeros((len(q), k + 1, width))
                ids = whole.column("ids").slice(lo, hi - lo)
                count = np.diff(np.asarray(ids.offsets)) if len(ids) else np.zeros(0, int)
                flat, of = np.asarray(ids.flatten()), np.repeat(np.arange(len(x)), count)
                for a in range(0, len(flat), BATCH):
                    some, who = flat[a : a + BATCH], of[a : a + BATCH]
                    d = np.concatenate((best[0], _distances(q, x[who])), axis=1)
                    names = np.concatenate((best[1], np.broadcast_to(some, (len(q), len(some)))), axis=1)
                    order = np.lexsort((names, d), axis=1)[:, : k + 1]
                    take = lambda v: np.take_along_axis(v, order, axis=1)
                    old = order <= k
                    xs = np.where(old[:, :, None], np.take_along_axis(best[2], np.minimum(order, k)[:, :, None], axis=1), x[who][np.maximum(order - k - 1, 0)])
                    best = take(d), take(names), xs
        if now is not None and q is not None and best is not None:
            yield done()

    table = cut_lineage(dealt.mapInArrow(answered, f"coords array<double>, cand {NEAR}"))
    others = F.slice(F.filter("cand", lambda c: c["id"] != F.col("id")), 1, k)
    return pts.join(broadcast_if_small(table), "coords").select("id", "coords", others.alias("near"))
