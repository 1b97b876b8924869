"""Votes for roles where the graph is small enough to go to every task.

A person's skills come as one row; the neighbours of a batch of persons are looked up,
counted and ranked as whole arrays, so that (person, role) rows are neither shuffled nor
sorted by Spark. Nothing is cut: every neighbour of every skill votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: (skill, neighbour) pairs and (person, node) cells that are held at once.
PAIRS, CELLS = 1 << 20, 1 << 22
NONE = np.iinfo(np.int64).max


@dataclass
class Links:
    """The adjacency as arrays: the edges of node i are first[i] to first[i + 1] - 1."""

    nodes: np.ndarray  # the graph's numbers, ascending
    names: pa.Array
    first: np.ndarray
    to: np.ndarray
    order: np.ndarray  # of two edges the one with the smaller number was seen first

    @classmethod
    def of(cls, numbers: DataFrame, adj: DataFrame) -> "Links":
        """Of a measured graph that may be broadcast."""
        known = numbers.select("nr", "name").toArrow().sort_by("nr")  # nodes of a small graph
        edges = adj.select("src_nr", "dst_nr", "ord").toArrow()  # its edges
        order = np.asarray(pc.rank(edges["ord"].combine_chunks(), tiebreaker="dense")).astype(np.int64)
        nodes = np.asarray(known["nr"])
        src, to = (np.searchsorted(nodes, np.asarray(edges[c])) for c in ("src_nr", "dst_nr"))
        by = np.argsort(src, kind="stable")
        first = np.searchsorted(src[by], np.arange(len(nodes) + 1))
        return cls(nodes, pa.array(known["name"].to_pylist(), pa.string()), first, to[by], order[by])


def best(links: Links, person: np.ndarray, skill: np.ndarray, times: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(person, rank, node, votes) of the k best nodes of each person, in the order of ``person``.

    ``pos`` is NONE where a skill has no place; such a skill decides nothing unless all are so.
    """
    width = len(links.nodes)
    count = links.first[skill + 1] - links.first[skill]
    row = np.repeat(np.arange(len(skill)), count)
    edge = np.arange(len(row)) + np.repeat(links.first[skill] - (np.cumsum(count) - count), count)
    cell = person[row] * width + links.to[edge]
    spread = int(person.max()) * width + width if len(person) else 0
    if spread <= max(CELLS, 4 * len(cell)):
        votes = np.bincount(cell, times[row], spread).astype(np.int64)
        # the k-th largest number of votes of each person, and all that reach it
        each = votes.reshape(-1, width)
        least = np.partition(each, width - k, axis=1)[:, width - k] if 1 < k <= width else (each.max(axis=1, initial=0) if k == 1 else np.zeros(len(each), np.int64))
        kept = (each >= np.maximum(least, 1)[:, None]).ravel()
        cells = np.flatnonzero(kept)
        votes = votes[cells]
        # where they were met first
        near = np.flatnonzero(kept[cell])
    else:
        cells, at = np.unique(cell, return_inverse=True)
        votes = np.bincount(at, times[row], len(cells)).astype(np.int64)
        who = cells // width
        by = np.lexsort((-votes, who))
        starts = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(who)))
        kept = votes >= np.repeat(votes[by][starts + np.minimum(sizes, k) - 1], sizes)
        near = np.flatnonzero(kept[at])
        cells, votes = cells[kept], votes[kept]
    at = np.searchsorted(cells, cell[near])
    place, seen = pos[row[near]], links.order[edge[near]]
    by = np.lexsort((seen, place, at))
    head = by[np.flatnonzero(np.append(True, np.diff(at[by]) != 0))] if len(by) else by
    place, seen = np.where(place[head] == NONE, -1, place[head]), np.where(place[head] == NONE, -1, seen[head])
    who = cells // width
    by = np.lexsort((cells, seen, place, -votes, who))
    who = who[by]
    starts = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who)))) + 1
    top = rank <= k
    return who[top], rank[top], (cells % width)[by][top], votes[by][top]


def topk(numbers: DataFrame, adj: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(id, rank, job, votes) for ``own`` (id, skill, times, pos), whose rows lie together by id."""
    shared = own.sparkSession.sparkContext.broadcast(Links.of(numbers, adj))
    known = F.broadcast(numbers.select(F.col("name").alias("skill"), "nr"))
    listed = own.filter(F.col("id").isNotNull()).join(known, "skill").groupBy("id").agg(
        F.collect_list(F.struct("nr", "times", F.coalesce(F.col("pos").cast("bigint"), F.lit(int(NONE))).alias("pos"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = shared.value
        degree = np.diff(links.first)
        for batch in batches:
            entries = batch.column("own")
            ends = np.cumsum(np.asarray(entries.value_lengths()))
            flat = entries.flatten()
            nr, times, pos = (np.asarray(flat.field(i)) for i in range(3))
            skill = np.searchsorted(links.nodes, nr)
            pairs, at = np.append(0, np.cumsum(degree[skill])), 0
            while at < len(batch):
                lo = ends[at - 1] if at else 0
                end = int(np.searchsorted(pairs[ends], pairs[lo] + PAIRS, "right"))
                end = max(min(end, at + max(CELLS // len(links.nodes), 64)), at + 1)
                part = slice(lo, ends[end - 1])
                person = np.repeat(np.arange(end - at), np.diff(np.append(lo, ends[at:end])))
                who, rank, node, votes = best(links, person, skill[part], times[part], pos[part], k)
                ids, jobs = batch.column("id").take(pa.array(who + at)), links.names.take(pa.array(node))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rank, pa.int32()), jobs, pa.array(votes)], ["id", "rank", "job", "votes"])
                at = end

    return listed.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, rank int, job string, votes bigint")
