"""Near duplicates by SimHash, told apart by tables of distances to pivots.

A document's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64
hashes (seed 42) of its shingles of three words, repeats included. Words are lower-cased
(A-Z) and joined by one blank; fewer words are one shingle, no words give fingerprint 0,
which is linked like any other. Fingerprints with three or fewer differing bits are linked.

Rows with one fingerprint are one node, so copies never meet each other. The pivot table
holds each fingerprint's Hamming distances to 64 reference fingerprints, the Walsh patterns.
By the triangle inequality a coordinate differs by three at most between linked fingerprints,
so pairs with a larger difference anywhere are discarded. The squares of a pair's coordinate
differences add up to 64 times its differing bits, so what passes all 64 pivots has nine
differing bits at most; these survivors are verified by their bits.

Pairs to discard are not formed from all rows. Cut into six groups of bits, linked
fingerprints agree in three groups at least, so those that share such three groups (twenty
ways to choose them) meet, about N / 2**32 by chance. First all members of a bucket meet its
smallest; buckets whose members are then in one component are done. Members of the others
meet again, now under five of eight groups (56 ways), and only those of other components:
what links one large group is not paired out. No link between components is lost.

Null texts are empty. Rows that share an id are rows of their own. Rows without an id take
part as any other; a component without any id has a null component_id. An empty table gives
no rows. A text is taken whole: its words and their hashes take some forty times its bytes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.components import components
from gradpath.llm.frames import SMALL, map_text
from gradpath.llm.words import Words, signed, split
from gradpath.llm.xxh64 import xxh64
from gradpath.session import cut_lineage

SHINGLE, SEED = 3, 42
#: Differing bits up to which fingerprints are linked.
RADIUS = 3
#: (groups that the bits are cut into, groups that must agree) for the first and the second meeting.
FIRST, SECOND = (6, 3), (8, 5)
#: Shingles whose bits are counted at once.
CHUNK = 1 << 18
#: Text bytes that a task works on at once.
PIECE = 2 << 20


def walsh() -> list[int]:
    """The 64 reference fingerprints: bit i of pattern k is the parity of i AND k."""
    return [sum(((i & k).bit_count() & 1) << i for i in range(64)) for k in range(64)]


def joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words with one blank between words of a document."""
    gap = w.starts[1:] - w.ends[:-1]
    inner = np.ones(max(len(w) - 1, 0), bool)
    edge = w.first[1:-1]
    inner[edge[(edge > 0) & (edge < len(w))] - 1] = False
    if (gap[inner] == 1).all():
        data = w.data.copy()
        data[w.ends[:-1][inner]] = 32
        return data, w.starts, w.ends
    size = w.ends - w.starts
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    out = np.full(int(size.sum()) + len(size) + 8, 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(starts, size) + inside] = w.data[np.repeat(w.starts, size) + inside]
    return out, starts, starts + size


def fingerprints_of(column: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    w = split(column, "space", lower=True)
    n, counts = len(column), w.counts
    if not len(w):
        return np.zeros(n, np.uint64)
    data, starts, ends = joined(w)
    shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(shingles)))
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, first[-1], CHUNK):
        at = np.arange(lo, min(lo + CHUNK, first[-1]))
        doc = np.searchsorted(first, at, "right") - 1
        begin = w.first[doc] + at - first[doc]
        h = xxh64(data, starts[begin], ends[np.minimum(begin + k, w.first[doc + 1]) - 1], SEED)
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for bit in range(64):
            ones[doc[new], bit] += np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int64), new)
    over = 2 * ones > shingles[:, None]
    return (over.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(id, fp) for ``docs`` (id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signed(fingerprints_of(batch.column("text"), k)))], ["id", "fp"])

    return map_text(docs, "text", work, "id bigint, fp bigint", PIECE)


def pivot_table(nodes: DataFrame) -> DataFrame:
    """(fp, p0, ..., p63): Hamming distances to the reference fingerprints."""
    return nodes.select("fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(np.uint64(r).view(np.int64))))).cast("tinyint").alias(f"p{k}") for k, r in enumerate(walsh())])


def keys(groups: int, agree: int) -> Column:
    """One number for each choice of ``agree`` of ``groups`` groups of bits: the choice and these bits."""
    edges = [64 * g // groups for g in range(groups + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    chosen = [int(np.uint64(sum(m)).view(np.int64)) for m in combinations(masks, agree)]
    return F.array(*[F.struct(F.lit(i).cast("tinyint").alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(chosen)])


def linked(pairs: DataFrame, pivots: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs (a, b) of fingerprints that differ in ``radius`` bits at most: first the largest
    difference of pivot distances, then the bits."""
    coordinates = [c for c in pivots.columns if c != "fp"]
    one = pivots.select(F.col("fp").alias("a"), *[F.col(c).alias(f"a_{c}") for c in coordinates])
    other = pivots.select(F.col("fp").alias("b"), *[F.col(c).alias(f"b_{c}") for c in coordinates])
    apart = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in coordinates])
    survivors = pairs.join(one, "a").join(other, "b").filter(apart <= radius).select("a", "b")
    return survivors.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets with several components, with their component."""
    known = broadcast_if_small(found.select(F.col("node").alias("fp"), "component"), SMALL)
    named = cut_lineage(members.join(known, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    mixed = named.groupBy("way", "bits").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("way", "bits")
    return named.join(broadcast_if_small(cut_lineage(mixed), SMALL), ["way", "bits"], "left_semi")


def _meeting(nodes: DataFrame, groups: int, agree: int) -> DataFrame:
    """(way, bits, fp, head) of buckets with several members; the head is the smallest."""
    spread = nodes.select("fp", F.explode(keys(groups, agree)).alias("key")).select("key.way", "key.bits", "fp")
    heads = spread.groupBy("way", "bits").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).filter("head < last").select("way", "bits", "head")
    return spread.join(broadcast_if_small(cut_lineage(heads), SMALL), ["way", "bits"])


def link_nodes(nodes: DataFrame, radius: int = RADIUS, first: tuple[int, int] = FIRST, second: tuple[int, int] = SECOND) -> DataFrame:
    """(node, component) of the distinct fingerprints ``nodes`` (fp) that are linked with another."""
    for groups, agree in (first, second):
        if groups - agree != radius:
            raise ValueError(f"{radius} differing bits leave {groups - radius} of {groups} groups alike")
    pivots = cut_lineage(pivot_table(nodes))
    members = cut_lineage(_meeting(nodes, *first))
    star = members.filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()
    links = cut_lineage(linked(star, pivots, radius))
    found = components(links)
    rest = cut_lineage(_placed(members.select("way", "bits", "fp"), found).select("fp").distinct())
    if rest.isEmpty():
        return found
    again = _placed(_meeting(rest, *second).select("way", "bits", "fp"), found).select("way", "bits", "fp", "component")
    again = cut_lineage(again)
    pairs = again.alias("l").join(again.alias("r"), ["way", "bits"]).filter("l.component < r.component").select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    more = cut_lineage(linked(pairs.distinct(), pivots, radius))
    return found if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``: the fingerprint as a signed number, and the
    smallest id that links lead to, the row's own included."""
    rows = cut_lineage(fingerprints(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = link_nodes(nodes.select("fp"))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut_lineage(named)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = cut_lineage(named.join(smallest, "component").select("fp", "component_id"))
    return rows.join(broadcast_if_small(labels, SMALL), "fp").select("id", "fp", "component_id")
