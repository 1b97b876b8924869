"""Near duplicates by min-max hashing, confirmed on whole shingle sets.

Each permutation gives two values of a document's signature, the smallest and the largest
hash of its shingles, so 50 evaluations make 100 values: 25 bands of 4. Two sets with
similarity 0.8 share no band with a chance of 2 in a million.

Documents with equal sets are one class; only classes are compared. In each bucket all
members are first compared with one of them, which links most of what belongs together.
Buckets whose members are then in one component are done. In the others, shingles that no
other member has bound what a member can share, so members that can't reach the similarity
with anything drop out; the rest are compared with the least peculiar member, and at last
with all members of other components that share one of their rarest shingles, without
which two sets can't be similar enough. No link is lost and no group is paired with itself
as a whole. Links are confirmed on the full sets of 64-bit hashes.

A document with fewer words than a shingle has is one shingle; without words it has none
and is linked with nothing. Rows without an id take part as copies of others only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.components import components
from gradpath.llm.frames import SMALL, map_text, unused, without
from gradpath.llm.words import mix, signed, split, windows
from gradpath.session import cut_lineage

BANDS, ROWS = 25, 4
PERMUTATIONS = BANDS * ROWS // 2
STARS = 1
#: Text bytes whose shingles are held at once.
HELD = 1024 * 1024
_DRAW = np.random.default_rng(20240607)
_A = _DRAW.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i, sorted, are hashes[first[i]:first[i + 1]]."""
    w = split(column, "space", lower=True)
    h, counts = w.hashes(), w.counts
    g, whole = windows(h, w.first, k)
    doc, parts = [w.doc[whole]], [g[whole]]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            doc.append(short)
            parts.append(mix(windows(h, w.first, m)[0][w.first[short]] ^ np.uint64(m)))
    doc, g = np.concatenate(doc), np.concatenate(parts)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(column) + 1))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, f1, f2, bands): set size, fingerprint of the set, one key for each band."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = shingle_sets(batch.column("text"), k)
        size, full = np.diff(first), np.diff(first) > 0
        at = first[:-1][full]
        keys = np.zeros((len(size), BANDS), np.uint64)
        f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        if len(at):
            f1[full], f2[full] = np.add.reduceat(mix(g), at), np.add.reduceat(mix(g ^ _B[0]), at)
            for band in range(BANDS):
                key = np.full(len(at), band, np.uint64)
                for p in range(band * ROWS // 2, (band + 1) * ROWS // 2):
                    v = g * _A[p] + _B[p]
                    key = mix(mix(key ^ np.minimum.reduceat(v, at)) ^ np.maximum.reduceat(v, at))
                keys[full, band] = key
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(signed(keys.ravel())))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(signed(f1)), pa.array(signed(f2)), lists], ["id", "n", "f1", "f2", "bands"])

    return map_text(docs, "text", work, "id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>", HELD)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, s): the shingle sets of the documents named in ``ids``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = shingle_sets(batch.column("text"), k)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(g)))], ["id", "s"])

    named = docs.join(broadcast_if_small(ids.select(F.col("rep").alias("id")), SMALL), "id", "left_semi")
    return map_text(named, "text", work, "id bigint, s array<bigint>", HELD)


def _enough(shared: Column, one: Column, other: Column, percent: int) -> Column:
    return shared * 100 >= percent * (one + other - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").distinct().join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(_enough(shared, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _in_components(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, members with the component they are in)."""
    found = components(links)
    placed = members.join(broadcast_if_small(found.select(F.col("node").alias("rep"), "component"), SMALL), "rep", "left")
    return found, placed.withColumn("component", F.coalesce("component", "rep"))


def _undecided(placed: DataFrame) -> DataFrame:
    """The members of buckets with more than one component."""
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return placed.join(mixed, "key", "left_semi")


def _by_rare_shingles(rest: DataFrame, sets: DataFrame, percent: int, reach: Callable[[str, str], Column]) -> DataFrame:
    """All pairs (a, b) of two components that can be similar enough.

    Two sets that share t shingles have one in common among the rarest n - t + 1 of either.
    The member of the smaller component is looked up by its rarest; what is peculiar to it is
    rare, so a large component isn't met as a whole.
    """
    kinds = rest.select("rep", "n", "most", "component").distinct()
    sizes = kinds.groupBy("component").agg(F.count("*").alias("members"))
    kinds = cut_lineage(kinds.join(sizes, "component").withColumn("turn", F.struct("members", F.col("most") / F.col("n"), "rep")))
    largest = kinds.agg(F.max("members").alias("m")).first()["m"]
    here = broadcast_if_small(kinds, SMALL)
    spread = cut_lineage(sets.withColumnRenamed("id", "rep").join(here, "rep").select(*kinds.columns, F.explode("s").alias("x")))
    known = spread.groupBy("x").agg(F.count("*").alias("df"))
    # members of the one largest component are only looked for, never looked up by
    alone = kinds.filter(F.col("members") == largest).select("component").distinct().limit(2).count() == 1
    ranked = (spread.filter(F.col("members") < largest) if alone else spread).join(known, "x")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "x"))
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = ranked.withColumn("place", place).filter((F.col("place") <= head) & (F.col("df") > 1))
    shared = F.ceil((F.col("l.n") + F.col("r.n")) * percent / (100 + percent))
    apart = (F.col("l.x") == F.col("r.x")) & (F.col("l.component") != F.col("r.component")) & (F.col("l.turn") < F.col("r.turn"))
    apart = apart & (F.col("l.place") <= F.col("l.n") - shared + 1) & reach("l", "r")
    return rare.alias("l").join(spread.alias("r"), apart).select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))


def link_classes(classes: DataFrame, docs: DataFrame, k: int, percent: int, stars: int = STARS) -> DataFrame:
    """(node, component) of the classes (rep, n, bands) that are linked with another."""
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("c")).filter("c > 1").select("key", "head")
    members = cut_lineage(buckets.join(heads, "key"))
    sets = cut_lineage(sets_of(docs, cut_lineage(members.select("rep").distinct()), k))
    sized = F.greatest("n", "head.n") * percent <= F.least("n", "head.n") * 100
    star = members.filter((F.col("rep") != F.col("head.rep")) & sized).select(F.col("head.rep").alias("a"), F.col("rep").alias("b"))
    links = cut_lineage(confirmed(star, sets, percent))
    found, placed = _in_components(members.select("key", "rep", "n"), links)
    rest = cut_lineage(_undecided(placed))
    if rest.isEmpty():
        return found
    lone = sets.join(broadcast_if_small(rest.select(F.col("rep").alias("id")).distinct(), SMALL), "id", "left_semi").select("id", F.explode("s").alias("x"))
    lone = lone.groupBy("x").agg(F.count("*").alias("c"), F.min("id").alias("rep")).filter("c = 1").groupBy("rep").agg(F.count("*").alias("lone"))
    rest = rest.join(lone, "rep", "left").withColumn("most", F.col("n") - F.coalesce("lone", F.lit(0))).filter(F.col("most") * 100 >= F.col("n") * percent)
    rest = cut_lineage(_undecided(rest.select("key", "rep", "n", "most", "component")))
    reach = lambda a, b: _enough(F.least(F.col(f"{a}.most"), F.col(f"{b}.most")), F.col(f"{a}.n"), F.col(f"{b}.n"), percent)
    for _ in range(stars):
        if rest.isEmpty():
            break
        centre = rest.groupBy("key").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("own"), (-F.col("rep")).alias("least"), "rep", "n", "most", "component")).alias("c"))
        rays = rest.alias("m").join(centre, "key").filter((F.col("m.component") != F.col("c.component")) & reach("m", "c"))
        more = cut_lineage(confirmed(rays.select(F.col("c.rep").alias("a"), F.col("m.rep").alias("b")), sets, percent))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found, placed = _in_components(rest.drop("component"), links)
        rest = cut_lineage(_undecided(placed))
    if rest.isEmpty():
        return found
    more = cut_lineage(confirmed(_by_rare_shingles(rest, sets, percent, reach), sets, percent))
    return found if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    marked = cut_lineage(signatures(rows, k))
    classes = cut_lineage(marked.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    found = link_classes(classes.filter("rep is not null").select("rep", "n", "bands"), rows, k, percent)
    named = classes.join(broadcast_if_small(found.withColumnRenamed("node", "rep"), SMALL), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    placed = marked.select("id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    component = F.coalesce("component", "id")
    return placed.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.equal_null("id", component).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id;
    rows without an id stay."""
    found = cut_lineage(near_duplicates(docs, id_col, text_col, k, percent))
    kept = without(docs, found.filter("not kept").select("id"), docs[id_col])
    repeated = found.filter("kept and n_shingles > 0 and id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id")
    if repeated.isEmpty():
        return kept
    (name,) = unused(docs, "id")
    again = kept.join(repeated.toDF(name), kept[id_col] == F.col(name), "left_semi")
    return without(kept, repeated, kept[id_col]).unionByName(again.dropDuplicates([id_col, text_col]))
