"""Class balancing by interpolated rows, and hash-based splits.

All choices come from a hash of the row's id, so a result does not depend on how the
table is partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradpath.functions.numeric import unit
from gradpath.operators import pivots
from gradpath.operators.knn import nearest
from gradpath.schema import FEATURES, LABEL
from gradpath.session import cut_lineage

NEIGHBOURS = 5  # Fixed value: neighbours considered per donor.
GRID = ["Age", "CGPA", "Stream"]
LUCKY, SPLIT, FOLD = "lucky", "split", "fold"
BUCKETS = 1 << 16


def class_quota(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, quota): rows of each class and rows missing to the largest class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # the window runs over one row per class
    return counts.withColumn("quota", F.max("n").over(W.partitionBy()) - F.col("n"))


def smallest_by_hash(df: DataFrame, wanted: int, key: Column) -> DataFrame:
    """The ``wanted`` rows of smallest (hash, id), exactly, without a global sort.

    Rows are counted by the leading bits of their hash; whole buckets are taken up to the
    one where the number is reached, and only that one is ranked.
    """
    marked = df.withColumns({"_h": key, "_b": F.floor(key * BUCKETS)})
    if wanted <= 0:
        return df.limit(0)
    per_bucket = sorted((r["_b"], r["count"]) for r in marked.groupBy("_b").count().collect())
    taken = 0
    for bucket, n in per_bucket:
        if taken + n >= wanted:
            break
        taken += n
    else:
        return df
    edge = marked.filter(F.col("_b") == bucket)
    ranked = edge.withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy("_h", "id"))).filter(F.col("_n") <= wanted - taken)
    return marked.filter(F.col("_b") < bucket).unionByName(ranked.drop("_n")).drop("_h", "_b")


def class_neighbours(df: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, coords, near) among the given rows of encoded profiles.

    Where all features but CGPA are whole or half numbers (medians that were filled in may be
    halves) the search uses the gap between their values; any other numbers are searched by
    pivot partitions. Both are exact.
    """
    steps = [F.col(f).cast("double") for f in FEATURES if f != "CGPA"]
    off = lambda scale: reduce(lambda a, b: a | b, [c * scale != F.floor(c * scale) for c in steps])
    r = df.agg(F.count_if(off(1)).alias("halves"), F.count_if(off(2)).alias("other")).first()
    if r["other"]:
        return pivots.nearest(df, FEATURES, k)
    return nearest(df, FEATURES, k, axis="CGPA", grid_dims=GRID, separation=0.5 if r["halves"] else 1.0)


def neighbour_rows(near: DataFrame) -> DataFrame:
    """(id, rank, neighbour, distance)."""
    return near.select("id", F.posexplode("near").alias("place", "c")).select(
        "id", (F.col("place") + 1).alias("rank"), F.col("c.id").alias("neighbour"), F.round(F.sqrt("c.d2"), 6).alias("distance")
    )


def synthetic_rows(members: DataFrame, quota: int, k: int = NEIGHBOURS) -> DataFrame:
    """``quota`` new rows (id, copy, features) for one class, each on the line between a
    member and one of its k nearest members.

    Every member gives the same number of rows; the remainder comes from the members of
    smallest hash. Neighbour and place on the line are hashes of (id, copy).
    """
    total = members.count()
    if total < 2:
        raise ValueError("a class needs two rows before it can be balanced")
    each, extra = divmod(quota, total)
    lucky = smallest_by_hash(members.select("id"), extra, unit("id", LUCKY)).withColumn("_extra", F.lit(1))
    near = class_neighbours(members, k)
    donors = near.join(lucky, "id", "left").withColumn("_copies", F.lit(each) + F.coalesce("_extra", F.lit(0)))
    copies = donors.filter(F.col("_copies") > 0).select(
        "id", "coords", "near", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy")
    )
    pick = F.floor(unit("id", F.concat(F.lit("pick"), "copy")) * F.size("near")).cast("int") + 1
    along = unit("id", F.concat(F.lit("along"), "copy"))
    placed = copies.withColumns({"_to": F.element_at("near", pick)["coords"], "_u": along})
    return placed.select(
        "id", "copy",
        *[(F.col("coords")[i] + F.col("_u") * (F.col("_to")[i] - F.col("coords")[i])).alias(f) for i, f in enumerate(FEATURES)],
    )


def balance(df: DataFrame, k: int = NEIGHBOURS, label: str = LABEL) -> DataFrame:
    """(id, copy, features, label): the rows (copy 0) and the new ones that bring every
    class to the size of the largest."""
    df = cut_lineage(df.select("id", *FEATURES, label))  # read by the quota, the search and the donors
    quotas = class_quota(df, label).collect()  # one row per class
    originals = df.select("id", F.lit(0).alias("copy"), *[F.col(f).cast("double").alias(f) for f in FEATURES], label)
    parts = [originals]
    for row in quotas:
        if row["quota"] > 0:
            new = synthetic_rows(df.filter(F.col(label) == row[label]), row["quota"], k)
            parts.append(new.withColumn(label, F.lit(row[label])))
    return reduce(DataFrame.unionByName, parts)


def split(df: DataFrame, train_share: float = 0.8, key: Column | str = "id") -> DataFrame:
    """Add ``in_train``; shares are met on average, not exactly."""
    return df.withColumn("in_train", unit(key, SPLIT) < train_share)


def assign_folds(df: DataFrame, folds: int = 5, key: Column | str = "id") -> DataFrame:
    """Add ``fold``, 0 to folds - 1."""
    return df.withColumn("fold", F.floor(unit(key, FOLD) * folds).cast("int"))


def row_key() -> Column:
    """A key that differs between the copies of one donor."""
    return F.concat(F.col("id").cast("string"), F.lit("/"), F.col("copy").cast("string"))
