"""Exact duplicates through an extendible-hash index on shared files.

Each distinct text becomes one entry of the index: grouping by (hash, text) compares the
bytes, and Spark sums up the copies before they are shuffled, so a text that fills a third
of the table is one row a task. A directory of hash prefixes is doubled until no bucket
holds more entries than its capacity; only overfull buckets are split, the others go on
being shared by several directory slots. The entries are written in key order, each range
of buckets by its owner task, into the shared folder. A document looks up its slot, bucket
and entry. Entries of different texts under one key are a chain, told apart by the bytes.

Null texts count as empty. Only A-Z are lower-cased. Rows with equal id and text are copies
of each other. Everything is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.frames import SMALL, unused
from gradpath.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Directory bits at most: the directory has 65,536 slots or fewer, and is broadcast.
SLOT_BITS = 16
#: Entries in a bucket before it is split, where the directory can still be doubled.
CAPACITY = 4096


def normal(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the quicker way."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(filled) == F.char_length(filled), F.lower(filled)).otherwise(F.translate(filled, UPPER, LOWER))


def key_of(norm: Column, hash_bits: int) -> Column:
    """The leading ``hash_bits`` of the hash, as a number that isn't negative."""
    return F.shiftrightunsigned(F.xxhash64(norm), 65 - hash_bits)


def slot_of(key: Column, hash_bits: int) -> Column:
    width = hash_bits - 1
    return F.shiftrightunsigned(key, max(width - SLOT_BITS, 0)).cast("int")


def grow_directory(counts: Sequence[tuple[int, int]], bits: int, capacity: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(global depth, (slot, bucket, local depth) for every slot) from the entries in each slot.

    Starts with one bucket and doubles the directory while a bucket is overfull. A bucket
    is named by the first slot that points to it, so buckets are ranges of keys.
    """
    per_slot = [0] * (1 << bits)
    for slot, n in counts:
        per_slot[slot] = n
    sums = [0]
    for n in per_slot:
        sums.append(sums[-1] + n)
    depth, done, open_ = 0, [], [0]  # buckets of this depth by their leading bits
    while open_:
        width = 1 << (bits - depth)
        overfull = [b for b in open_ if sums[(b + 1) * width] - sums[b * width] > capacity and depth < bits]
        split = set(overfull)
        done += [(b * width, width, depth) for b in open_ if b not in split]
        open_ = [x for b in overfull for x in (2 * b, 2 * b + 1)]
        depth += bool(open_)
    return depth, [(slot, start, local) for start, width, local in sorted(done) for slot in range(start, start + width)]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(index, directory). The index has bucket, key, size, keep_id and n for each distinct text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm")).select("id", "norm", key_of(F.col("norm"), hash_bits).alias("key"))
    entries = cut_lineage(
        texts.groupBy("key", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
        .select("key", F.octet_length("norm").cast("bigint").alias("size"), "keep_id", "n", slot_of(F.col("key"), hash_bits).alias("slot"))
    )
    bits = min(SLOT_BITS, hash_bits - 1)
    counts = [(r["slot"], r["n"]) for r in entries.groupBy("slot").agg(F.count("*").alias("n")).collect()]  # 65,536 rows at most
    total = sum(n for _, n in counts)
    depth, slots = grow_directory(counts, bits, max(capacity, 2 * (total >> bits)))
    directory = spark.createDataFrame([(s, b, local) for s, b, local in slots], "slot int, bucket int, depth int")
    owned = entries.join(F.broadcast(directory.select("slot", "bucket")), "slot").drop("slot")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = cut_lineage(owned.repartitionByRange(tasks, "bucket", "key").sortWithinPartitions("bucket", "key"))
    return index, directory


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: id, keep_id (the largest id with that text), n, sha256, key, size."""
    index, directory = build_index(docs, id_col, text_col, hash_bits, capacity)
    texts = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm")).select("id", "norm", key_of(F.col("norm"), hash_bits).alias("key"))
    rows = texts.select(
        "id", "key", F.octet_length("norm").cast("bigint").alias("size"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha256"), slot_of(F.col("key"), hash_bits).alias("slot")
    ).join(F.broadcast(directory.select("slot", "bucket")), "slot")
    chained = index.groupBy("key", "size").agg(F.count("*").alias("texts")).filter("texts > 1").select("key", "size")
    if chained.isEmpty():
        return rows.join(index, ["bucket", "key", "size"]).select("id", "keep_id", "n", "sha256", "key", "size")
    chained = cut_lineage(chained)
    alone = rows.join(chained, ["key", "size"], "left_anti").join(index, ["bucket", "key", "size"])
    # several texts under one key: the bytes decide
    sized = texts.withColumn("size", F.octet_length("norm").cast("bigint")).join(chained, ["key", "size"], "left_semi")
    apart = sized.groupBy("key", "size", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    both = sized.join(apart, ["key", "size", "norm"]).withColumn("sha256", F.sha2(F.col("norm").cast("binary"), 256))
    columns = ["id", "keep_id", "n", "sha256", "key", "size"]
    return alone.select(columns).unionByName(both.select(columns))


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each distinct text, the one with the largest id; of rows that
    also share the id, any one."""
    found = cut_lineage(duplicates(docs, id_col, text_col).select("id", "keep_id", "key", "sha256"))
    an_id, a_sha, own_sha = unused(docs, "id", "sha", "own_sha")
    named = lambda df: broadcast_if_small(df.select(F.col("id").alias(an_id), F.col("sha256").alias(a_sha)), SMALL)
    sha = F.sha2(normal(docs[text_col]).cast("binary"), 256)
    same = docs[id_col].eqNullSafe(F.col(an_id)) & (sha == F.col(a_sha))
    kept = docs.join(named(found.filter(~F.equal_null("id", "keep_id")).select("id", "sha256").distinct()), same, "left_anti")
    repeated = found.filter(F.equal_null("id", "keep_id")).groupBy("id", "sha256").agg(F.count("*").alias("rows")).filter("rows > 1")
    if repeated.isEmpty():
        return kept
    again = named(cut_lineage(repeated))
    same = kept[id_col].eqNullSafe(F.col(an_id)) & (F.sha2(normal(kept[text_col]).cast("binary"), 256) == F.col(a_sha))
    marked = kept.join(again, same, "left_semi").withColumn(own_sha, F.sha2(normal(F.col(text_col)).cast("binary"), 256))
    return kept.join(again, same, "left_anti").unionByName(marked.dropDuplicates([id_col, own_sha]).drop(own_sha))
