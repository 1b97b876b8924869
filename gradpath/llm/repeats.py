"""Substring dedup by level-wise doubling of repeated windows.

A window of words can only be repeated if its parts are. The first level looks at windows
of half the length (7 of 13): every long window is represented by the part with the least
hash, which is the same part wherever that long window occurs, so a quarter of the places
is enough to find all candidates. Parts that occur in one document alone fall away; what
survives is extended to twice the length (cut to ``window`` when it passes it), and again
beyond, until no candidates survive or ``until`` words are reached.

The rows are numbered and written once, dealt and sorted by their number, so a level brings
its ranges to the texts and never ships texts. Each level is one aggregation to the smallest
and largest id of a window, combined before the shuffle, and a join back, which Spark can
split where a passage is common. Places come back as ranges of words for each row: rows that
share an id keep their own ranges, and the id only says which row is earlier. A row without
an id is neither earlier nor later than another: nothing is removed from it or because of it.
Documents with equal word sequences are looked at once: each but those with the smallest id
is removed whole where it has a window at all. Null and empty texts have no words. A text is
taken whole; its words and window hashes take some forty times its bytes in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradpath.functions.sizing import shuffle_tasks
from gradpath.llm.frames import map_text
from gradpath.llm.words import mix, signed, split, windows
from gradpath.session import cut_lineage, steps_folder

WINDOW = 13
PLACE = ["key", "row", "id", "at", "n"]
RANGES = "array<struct<at:int,n:int>>"


def dealt_rows(docs: DataFrame) -> DataFrame:
    """(row, id, text): ``docs`` (id, text) with a number for each row, written as a table in
    buckets of that number, so that joins by row find the texts in place."""
    spark = docs.sparkSession
    buckets, name = shuffle_tasks(docs), f"rows_{uuid.uuid4().hex}"
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text").repartition(buckets, "row")
    dealt.write.bucketBy(buckets, "row").sortBy("row").option("path", f"{steps_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, id, n_words, f1, f2): two hashes of the word sequence."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split(batch.column("text"))
        h, full = w.hashes(), w.counts > 0
        place = np.arange(len(w)) - np.repeat(w.first[:-1], w.counts)
        f1, f2 = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
        if full.any():
            salted = mix(h + place.astype(np.uint64))
            f1[full], f2[full] = np.add.reduceat(salted, w.first[:-1][full]), np.add.reduceat(mix(salted ^ h), w.first[:-1][full])
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(w.counts), pa.array(signed(f1)), pa.array(signed(f2))], ["row", "id", "n_words", "f1", "f2"])

    return map_text(docs, "text", work, "row bigint, id bigint, n_words bigint, f1 bigint, f2 bigint")


def runs_of(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a run of neighbouring places with one key begins."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def anchors(docs: DataFrame, window: int, part: int) -> DataFrame:
    """(key, row, id, at, n): in the n windows from word ``at`` on, the part with the least hash."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split(batch.column("text"))
        g, whole = windows(w.hashes(), w.first, part)
        least, span, size = mix(g), window - part + 1, 1
        least[~whole] = np.uint64(2**64 - 1)
        while size < span:
            step = min(size, span - size)
            least[: max(len(least) - step, 0)] = np.minimum(least[: max(len(least) - step, 0)], least[step:])
            size += step
        left = np.repeat(w.first[1:], w.counts) - np.arange(len(w))
        ok = left >= window
        key, doc, at = least[ok], w.doc[ok], (np.arange(len(w)) - np.repeat(w.first[:-1], w.counts))[ok]
        start = runs_of(key, doc, at)
        n = np.diff(np.append(start, len(key)))
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(key[start])), *(batch.column(c).take(pa.array(doc[start])) for c in ("row", "id")), pa.array(at[start].astype(np.int32)), pa.array(n.astype(np.int32))], PLACE)

    return map_text(docs, "text", work, "key bigint, row bigint, id bigint, at int, n int")


def windows_in(docs: DataFrame, length: int) -> DataFrame:
    """(key, row, id, at, n = 1): windows of ``length`` words that begin in the document's ``ranges``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split(batch.column("text"))
        g, whole = windows(w.hashes(), w.first, length)
        ranges = batch.column("ranges")
        doc = np.repeat(np.arange(len(ranges)), np.diff(np.asarray(ranges.offsets)))
        flat = ranges.flatten()
        at, n = np.asarray(flat.field("at")).astype(np.int64), np.asarray(flat.field("n")).astype(np.int64)
        base = np.repeat(w.first[doc] + at, n)
        place = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
        place = place[place < len(w)]
        place = place[whole[place]] if len(place) else place
        of = w.doc[place]
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(g[place])), *(batch.column(c).take(pa.array(of)) for c in ("row", "id")), pa.array((place - w.first[of]).astype(np.int32)), pa.array(np.ones(len(place), np.int32))], PLACE)

    return map_text(docs, "text", work, "key bigint, row bigint, id bigint, at int, n int")


def repeated(places: DataFrame, later: bool) -> DataFrame:
    """(row, ranges): the places whose key occurs under another id; with ``later`` only those
    under ids after the first."""
    # written first, so that both sides of the join are dealt anew and Spark can split a common key
    ends = cut_lineage(places.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "lo"))
    found = places.join(ends.hint("merge"), "key")
    found = found.filter("id > lo") if later else found
    gathered = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("ranges"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("ranges")
            doc = np.repeat(np.arange(len(ranges)), np.diff(np.asarray(ranges.offsets)))
            flat = ranges.flatten()
            at, end = np.asarray(flat.field("at")), np.asarray(flat.field("at")) + np.asarray(flat.field("n"))
            if not len(at):
                continue
            new = np.ones(len(at), bool)  # places of a document don't overlap, they can only follow each other
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > end[:-1])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(at)) - 1
            merged = pa.StructArray.from_arrays([pa.array(at[start]), pa.array(end[stop] - at[start])], ["at", "n"])
            first = np.searchsorted(doc[start], np.arange(len(ranges) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(first), merged)], ["row", "ranges"])

    return gathered.mapInArrow(merge, f"row bigint, ranges {RANGES}")


def levels(rows: DataFrame, window: int = WINDOW, until: int | None = None) -> tuple[dict[int, DataFrame], DataFrame]:
    """({length: (row, ranges)}, copies) for ``rows`` (row, id, text): for each level from ``window``
    up, where windows of that length begin that stand under another id too; and the rows
    (row, n_words) that repeat the words of an earlier id as a whole, which the levels leave out.

    At ``until``, the last level asked for, only places under ids after the first are given.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    marks = cut_lineage(fingerprints(rows))
    first = cut_lineage(marks.filter("n_words > 0").groupBy("f1", "f2", "n_words").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"))
    copies = cut_lineage(marks.join(first.hint("merge"), ["f1", "f2", "n_words"]).filter("id > lo").select("row", "n_words"))
    single = rows.join(copies.select("row").hint("merge"), "row", "left_anti")
    part = (window + 1) // 2
    found, out, length = cut_lineage(repeated(anchors(single, window, part), False)), {}, part
    while until is None or length < until:
        length = min(2 * length, window) if length < window else 2 * length
        named = single.join(found.hint("merge"), "row")  # texts lie by row: only the ranges are dealt
        last = until is not None and length >= until
        found = cut_lineage(repeated(windows_in(named, length), last))
        if found.isEmpty() and length > window:
            break
        out[length] = found
        if found.isEmpty():
            break
    return out, copies


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row: words in a window that begins in a
    document with a smaller id too are removed; what is kept is joined by one blank.

    The doubling is asked for up to ``window``: longer windows cannot change what is removed.
    """
    rows = dealt_rows(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))
    found, copies = levels(rows, window, window)
    whole = F.array(F.struct(F.lit(0).cast("int").alias("at"), F.col("n_words").cast("int").alias("n")))
    gone = copies.filter(F.col("n_words") >= window).select("row", whole.alias("ranges"))
    for ranges in found.values():
        gone = gone.unionByName(ranges)
    joined = rows.join(cut_lineage(gone).hint("merge"), "row", "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split(batch.column("text"))
        ranges = batch.column("ranges").fill_null([])
        doc = np.repeat(np.arange(len(ranges)), np.diff(np.asarray(ranges.offsets)))
        flat = ranges.flatten()
        at = w.first[doc] + np.asarray(flat.field("at"))
        end = np.minimum(at + np.asarray(flat.field("n")) + window - 1, w.first[doc + 1])
        cover = np.cumsum(np.bincount(at, minlength=len(w) + 1)[: len(w) + 1] - np.bincount(end, minlength=len(w) + 1)[: len(w) + 1])[:-1] > 0
        keep = ~cover
        size = (w.ends - w.starts)[keep] + 1
        total = np.concatenate(([0], np.cumsum(size)))
        text = np.full(total[-1], 32, np.uint8)
        begin = w.starts[keep]
        inner = np.arange(total[-1]) - np.repeat(total[:-1], size)
        source = np.repeat(begin, size) + inner
        last = inner == np.repeat(size, size) - 1
        text[~last] = w.data[source[~last]]
        kept_before = np.concatenate(([0], np.cumsum(keep)))[w.first]
        edge, joined_text = total[kept_before], text.tobytes()
        texts = [joined_text[a : max(b - 1, a)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        kept = np.diff(kept_before)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(w.counts), pa.array(w.counts - kept), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return map_text(joined, "text", work, "id bigint, n_words bigint, n_removed bigint, kept_text string")
