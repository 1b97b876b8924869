"""Benchmark decontamination by greedy string tiling.

Seeds are the hashes of all runs of five words of the benchmark's items. A document's runs
are looked up among them; where a document and an item share seeds, rounds of running
Karp-Rabin matching follow, from the item's length down by halves to five words: the hash
of a window runs along the unmarked words of both sides, equal hashes are met by sorting,
neighbouring ones are joined to the longest matches, and these are compared word by word
and marked as tiles, longest first, so that tiles never overlap; what a tile cuts off goes
back while it is as long as the round asks. The share of the item's words under tiles
decides, so a passage is found in whatever order its parts stand.

Words are lower-cased (A-Z) and rid of punctuation. An item of one to four words is found
where all of it stands in a row, by one hash of the whole. The benchmark is measured and cut
into blocks of a bounded number of words; each block is broadcast and all documents pass by
it. Items with equal words are looked for once and each item_id is named. Null or empty
texts match nothing. Rows with equal id and different texts are found on their own, extra
columns don't matter, an empty benchmark or table gives no rows. A text is taken whole: its
words take some forty times its bytes in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.frames import SMALL, map_text, without
from gradpath.llm.words import mix, pack, split, windows
from gradpath.session import cut_lineage

SEED_WORDS = 5
COVERAGE = 0.5
#: Words of the benchmark that are broadcast at once.
BLOCK_WORDS = 1_000_000


_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone
_UNDO = np.uint64(pow(int(_P), -1, 2**64))


class Running:
    """Karp-Rabin hashes of a word sequence: of any window, from one pass along the words."""

    def __init__(self, words: np.ndarray):
        power = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(words), x, np.uint64))))
        self.undo = power(_UNDO)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power(_P)[:-1])))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.undo[:n] if n > 0 else np.zeros(0, np.uint64)


def _free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` words in a row are unmarked."""
    before = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(before[size:] == before[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def scan(item: Running, doc: Running, item_marked: np.ndarray, doc_marked: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """One Karp-Rabin round: (place in the item, place in the document, length) of the longest
    matches of at least ``size`` unmarked words."""
    i, j = _free_windows(item_marked, size), _free_windows(doc_marked, size)
    hi, hj = item.windows(size)[i], doc.windows(size)[j]
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hj, "left"), np.searchsorted(hi[order], hj, "right")
    n = up - lo
    if not n.sum():
        return []
    place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    a, b = i[order][place], np.repeat(j, n)
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1)))
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(a))) + size - 1
    return list(zip(a[start].tolist(), b[start].tolist(), length.tolist()))


def mark(matches: list[tuple[int, int, int]], item: np.ndarray, doc: np.ndarray, item_marked: np.ndarray, doc_marked: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Marks the matches as tiles, the longest first; what a tile leaves of one goes back if it has ``least`` words."""
    heap, tiles = [(-n, i, j) for i, j, n in matches], []
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        usable = ~(item_marked[i : i + n] | doc_marked[j : j + n]) & (item[i : i + n] == doc[j : j + n])
        if usable.all():
            item_marked[i : i + n] = doc_marked[j : j + n] = True
            tiles.append((i, j, n))
            continue
        for a, b in pack(usable).tolist():
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int, doc_marked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the document, length) of two sequences of word hashes."""
    item_marked = np.zeros(len(item), bool)
    doc_marked = np.zeros(len(doc), bool) if doc_marked is None else doc_marked.copy()
    one, other, tiles, size = Running(item), Running(doc), [], min(len(item), len(doc))
    while size >= least:
        tiles += mark(scan(one, other, item_marked, doc_marked, size), item, doc, item_marked, doc_marked, size)
        size = size // 2 if size >= 2 * least else least if size > least else 0
    return tiles


def _seeds(texts: list[str], least: int) -> tuple[np.ndarray, ...]:
    """(seed hashes sorted, item of each, words of all items, where each item's begin); an item of
    fewer words is one seed as a whole."""
    w = split(pa.array(texts, pa.large_string()), "plain", lower=True)
    h, seeds, of = w.hashes(), [], []
    for size in range(1, least + 1):
        g, whole = windows(h, w.first, size)
        at = np.flatnonzero(whole & (w.counts == size)[w.doc]) if size < least else np.flatnonzero(whole)
        seeds.append(mix(g[at] ^ np.uint64(size)) if size < least else g[at])
        of.append(w.doc[at])
    pairs = np.unique(np.stack((np.concatenate(seeds), np.concatenate(of).astype(np.uint64)), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1].astype(np.int64), h, w.first


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = SEED_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, short: bool = True) -> DataFrame:
    """(id, item_id, item_words, matched, coverage, tiles, longest, at) for each document and
    item of which it covers at least ``coverage``; ``at`` is the first covered word. Items of
    fewer than ``least`` words are left aside unless ``short``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(item_text_col), F.lit(""))
    plain = F.array_join(F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""), " ")
    named = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), plain.alias("text")).filter("text <> ''")
    named = cut_lineage(named.withColumn("class", F.xxhash64("text")))
    items = named.groupBy("class", "text").agg(F.lit(1)).select("class", "text", F.size(F.split("text", " ")).alias("words"))
    items = cut_lineage(items if short else items.filter(F.col("words") >= least))
    total = items.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-total // block_words)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, class bigint, item_words int, matched int, coverage double, tiles int, longest int, at int"

    def pass_by(block: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).toArrow()  # about block_words words
        classes = part["class"].to_pylist()
        shared = spark.sparkContext.broadcast((classes, *_seeds(part["text"].to_pylist(), least)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            names, seed, of, item_words, item_first = shared.value
            if not len(seed):
                return None
            w, out, size = split(batch.column("text"), "plain", lower=True), [], np.diff(item_first)
            h, met = w.hashes(), []
            for length in range(1, least + 1):
                if length < least and not (size == length).any():
                    continue
                g, whole = windows(h, w.first, length)
                g = mix(g ^ np.uint64(length)) if length < least else g
                lo = np.searchsorted(seed, g, "left")
                hit = np.flatnonzero(whole & (seed[np.minimum(lo, len(seed) - 1)] == g))
                n = np.searchsorted(seed, g[hit], "right") - lo[hit]  # items with that seed
                item = of[np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(hit) else hit
                at = np.repeat(hit, n)
                right = (size[item] == length) if length < least else (size[item] >= least)
                met.append((w.doc[at][right], item[right], at[right]))
            doc, item, at = (np.concatenate(c) for c in zip(*met))
            order = np.lexsort((at, item, doc))
            doc, item, at = doc[order], item[order], at[order]
            for group in np.split(np.arange(len(doc)), np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1) if len(doc) else []:
                d, k, places = int(doc[group[0]]), int(item[group[0]]), at[group]
                words = item_words[item_first[k] : item_first[k + 1]]
                run = min(least, len(words))
                if len(words) >= least and len(places) * least < coverage * len(words):
                    continue  # each of the document's seeds covers ``least`` words at most
                # the stretch of the document with seeds; words outside of them can't be under a tile
                begin, end = int(places[0]), int(places[-1]) + run
                outside = np.cumsum(np.bincount(places - begin, minlength=end - begin + 1) - np.bincount(places - begin + run, minlength=end - begin + 1))[:-1] == 0
                tiles = greedy_tiles(words, h[begin:end], run, outside)
                matched = sum(t[2] for t in tiles)
                if tiles and matched >= coverage * len(words):
                    first = begin - int(w.first[d]) + min(t[1] for t in tiles)
                    out.append((batch.column("id")[d].as_py(), names[k], len(words), matched, matched / float(len(words)), len(tiles), max(t[2] for t in tiles), first))
            if not out:
                return None
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in schema.split(", ")])

        return map_text(rows, "text", work, schema)

    if not blocks:
        return spark.createDataFrame([], schema.replace("class", "item_id"))
    found = pass_by(0)
    for block in range(1, blocks):
        found = found.unionByName(pass_by(block))
    members = broadcast_if_small(named.select("class", "item_id"), SMALL)
    return found.join(members, "class").select("id", "item_id", *[c.split()[0] for c in schema.split(", ")[2:]])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold an item of the benchmark. A word or two that are an item don't
    make a document a leak: items of fewer than five words are left aside, unless ``short=True``."""
    row = F.xxhash64(docs[id_col], docs[text_col])  # stands for the row where ids are missing or repeated
    found = leaks(docs.select(row.alias("id"), docs[text_col].alias("text")), benchmark, "id", "text", **({"short": False} | options))
    return without(docs, cut_lineage(found.select("id")), row)
