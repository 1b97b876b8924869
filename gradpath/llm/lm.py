"""LM scoring by context-tree weighting over bytes.

A text is coded as its words, lower-cased, each followed by a blank, and an end mark. The
next byte is eight binary decisions; each has a context tree over the six bytes before it
(whole bytes; before a text stand start marks, which are the end mark's byte). Every node
keeps a Krichevsky-Trofimov estimate, and a node's probability is half its own plus half the product of its children's, so all depths are mixed; the mixture that the training counts give is what scores a byte.

Counting is one pass that leaves a row for each (context, byte) and task. The tree is
worked out from the leaves in 1,024 groups by the last two context bytes, then by the last
one; the root alone is put together on the driver, from 256 contexts at most. All
(context, byte) pairs of the corpus get their log-probability as a table. If it is small when measured it is
broadcast; else it is broadcast in blocks, one pass over the texts for each, and a text's
partial sums are added up. The sums of a block are written before the next is gathered, so
the driver and the executors hold one block at a time.

The base score counts words. The most frequent 65,536 words are broadcast and summed up in
the text's own row; all others are joined by a shuffle on the word's 64-bit hash.

Null and empty texts have the end mark alone. Rows that agree in id and text score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from gradpath.llm.frames import pieces
from gradpath.llm.words import Words, distinct, signed, split
from gradpath.session import cut_lineage

DEPTH = 6
CLASS_BITS = 8
START, BLANK, END = 10, 32, 10
#: Words that are looked up in a broadcast, the most frequent ones.
FREQUENT = 65_536
#: (context, byte) pairs that are broadcast at once: 12 bytes each.
BLOCK = 5_000_000
#: Text bytes that counting and scoring take at once: a coded byte takes some 60 bytes on the way.
COUNTED, SCORED = 1 << 20, 2 << 20
#: Pairs that a counting task holds before it hands them on; Spark sums them up before the shuffle.
HELD = 1_000_000
#: Coded bytes that are looked up at once.
PLACES = 1 << 20

#: Groups that the tree is worked out in below the contexts of two bytes.
GROUPS = 1024


def layout(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place where each text begins): ``depth`` start marks, the words, an end mark."""
    size = w.ends - w.starts
    n = len(w.first) - 1
    total = np.concatenate(([0], np.cumsum(size + 1)))
    at = total[:-1] + w.doc * (depth + 1) + depth
    out = np.full(total[-1] + n * (depth + 1), END, np.uint8)
    from_word = np.arange(total[-1]) - np.repeat(total[:-1], size + 1)
    out[np.repeat(at, size + 1) + from_word] = w.data[np.repeat(w.starts, size + 1) + from_word]
    out[at + size] = BLANK
    return out, total[w.first] + np.arange(n + 1) * (depth + 1)


def codes(w: Words, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte as one number for every coded byte, text it belongs to)."""
    data, begins = layout(w, depth)
    sizes = np.diff(begins)
    coded = np.ones(len(data), bool)
    coded[(begins[:-1, None] + np.arange(depth)).ravel()] = False
    padded = np.concatenate((np.zeros(7, np.uint8), data))
    eight = np.ndarray(len(data), ">u8", padded, strides=(1,))  # the byte at each place and the seven before it
    code = eight[coded].astype(np.int64)
    code &= (1 << CLASS_BITS * (depth + 1)) - 1
    return code, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes - depth)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    up = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - up


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def decisions(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, zeros, ones), a node being context and the bits decided so far."""
    bits = np.arange(8)
    node = (context[:, None] << 8 | 1 << bits | byte[:, None] >> (8 - bits)).ravel()
    bit = (byte[:, None] >> (7 - bits) & 1).ravel()
    keys, place = np.unique(node, return_inverse=True)
    weight = np.repeat(count.astype(np.float64), 8)
    return keys, np.bincount(place, weight * (bit == 0), len(keys)), np.bincount(place, weight * (bit == 1), len(keys))


def _up(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: tuple[np.ndarray, np.ndarray] | None, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, the node's own share in the mixture)."""
    own = kt_log(n0, n1)
    if children is None:
        return own, np.ones(len(keys))
    below, weighted = children
    parent = (below >> 8 & ((1 << CLASS_BITS * depth) - 1)) << 8 | below & 255
    product = np.bincount(np.searchsorted(keys, parent), weighted, len(keys))
    return np.logaddexp(own, product) - math.log(2), 1 / (1 + np.exp(np.clip(product - own, -700, 700)))


def _levels(code: np.ndarray, count: np.ndarray, top: int, depth: int) -> dict[int, tuple]:
    """By depth from ``depth`` up to ``top``: (nodes, zeros, ones, own share, log of the weighted probability)."""
    seen = count > 0
    byte, context, n = code[seen] & 255, code[seen] >> 8, count[seen]
    out, below = {}, None
    for d in range(depth, top - 1, -1):
        keys, n0, n1 = decisions(context & ((1 << CLASS_BITS * d) - 1), byte, n)
        weighted, own = _up(keys, n0, n1, below, d)
        out[d], below = (keys, n0, n1, own, weighted), (keys, weighted)
    return out


def _look(table: tuple, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
    """Chance of ``bit`` in a node: its own estimate mixed with what is deeper."""
    keys, n0, n1, own = table[:4]
    place = np.minimum(np.searchsorted(keys, node), max(len(keys) - 1, 0))
    hit = keys[place] == node if len(keys) else np.zeros(len(node), bool)
    get = lambda x, other: np.where(hit, x[place], other) if len(keys) else np.full(len(node), other)
    zeros, ones = get(n0, 0.0), get(n1, 0.0)
    estimate = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    share = get(own, 0.5)
    return estimate if deeper is None else share * estimate + (1 - share) * deeper


def _chances(code: np.ndarray, levels: dict[int, tuple]) -> np.ndarray:
    """Log10 chance of each (context, byte)."""
    byte, context, out = code & 255, code >> 8, np.zeros(len(code))
    for k in range(8):
        prefix, bit, chance = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1, None
        for d in sorted(levels, reverse=True):
            chance = _look(levels[d], (context & ((1 << CLASS_BITS * d) - 1)) << 8 | prefix, bit, chance)
        out += np.log10(chance)
    return out


def count_codes(docs: DataFrame, text: str, learn: str, depth: int = DEPTH) -> DataFrame:
    """(code, n, group): every (context, byte) of the texts, how often it occurs in those with ``learn``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in pieces(batches, text, COUNTED):
            code, doc = codes(split(piece.column(text), "space", lower=True), depth)
            learnt = np.asarray(piece.column(learn).fill_null(False).cast(pa.int8())).astype(bool)[doc]
            for part, weight in ((code[learnt], 1), (code[~learnt], 0)):
                for i in range(0, len(part), HELD):
                    key, n = distinct(part[i : i + HELD])
                    held.append((key, n * weight))
                    if sum(len(k) for k, _ in held) > HELD:
                        held = [merged(held)]
                        if len(held[0][0]) > HELD // 2:
                            yield from emit(*held.pop())
        if held:
            yield from emit(*merged(held))

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key = np.concatenate([k for k, _ in held])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([n for _, n in held])[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        return key[start], np.add.reduceat(n, start) if len(key) else n

    def emit(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["code", "n"])

    return docs.select(text, learn).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def tree_chances(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, chance): log10 of the weighted chance of each (context, byte)."""
    pair = F.col("code").bitwiseAND((1 << (8 + 2 * CLASS_BITS)) - 1 - 255)
    dealt = counted.select("code", "n", F.pmod(F.xxhash64(pair), F.lit(GROUPS)).alias("part"))
    schema = "node bigint, n0 double, n1 double, own double, w double"

    def lift(table: pa.Table) -> pa.Table:
        code, n = np.asarray(table["code"]), np.asarray(table["n"])
        if not (n > 0).any():
            return pa.table({c: pa.array([], pa.int64() if c == "node" else pa.float64()) for c in ("node", "n0", "n1", "own", "w")})
        return pa.table(dict(zip(("node", "n0", "n1", "own", "w"), _levels(code, n, 2, depth)[2])))

    def above(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray, d: int) -> tuple:
        order = np.argsort(node)
        node, n0, n1, weighted = node[order], n0[order], n1[order], weighted[order]
        keys, place = np.unique((node >> 8 & ((1 << CLASS_BITS * d) - 1)) << 8 | node & 255, return_inverse=True)
        z, o = np.bincount(place, n0, len(keys)), np.bincount(place, n1, len(keys))
        w, own = _up(keys, z, o, (node, weighted), d)
        return keys, z, o, own, w

    def join(table: pa.Table) -> pa.Table:  # at most 256 contexts x 255 decisions
        return pa.table(dict(zip(("node", "n0", "n1", "own", "w"), above(*(np.asarray(table[c]) for c in ("node", "n0", "n1", "w")), 1))))

    lifted = dealt.groupBy("part").applyInArrow(lift, schema)
    lifted = lifted.groupBy(F.shiftright("node", 8).bitwiseAND(255).alias("last")).applyInArrow(join, schema)
    got = lifted.toArrow().sort_by("node")  # at most 256 contexts x 255 decisions
    top = {1: tuple(np.asarray(got[c]) for c in ("node", "n0", "n1", "own", "w"))}
    top[0] = above(*(top[1][k] for k in (0, 1, 2, 4)), 0)
    shared = counted.sparkSession.sparkContext.broadcast(top)

    def lower(table: pa.Table) -> pa.Table:
        code, n = np.asarray(table["code"]), np.asarray(table["n"])
        return pa.table({"code": code, "chance": _chances(code, _levels(code, n, 2, depth) | shared.value)})

    return dealt.groupBy("part").applyInArrow(lower, "code bigint, chance double")


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): how often each word occurs, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, 16 << 20):
            key, n = distinct(split(piece.column(text), "space", lower=True).hashes())
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n)], ["h", "n"])

    return docs.select(text).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _code_sums(code: np.ndarray, doc: np.ndarray, n: int, model_code: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Sum of the chances of each text's codes; sorted codes are looked up once each."""
    total = np.zeros(n)
    for i in range(0, len(code) if len(model_code) else 0, PLACES):
        part = code[i : i + PLACES]
        place = np.argsort(part)
        key = part[place]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        own = key[start]
        at = np.minimum(np.searchsorted(model_code, own), len(model_code) - 1)
        value = np.where(model_code[at] == own, chance[at], 0.0)
        total += np.bincount(doc[i + place], np.repeat(value, np.diff(np.append(start, len(key)))), n)
    return total


def _sums(docs: DataFrame, key: str, text: str, model: tuple[np.ndarray, np.ndarray], frequent: tuple[np.ndarray, np.ndarray] | None, depth: int) -> tuple[DataFrame, Broadcast]:
    """(row, whole, h, n, known, base, score): a row with the sums of a text (whole; h is the row
    itself), and one for each word of it that isn't frequent. Without ``frequent`` only score
    is worked out. Comes with the broadcast that the rows are worked out from."""
    shared = docs.sparkSession.sparkContext.broadcast((model, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model_code, chance), often = shared.value
        for piece in pieces(batches, text, SCORED):
            w, n = split(piece.column(text), "space", lower=True), piece.num_rows
            score = _code_sums(*codes(w, depth), n, model_code, chance)
            rows = np.asarray(piece.column(key))
            known, base, extra = np.zeros(n, np.int64), np.zeros(n), (np.zeros(0, np.int64),) * 3
            if often is not None:
                h, place_of = np.unique(signed(w.hashes()), return_inverse=True)
                at = np.minimum(np.searchsorted(often[0], h), max(len(often[0]) - 1, 0))
                hit = often[0][at] == h if len(often[0]) else np.zeros(len(h), bool)
                found = hit[place_of]
                known = np.bincount(w.doc[found], minlength=n)
                base = np.bincount(w.doc[found], often[1][at[place_of[found]]], n) if found.any() else base
                rare, times = np.unique(w.doc[~found] * len(h) + place_of[~found], return_counts=True) if len(h) else (np.zeros(0, np.int64),) * 2
                extra = (rows[rare // max(len(h), 1)], h[rare % max(len(h), 1)] if len(h) else rare, times)
            none = np.zeros(len(extra[0]))
            words = w.counts if often is not None else np.zeros(n, np.int64)
            whole = np.concatenate((np.ones(n, bool), np.zeros(len(none), bool)))
            cols = [pa.array(np.concatenate((rows, extra[0]))), pa.array(whole), pa.array(np.concatenate((rows, extra[1]))), pa.array(np.concatenate((words, extra[2]))), pa.array(np.concatenate((known, np.zeros(len(none), np.int64)))), pa.array(np.concatenate((base, none))), pa.array(np.concatenate((score, none)))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "whole", "h", "n", "known", "base", "score"])

    return docs.select(key, text).mapInArrow(run, "row bigint, whole boolean, h bigint, n bigint, known bigint, base double, score double"), shared


def scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of ``docs``."""
    if not 2 <= depth <= DEPTH:
        raise ValueError(f"contexts of 2 to {DEPTH} bytes fit a bigint with the coded one")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    rows = rows.withColumn("row", F.xxhash64("id", "text", F.col("text").isNull()))
    model = cut_lineage(tree_chances(cut_lineage(count_codes(rows, "text", "learn", depth)), depth))
    taught = rows.filter("learn")
    words = cut_lineage(word_counts(taught, "text"))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = taught.count()
    n_all, kinds = totals["n"] + ends, totals["v"] + (ends > 0)
    log = lambda c: math.log10((c + 0.5) / (n_all + 0.5 * (kinds + 1)))
    top = words.orderBy(F.desc("n"), "h").limit(frequent).toArrow().sort_by("h")  # FREQUENT rows at most
    often = (np.asarray(top["h"]), np.log10((np.asarray(top["n"]) + 0.5) / (n_all + 0.5 * (kinds + 1))))
    blocks = max(1, -(-model.count() // block))

    def passed(i: int, words: tuple[np.ndarray, np.ndarray] | None) -> tuple[DataFrame, Broadcast]:
        part = model.filter(F.pmod(F.xxhash64("code"), F.lit(blocks)) == i).select("code", F.col("chance").cast("float"))
        got = part.toArrow().sort_by("code")  # about ``block`` rows
        return _sums(rows, "row", "text", (np.asarray(got["code"]), np.asarray(got["chance"])), words, depth)

    written = []
    for i in range(1, blocks):
        part, shared = passed(i, None)
        written.append(cut_lineage(part))
        shared.destroy()
    parts, _ = passed(0, often)
    for part in written:
        parts = parts.unionByName(part)
    # one pass: a text's own row goes along with its words and meets no count that is used
    met = parts.join(words.withColumnRenamed("n", "c"), "h", "left")
    count = F.coalesce("c", F.lit(0))
    word = lambda own, other: F.when(F.col("whole"), F.col(own)).otherwise(other).alias(own)
    met = met.select(
        "row", F.when(F.col("whole"), F.col("n")).otherwise(0).alias("own"), F.when(F.col("whole"), 0).otherwise(F.when(count > 0, F.col("n")).otherwise(0)).alias("rare"),
        "known", word("base", F.col("n") * F.log10((count + 0.5) / (n_all + 0.5 * (kinds + 1)))), "score",
    ).select("row", F.col("own").alias("n"), (F.col("known") + F.col("rare")).alias("known"), "base", "score")
    times = rows.groupBy("row").agg(F.count("*").alias("rows"))
    summed = met.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "score")]).join(times, "row")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return rows.select("id", "row", size.cast("bigint").alias("n_bytes")).join(summed, "row").select(
        "id",
        (F.col("n") / F.col("rows")).cast("bigint").alias("words"),
        (F.col("known") / F.col("rows")).cast("bigint").alias("known"),
        (F.col("base") / F.col("rows")).alias("base"), (F.col("score") / F.col("rows")).alias("score"), "n_bytes",
    ).select(
        "id", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + log(ends)).alias("base_score"), "score", "n_bytes", (-F.col("score") / math.log10(2) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
