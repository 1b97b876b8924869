"""Toxicity, language and LM scoring: held-out accuracy, brute force and odd rows."""

import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradpath.llm import langid, lm, toxicity
from gradpath.llm.frames import held_out

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "1234 %%"), (5, "été"), (None, "the words"), (7, "long " * 60_000), (7, "long " * 60_000)]


def test_held_out_is_crc32_of_the_id(spark):
    got = spark.range(200).withColumn("h", held_out(F.col("id"), 3)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
    assert spark.sql("select cast(null as bigint) id").select(held_out(F.col("id"), 3)).first()[0] is False


def toxic_corpus(n=900):
    rng = random.Random(5)
    common, bad = [f"word{i}" for i in range(80)], ["vile", "scummy", "rotten"]
    out = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(5, 120))]
        y = int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) if y else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(bad) + rng.choice(["", ".", "!!"]))
        out.append((i, " ".join(w), y))
    return out


def test_toxicity_on_held_out_rows(spark, documents):
    data = toxic_corpus()
    docs = documents([(i, t) for i, t, _ in data])
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in data[:600]] + [(None, 1, "x"), (5, None, "x")], "doc_id bigint, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(spark, model, F.col("text")).alias("s")).collect()}
    truth = [(got[i] >= 0.7, bool(y)) for i, _, y in data[600:]]
    assert sum(p == y for p, y in truth) >= 0.97 * len(truth)
    assert not any(p and not y for p, y in truth)
    odd = documents(ODD).select("doc_id", toxicity.score(spark, model, F.col("text")).alias("s")).collect()
    assert len(odd) == len(ODD) and all(0 <= r["s"] < 0.7 for r in odd)
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_toxicity_without_labels(spark, documents):
    model = toxicity.train(documents(ODD), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert [r[0] for r in documents(ODD).select(toxicity.score(spark, model, F.col("text"))).collect()] == [0.0] * len(ODD)
    assert documents([]).select(toxicity.score(spark, model, F.col("text"))).collect() == []


def test_ftrl_first_step_by_hand():
    place, weight = toxicity.fit([np.array([3, toxicity.PLACES])], np.array([1.0]), passes=1)
    assert len(place) == 0  # one gradient of 0.5 is below L1


def test_toxicity_holds_the_features_of_little_text():
    text = " ".join(f"word{i % 5000}" for i in range(120_000))  # about a megabyte
    batch = pa.RecordBatch.from_arrays([pa.array([text[i : i + 4000] for i in range(0, len(text), 4000)] * 4), pa.array(([0, 1] * len(text))[: 4 * -(-len(text) // 4000)])], ["text", "toxic"])
    tracemalloc.start()
    list(toxicity._train(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 55e6


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.filter(~held_out(F.col("doc_id"), 3))
    model = langid.train(train)
    got = docs.filter(held_out(F.col("doc_id"), 3)).select("lang", langid.predict(spark, model, F.col("text")).alias("p")).collect()
    assert sum(r["lang"] == r["p"]["lang"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["p"]["score"] <= 1 for r in got)
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string").select("text", langid.predict(spark, model, F.col("text")).alias("p")).collect()
    for r in odd:
        assert (r["p"]["lang"] == "und") == (r["text"] is None or not re.search(r"[^\W\d_]", r["text"]))


def test_language_of_one_or_no_family(spark):
    rows = spark.createDataFrame([(1, "uno dos tres", "es"), (2, "un deux trois", "fr"), (3, "x", None), (4, None, "fr")], "doc_id bigint, text string, lang string")
    for part, want in ((rows, {"es", "fr"}), (rows.filter("lang = 'es'"), {"es"}), (rows.filter("lang is null"), {"und"})):
        model = langid.train(part)
        got = {r["p"]["lang"] for r in rows.filter("doc_id < 3").select(langid.predict(spark, model, F.col("text")).alias("p")).collect()}
        assert got == want


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def brute_lm(pairs, learn, depth):
    """Context-tree weighting written out: one recursion for each node."""
    kind = int

    def coded(text):
        data = b"".join(w + b" " for w in words_of(text)) + b"\n"
        past = [lm.START] * depth
        for b in data:
            yield tuple(past[::-1][:depth]), b
            past = (past + [kind(b)])[-depth:]

    nodes = {}
    for i, t in pairs:
        if learn(i):
            for ctx, b in coded(t):
                for k in range(8):
                    for d in range(depth + 1):
                        n = nodes.setdefault((ctx[:d], 1 << k | b >> (8 - k)), [0, 0])
                        n[b >> (7 - k) & 1] += 1
    children = {}
    for (ctx, p) in nodes:
        if ctx:
            children.setdefault((ctx[:-1], p), []).append((ctx, p))

    def kt(n):
        return sum(math.lgamma(x + 0.5) for x in n) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(nodes[key])
            if len(key[0]) == depth:
                memo[key] = (own, 1.0)
            else:
                below = sum(weighted(c)[0] for c in children[key])
                top = max(own, below)
                memo[key] = (top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2), 1 / (1 + math.exp(min(700, below - own))))
        return memo[key]

    def chance(ctx, p, bit):
        out = None
        for d in range(depth, -1, -1):
            n = nodes.get((ctx[:d], p), [0, 0])
            own = (n[bit] + 0.5) / (sum(n) + 1)
            share = weighted((ctx[:d], p))[1] if (ctx[:d], p) in nodes else 0.5
            out = own if out is None else share * own + (1 - share) * out
        return out

    return {i: sum(math.log10(chance(ctx, 1 << k | b >> (8 - k), b >> (7 - k) & 1)) for ctx, b in coded(t) for k in range(8)) for i, t in pairs}


@pytest.mark.parametrize("frequent,block", [(65_536, 5_000_000), (3, 40), (0, 5_000_000)])
def test_lm_against_brute_force(documents, frequent, block):
    rng = random.Random(2)
    pairs = [(i, " ".join(rng.choice(["The", "the", "cat", "été", "x1", "catalogue", "ç"]) for _ in range(rng.randint(0, 12)))) for i in range(25)] + [(90, None), (91, "new stuff")]
    learn = lambda i: i % 4 != 1
    docs = documents(pairs)
    got = {r["id"]: r for r in lm.scores(docs, F.col("doc_id") % 4 != 1, depth=3, frequent=frequent, block=block).collect()}
    want = brute_lm(pairs, learn, 3)
    counts, n = {}, 0
    for i, t in pairs:
        if learn(i):
            for w in [*words_of(t), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    for i, t in pairs:
        tokens = [*words_of(t), b"\n"]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(w in counts for w in tokens), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9)
        assert r["score"] == pytest.approx(want[i], rel=2e-6)


def test_lm_odd_rows(spark, documents):
    got = lm.scores(documents(ODD), F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in got)
    long = [r for r in got if r["id"] == 7]
    assert long[0] == long[1] and long[0]["n_tokens"] == 60_001
    none = lm.scores(documents(ODD), F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["base_score"]) for r in none)
    assert lm.scores(documents([]), F.lit(True)).collect() == []


def test_codes_of_a_batch_do_not_cross_texts():
    from gradpath.llm.words import split

    both, doc = lm.codes(split(pa.array(["ab c", None, "d"]), "space", lower=True), 2)
    for i, t in enumerate(["ab c", None, "d"]):
        one, _ = lm.codes(split(pa.array([t], pa.string()), "space", lower=True), 2)
        assert both[doc == i].tolist() == one.tolist()


def test_lm_contexts_are_whole_bytes(spark, documents):
    from gradpath.llm.words import split

    code, _ = lm.codes(split(pa.array(["1a", "2a", "бa", "вa"]), "space", lower=True))
    assert len(set(code[code & 255 == ord("a")].tolist())) == 4
    rng = random.Random(8)
    for follows in ({"1": "x", "2": "y", "3": "z", "4": "w"}, {"б": "д", "в": "е", "г": "ж", "ё": "э"}):
        pairs = [(i, "".join(a + follows[a] for a in (rng.choice([*follows]) for _ in range(100)))) for i in range(40)]
        got = lm.scores(documents(pairs), F.col("doc_id") < 30).filter("id >= 30").collect()
        # two bits are drawn for each pair of characters; the second character is told by the first
        assert all(-r["score"] / math.log10(2) < 260 for r in got)
    with pytest.raises(ValueError):
        lm.scores(documents(pairs), F.lit(True), depth=7)


def test_lm_holds_one_block_at_a_time(documents, monkeypatch):
    from pyspark import Broadcast, SparkContext

    held, most = [], []
    make, destroy = SparkContext.broadcast, Broadcast.destroy

    def made(self, value):
        out = make(self, value)
        if isinstance(value, tuple) and len(value) == 2:  # (block, frequent words)
            held.append(out)
            most.append(len(held))
        return out

    def gone(self, *a, **b):
        held.remove(self)
        return destroy(self, *a, **b)

    monkeypatch.setattr(SparkContext, "broadcast", made)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    docs = documents([(i, f"the {i} cats and {i * 7} dogs") for i in range(20)])
    got = lm.scores(docs, F.lit(True), block=100)
    assert max(most) == 1 and len(most) > 2
    whole = {r["id"]: r["score"] for r in lm.scores(docs, F.lit(True)).collect()}
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(whole, rel=1e-9)
