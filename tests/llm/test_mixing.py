import re

import pytest

from gradpath.llm import mixing


def fill(sizes, share=1.5, most=2.0):
    """Targets by water filling, in plain Python."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def make(spark, n=400):
    data = [(i, "w " * (i * 7919 % 97 + (3000 if i == 5 else 0)), ["b", "a", None, "é", "c"][i % 5 if i % 3 else 0]) for i in range(n)]
    return spark.createDataFrame(data + [(n, None, "a"), (n + 1, "", "empty")], "doc_id bigint, text string, source string")


def test_targets_and_words(spark):
    docs = make(spark)
    got = mixing.mix(docs, block=16).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2 and (r["size"] or not r["copies"])
        taken[r["source"]] += r["size"] * r["copies"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(100, 0.02 * want[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), block=16).collect()))


def test_repeated_rows_and_documents(spark):
    data = [(1, "a b c", "s", 7)] * 40 + [(2, "a", "t", 8), (None, "q r", "t", 9), (3, "a b", None, 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, copies int")
    plan = mixing.mix(docs)
    assert plan.count() == len(data)
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "text", "source", "copies", "copy", "source_words", "source_target"]
    assert out.count() == sum(r["copies"] for r in plan.collect())
    assert abs(3 * out.filter("source = 's'").count() - out.filter("source = 's'").first()["source_target"]) <= 3


def test_empty(documents):
    assert mixing.mix(documents([])).collect() == []
    assert mixing.mixed_documents(documents([(1, None)])).collect() == []
