import hashlib

import pytest

from gradpath.llm import exact

PAIRS = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "ab"), (8, "x" * 5000), (8, "x" * 5000), (None, "ab"), (None, None), (9, "alone")]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in pairs:
        ids = [x for x in groups[lower(t)] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 5, 2])
def test_against_brute_force(documents, bits):
    got = exact.duplicates(documents(PAIRS), hash_bits=bits, capacity=1).select("id", "keep_id", "n", "sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(PAIRS)


def test_directory_doubles_only_where_full():
    depth, slots = exact.grow_directory([(0, 5), (1, 5), (9, 1)], 4, 5)
    assert depth == 4
    local = {slot: d for slot, _, d in slots}
    assert local[0] == local[1] == 4 and local[9] == 1
    assert [s for s, _, _ in slots] == list(range(16)) and len({b for _, b, _ in slots}) < 16


def test_keep_last_keeps_columns_and_one_row_of_each_text(spark):
    data = [(1, "Ab", 1), (2, "ab", 2), (2, "ab", 2), (3, "c", 3), (3, "AB", 4), (None, "c", 5), (None, None, 6), (None, "", 6)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, keep_id int")
    got = exact.keep_last(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) in [
        sorted([(3, "AB", 4), (3, "c", 3), x], key=str) for x in [(None, None, 6), (None, "", 6)]
    ]


def test_empty(documents):
    assert exact.duplicates(documents([])).collect() == []
    assert exact.keep_last(documents([])).collect() == []
