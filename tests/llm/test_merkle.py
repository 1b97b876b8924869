import hashlib
import random
import zlib

import pytest

from gradpath.llm import merkle
from gradpath.llm.queries import QUERIES

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """(root, siblings of each leaf from below as (sibling, before))."""
    ways, place, now = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(now) > 1:
        for k, p in enumerate(place):
            other = p ^ 1
            ways[k].append((now[other], other < p) if other < len(now) else (None, False))
            place[k] = p // 2
        now = [h(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return now[0], ways


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], leaf(r), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    got = [(sorted(trees[k], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for k in order]
    low = [climb([x[1] for x in t]) for t in got]
    root, high = climb([x[0] for x in low])
    out = []
    for t, (subroot, ways), up in zip(got, low, high):
        for (doc, digest, r), way in zip(t, ways):
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and r[3] is not None
            acc = leaf((*r[:3], r[3] + 1, r[4])) if hit else digest
            for s, before in way + up:
                acc = h(s, acc) if before else h(acc, s or "")
            out.append((doc, digest, subroot, root, h(*(s or "" for s, _ in way + up)), acc, acc == root))
    return sorted(out, key=str)


def written(spark, path, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA)
    (df.selectExpr("*", extra) if extra else df).write.parquet(f"{path}/documents.parquet")
    return str(path)


def some(n, seed=3):
    rng = random.Random(seed)
    out = [(i, rng.choice(["a", None, "b:1", ""]), rng.choice(["en", "de", "fr", None, "Ü", "z"]) if i % 3 else "en", rng.choice([None, 5, 900]), rng.choice([None, "", "x" * i, "ünï 漢"])) for i in range(n)]
    return out + [out[4], out[4], (None, "a", "en", 3, "t"), (None, None, None, None, None), (7, "other", "de", 1, "shared id")]


@pytest.mark.parametrize("n,levels", [(700, 8), (90, 2), (90, 1), (300, 3)])
def test_against_brute_force(spark, tmp_path, monkeypatch, n, levels):
    for f in (merkle.manifest, merkle.proofs):
        monkeypatch.setattr(f, "__defaults__", (levels,))
    rows = some(n)
    got = QUERIES["op12_merkle_manifest"](spark, written(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "s", "en", 4, "one")], [(1, "s", "en", 4, "one"), (2, "s", "en", 4, "two")], [(1, "s", None, None, None)] * 5])
def test_small_tables_and_repeated_rows(spark, tmp_path, rows):
    got = QUERIES["op12_merkle_manifest"](spark, written(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_clashing_columns_and_a_very_long_text(spark, tmp_path):
    query = QUERIES["op12_merkle_manifest"]
    assert query(spark, written(spark, tmp_path / "none", [])).collect() == []
    rows = [(1, "s", "en", 4, "word " * 1_700_000), (2, "s", "en", 4, "two")]
    got = query(spark, written(spark, tmp_path / "long", rows, "1L as rank")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    clash = spark.createDataFrame([(k, "d", f"{k:064x}", "x", 9, 9) for k in range(5)], "at bigint, key string, digest string, row string, tree int, steps int")
    found = merkle.proofs(merkle.manifest(clash, "key", "at", "digest")).collect()
    assert sorted(r["data"]["tree"] for r in found) == [9] * 5 and len({r["root"] for r in found}) == 1


def test_nodes_cover_intervals_and_verify(spark):
    rows = spark.createDataFrame([(k, h(str(k))) for k in range(11)], "id bigint, d string").withColumn("t", merkle.F.lit("one"))
    m = merkle.manifest(rows, "t", "id", "d", levels=2)
    got = {(r["level"], r["lo"], r["hi"]): r["digest"] for r in m.nodes.collect()}
    assert len(got) == 11 + 6 + 3 + 2 + 1
    assert got[1, 10, 10] == h(got[0, 10, 10]) and got[2, 8, 10] == h(got[1, 8, 9], got[1, 10, 10]) and (4, 0, 10) in got
