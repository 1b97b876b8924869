import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gradpath.llm import simhash
from gradpath.llm.queries import QUERIES
from gradpath.llm.xxh64 import xxh64


def fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs, fps):
    """Components by all pairs of rows."""
    label = list(range(len(pairs)))
    find = lambda x: x if label[x] == x else find(label[x])
    for x in range(len(pairs)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 3:
                label[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, ((i, _), f) in enumerate(zip(pairs, fps))), key=str)


def test_xxh64_against_the_library():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(0, 140), 1000, 4099]]
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    for seed in (0, 42):
        assert xxh64(data, ends - [len(p) for p in parts], ends, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def test_fingerprints_and_chunks(monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \t", "One", "one  TWO", "one two three", "É漢 two Three\nfour five six"]
    texts += [" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 90))) + " " * rng.randint(0, 2) for _ in range(60)]
    want = [fingerprint(t) for t in texts]
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == want
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == want
    assert simhash.fingerprints_of(pa.array(texts[7:8])).tolist() == want[7:8]


def test_survivors_of_the_pivots():
    """A pair passes all pivots only with nine differing bits or fewer; linked pairs always pass."""
    rng, refs = random.Random(8), simhash.walsh()
    assert len(set(refs)) == 64
    for bits in [1, 2, 3, 9, 10, 11, 20, 32, 64] * 40:
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), bits))
        apart = max(abs((a ^ r).bit_count() - (b ^ r).bit_count()) for r in refs)
        assert apart <= 3 if bits <= 3 else (apart > 3 or bits <= 9)


def fingerprint_sets(seed):
    """Random fingerprints, chains, balls around one and a dense group that no star links at once."""
    rng = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << i for i in rng.sample(range(64), n))
    out = [rng.getrandbits(64) for _ in range(200)]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            out.append(x)
            x = flip(x, rng.randint(1, 5))
    for _ in range(4):
        x = rng.getrandbits(64)
        out += [flip(x, rng.randint(0, 7)) for _ in range(60)]
    dense = rng.getrandbits(64) & ~0xFFFF
    out += [dense | rng.getrandbits(16) for _ in range(300)]
    return sorted(set(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, seed):
    fps = fingerprint_sets(seed)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    got = {r["node"]: r["component"] for r in simhash.link_nodes(nodes).collect()}
    mine = [got.get(int(np.uint64(f).view(np.int64)), f) for f in fps]
    want = [x[2] for x in sorted(brute([(k, None) for k in range(len(fps))], fps), key=lambda x: x[0])]
    assert {(m, w) for m, w in zip(mine, want)} and len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_query_against_brute_force(spark, documents, tmp_path):
    rng = random.Random(4)
    pairs = [(None, "a null id " * 5), (3, None), (4, ""), (5, "Hi"), (6, "hi"), (6, "something else"), (6, "something else"), (None, None)]
    for _ in range(6):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(60, 400))]
        for _ in range(10):
            new = list(base)
            for _ in range(rng.randint(0, 6)):
                new[rng.randrange(len(new))] = f"n{rng.randint(0, 10**6)}"
            pairs.append((100 - len(pairs), " ".join(new)))
    docs = documents(pairs).withColumn("fp", simhash.F.lit("clash")).withColumn("id", simhash.F.lit(0)).withColumn("component", simhash.F.lit(0))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_simhash"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute(pairs, [fingerprint(t) for _, t in pairs])


def test_empty_and_very_long(spark, documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(1_100_000))  # over 8 MB
    got = {r["id"]: r for r in simhash.near_duplicates(documents([(1, text), (2, text.upper()), (9, "short")])).collect()}
    assert int(np.int64(got[1]["fp"]).view(np.uint64)) == fingerprint(text) and got[2]["component_id"] == 1 and got[9]["component_id"] == 9
