import random

import pytest

from gradpath.llm import components, neardup


def shingles(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(pairs, k, percent=80):
    s = [(i, shingles(t, k)) for i, t in pairs]
    label = {i: i for i, _ in s}
    find = lambda x: x if label[x] == x else find(label[x])
    for x in range(len(s)):
        for y in range(x):
            a, b = s[x][1], s[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(s[x][0]), find(s[y][0])))
                label[hi] = lo
    return sorted((i, len(x), find(i), find(i) == i) for i, x in s)


def near_copies(seed=1, groups=6, copies=12):
    """Chains and stars of copies with ever more words changed, some at the very edge."""
    rng = random.Random(seed)
    out = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one"), (5, "one two three four five")]
    for g in range(groups):
        base = [f"w{g}x{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 160))]
        last = base
        for c in range(copies):
            new = list(last if c % 2 else base)
            for _ in range(rng.randint(0, max(1, len(new) // 25 if c % 3 else len(new) // 9))):
                new[rng.randrange(len(new))] = f"n{rng.randint(0, 10**6)}"
            last = new
            out.append((len(out), " ".join(new)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k,stars", [(4, 3), (5, 0), (4, 1)])
def test_against_brute_force(documents, k, stars, monkeypatch):
    monkeypatch.setattr(neardup.link_classes, "__defaults__", (stars,))
    pairs = near_copies(k)
    got = neardup.near_duplicates(documents(pairs), k=k).collect()
    assert sorted(map(tuple, got)) == brute(pairs, k)


def test_nulls_and_repeated_rows(documents):
    text = " ".join(f"a{i}" for i in range(30))
    docs = documents([(None, text), (4, text), (4, text), (9, text + " b"), (None, None), (7, "")])
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 26, 4, False), (4, 26, 4, True), (4, 26, 4, True), (9, 27, 4, False), (None, 0, None, True), (7, 0, 7, True)], key=str)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "7", "None", "None"]


def test_empty(documents):
    assert neardup.near_duplicates(documents([])).collect() == []


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 200), (200, 3), (3, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()))
    assert set(got[i] for i in range(100, 161)) == {100} and got[7] == got[200] == got[3] == 3
