import random

import pytest

from gradpath.llm import repeats


def brute(pairs, window):
    words = [(i, (t or "").split()) for i, t in pairs]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {p + q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{j}" for j in range(rng.randint(5, 60))] for k in range(8)]
    out = [(0, None), (1, ""), (2, " a  b "), (3, "x " * 400), (4, "y " + "x " * 50)]
    for _ in range(60):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += [f"u{rng.randint(0, 300)}" for _ in range(rng.randint(0, 20))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            w += p[a:] if rng.random() < 0.5 else p
        out.append((len(out), " ".join(w)))
    out += [(len(out) + k, out[10 + k][1]) for k in range(4)]
    return out


@pytest.mark.parametrize("window", [13, 4, 2])
def test_against_brute_force(documents, window):
    pairs = corpus(window)
    got = repeats.strip_repeats(documents(pairs), window=window).collect()
    assert sorted(map(tuple, got)) == brute(pairs, window)


def test_levels_double_until_nothing_repeats(documents):
    words = [f"w{i}" for i in range(120)]
    docs = documents([(1, " ".join(words)), (2, "a " + " ".join(words[10:90])), (3, " ".join(words[50:])), (4, "z " * 5)])
    found, copies = repeats.levels(docs.selectExpr("doc_id row", "doc_id id", "text"), 13)
    assert sorted(found) == [13, 26, 52] and copies.count() == 0
    got = {r["row"]: [tuple(x) for x in r["ranges"]] for r in found[52].collect()}
    assert got == {1: [(10, 29), (50, 19)], 2: [(1, 29)], 3: [(0, 19)]}


def test_null_ids_and_empty(documents):
    text = " ".join(f"w{i}" for i in range(20))
    got = repeats.strip_repeats(documents([(None, text), (5, text), (6, text), (6, text)])).collect()
    assert sorted((str(r["id"]), r["n_removed"]) for r in got) == [("5", 0), ("6", 20), ("6", 20), ("None", 0)]
    assert repeats.strip_repeats(documents([])).collect() == []


def test_shared_ids_keep_their_own_words(documents):
    one, two = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    pairs = [(1, one), (2, one + " x"), (2, two), (2, two), (3, two + " y"), (None, two), (None, one)]
    got = repeats.strip_repeats(documents(pairs)).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"]) for r in got) == sorted(
        [("1", 40, 0), ("2", 41, 40), ("2", 40, 0), ("2", 40, 0), ("3", 41, 40), ("None", 40, 0), ("None", 40, 0)])


def test_one_very_long_text(documents):
    base = [f"w{i % 700}x{i}" for i in range(700_000)]  # some 8 MB
    got = repeats.strip_repeats(documents([(1, " ".join(base)), (2, " ".join(base[1000:200_000]) + " end")])).collect()
    assert sorted((r["id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 700_000, 0), (2, 199_001, 199_000)]
