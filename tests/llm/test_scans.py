"""License scan and benchmark decontamination."""

import random
import re

import numpy as np
import pytest

from gradpath.llm import licenses, tiling


def plain(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def brute_licenses(text):
    w, out = plain(text), {}
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for name, t in licenses.TEMPLATES:
        v = plain(t)
        own = {tuple(v[i : i + 3]) for i in range(len(v) - 2)}
        step = 8
        while step < len(v):
            step *= 2
        for at in range(0, len(g), step):
            share = len(own & set(g[at : at + 2 * step])) / len(own)
            if share >= 0.8:
                best = out.setdefault(name, [share, at])
                if (share, -at) > (best[0], -best[1]):
                    out[name] = [share, at]
    return out


def test_licenses_against_brute_force(documents):
    rng = random.Random(4)
    pairs = [(0, None), (1, ""), (2, "MIT"), (None, "released under THE mit license")]
    for i in range(120):
        w = [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.4:
                notice[rng.randrange(len(notice))] = "changed"
            cut = rng.randint(0, len(w))
            w[cut:cut] = [f"# {x.upper()}" for x in notice] if rng.random() < 0.3 else notice
        pairs.append((10 + i, " ".join(w)))
    want = sorted(((i, name, round(s, 9), at) for i, t in pairs for name, (s, at) in brute_licenses(t).items()), key=str)
    got = sorted(((r["id"], r["license"], round(r["containment"], 9), r["at"]) for r in licenses.scan(documents(pairs)).collect()), key=str)
    assert got == want and len(want) > 60


def test_licenses_of_nothing(documents):
    assert licenses.scan(documents([])).collect() == []
    assert licenses.scan(documents([(1, "released under the mit license")]), templates=[("short", "a b")]).collect() == []


def brute_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest unmarked match, again and again."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if (n, -i, -j) > (best[0], -best[1], -best[2]):
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles += n
        free_a[i : i + n] = [False] * n
        free_b[j : j + n] = [False] * n


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_tiling_against_brute_force(spark, documents, block_words):
    rng = random.Random(6)
    items = [(k, " ".join(f"t{rng.randint(0, 6 if k % 3 == 0 else 400)}" for _ in range(rng.randint(3, 40)))) for k in range(14)]
    items += [(90, items[4][1].upper() + "!"), (91, None), (92, "too short"), (93, "")]
    pairs = [(0, None), (1, ""), (2, "t1 " * 300)]
    for i in range(40):
        v = items[rng.randrange(14)][1].split()
        half = len(v) // 2
        v = rng.choice([v, v[half:] + ["gap"] + v[:half], v[: half + 2], [x + "," for x in v]])
        pairs.append((10 + i, " ".join([f"u{rng.randint(0, 30)}" for _ in range(rng.randint(0, 30))] + v)))
    got = {(r["id"], r["item_id"]): r["matched"] for r in tiling.leaks(documents(pairs), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words).collect()}
    want = {}
    for k, t in items:
        a = plain(t)
        for i, text in pairs:
            n = brute_tiles(a, plain(text), 5) if len(a) >= 5 else len(a) * any(plain(text)[p : p + len(a)] == a for p in range(len(plain(text))))
            if a and n >= 0.5 * len(a) and n:
                want[(i, k)] = n
    assert got == want and len(want) > 15


def test_reordered_passage_is_found_and_clean_stays(spark, documents):
    item = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (None, "a b c d e f")], "item_id bigint, text string")
    docs = documents([(1, " ".join(item[20:] + ["x"] + item[10:20] + ["y"] + item[:10])), (2, " ".join(item[:12])), (None, "nothing here"), (4, None), (5, "A b, c d e f"), (None, "a b c d e f")])
    got = {r["id"]: (r["tiles"], r["matched"]) for r in tiling.leaks(docs, bench).collect()}
    assert got == {1: (3, 30), 5: (1, 6), None: (1, 6)}
    kept = tiling.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "4", "None"]


def test_short_items_and_items_with_equal_words(spark, documents):
    bench = spark.createDataFrame([(1, "Forty two"), (2, "paris"), (3, "forty, TWO!"), (4, "a b c d e f g"), (5, "A b c d e f g"), (None, "paris"), (6, "")], "item_id bigint, text string")
    docs = documents([(1, "it is forty two."), (2, "forty of two"), (3, "Paris paris"), (4, "x a b c d e f g"), (5, "nothing")])
    got = sorted(((r["id"], r["item_id"], r["matched"], r["tiles"]) for r in tiling.leaks(docs, bench, block_words=3).collect()), key=str)
    assert got == sorted([(1, 1, 2, 1), (1, 3, 2, 1), (3, 2, 1, 1), (3, None, 1, 1), (4, 4, 7, 1), (4, 5, 7, 1)], key=str)
    assert sorted(r["doc_id"] for r in tiling.clean(docs, bench).collect()) == [1, 2, 3, 5]
    assert sorted(r["doc_id"] for r in tiling.clean(docs, bench, short=True).collect()) == [2, 5]


def test_running_hashes_are_those_of_the_windows():
    words = np.random.default_rng(1).integers(0, 2**63, 40).astype(np.uint64)
    run = tiling.Running(words)
    for size in (1, 5, 39, 40):
        want = [sum(int(x) * pow(int(tiling._P), k, 2**64) for k, x in enumerate(words[p : p + size])) % 2**64 for p in range(41 - size)]
        assert run.windows(size).tolist() == want
    assert len(run.windows(41)) == 0


def test_a_very_long_text_and_a_repeated_line(spark, documents):
    line = "one two three four five six seven"
    bench = spark.createDataFrame([(1, line), (2, " ".join(f"w{i}" for i in range(50)))], "item_id bigint, text string")
    docs = documents([(1, (line + " ") * 230_000), (2, "x " * 4_000_000 + " ".join(f"w{i}" for i in range(10, 50)))])
    got = sorted((r["id"], r["item_id"], r["matched"]) for r in tiling.leaks(docs, bench).collect())
    assert got == [(1, 1, 7), (2, 2, 40)]


def test_nothing_to_look_for(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert tiling.leaks(documents([(1, "a b c d e")]), none).collect() == []
    assert tiling.clean(documents([]), none).collect() == []


OTHERS = [
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    (None, "This work is licensed under the GNU Library General Public License, version 2."),
    (None, "This work is licensed under the GNU General Public License, version 1."),
    (None, "Licensed under the Apache License, Version 2.1."),
    (None, licenses.TEMPLATES[3][1].replace(", subject to the following conditions:", '. THE SOFTWARE IS PROVIDED "AS IS"')),
    (None, next(t for n, t in licenses.TEMPLATES if n == "MPL-2.0" and len(t) > 100).replace("2.0", "1.1")),
]


def test_each_notice_has_one_right_name_or_none(documents):
    notices = [*licenses.TEMPLATES, *OTHERS]
    pairs = [(i, f"{'some words before it ' * (i % 5)}{t} {'and after ' * (i % 3)}") for i, (_, t) in enumerate(notices)]
    got = {}
    for r in licenses.named(documents(pairs)).collect():
        got.setdefault(r["id"], []).append(r["license"])
    assert got == {i: [name] for i, (name, _) in enumerate(notices) if name}


def test_all_of_several_notices_are_named(documents):
    text = dict(reversed(licenses.TEMPLATES))
    gpl = [next(t for n, t in licenses.TEMPLATES if n == f"GPL-{v}.0" and len(t) > 100) for v in (2, 3)]
    pairs = [(1, " ".join(gpl)), (2, "Licensed under CC BY 4.0 and CC BY-SA 4.0."), (3, f"{text['MIT']} {text['CC-BY-NC-4.0']}"), (4, gpl[0].replace("This program", "This file")), (5, f"{gpl[0]} See version 3 of the License."), (6, "word " * 500 + gpl[1])]
    got = sorted((r["id"], r["license"]) for r in licenses.named(documents(pairs)).collect())
    assert got == [(1, "GPL-2.0"), (1, "GPL-3.0"), (2, "CC-BY-4.0"), (2, "CC-BY-SA-4.0"), (3, "CC-BY-NC-4.0"), (3, "MIT"), (4, "GPL-2.0"), (5, "GPL-2.0"), (6, "GPL-3.0")]


def test_templates_without_telling_words(documents):
    templates = [("one", "aa bb cc dd ee ff gg hh ii jj kk 1"), ("two", "aa bb cc dd ee ff gg hh ii jj kk 2")]
    pairs = [(1, templates[0][1]), (2, templates[1][1]), (3, templates[0][1][:-1] + "3")]
    assert sorted((r["id"], r["license"]) for r in licenses.named(documents(pairs), templates).collect()) == [(1, "one"), (2, "two")]


def test_short_and_long_notices_of_more_licenses(documents):
    want = {
        "EPL-2.0": ["This work is licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at"],
        "EPL-1.0": ["This work is licensed under the Eclipse Public License, version 1.0."],
        "MPL-2.0": ["This work is licensed under the Mozilla Public License, version 2.0."],
        "ISC": ["Licensed under the ISC License."],
        "BSD": ["Licensed under the BSD 3-Clause License."],
        "GPL-2.0": ["Licensed under the GNU General Public License v2.0."],
        "LGPL-2.1": ["Licensed under the GNU Lesser General Public License v2.1."],
    }
    notices = [(name, t) for name, texts in want.items() for t in texts]
    got = sorted((r["id"], r["license"]) for r in licenses.named(documents([(i, t) for i, (_, t) in enumerate(notices)])).collect())
    assert got == [(i, name) for i, (name, _) in enumerate(notices)]
