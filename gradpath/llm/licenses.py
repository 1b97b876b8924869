"""License scans: MinHash bands over overlapping windows find templates, exact containment decides.

A template of up to 8, 16, 32, ... words is looked for in windows of twice that many places,
each beginning where the one before it is half over, so every occurrence lies whole in one.
A window's signature is the least of 64 hashes of its three-word shingles; each value is a
band of its own. A window that holds the shingles of a template has a Jaccard similarity of
3/16 or more with it, so that all 64 bands miss with a chance below 2 in a million. What is
found is checked on the shingles themselves: the share of the template's that are there.

``scan`` returns all that reach the share; short notices reach it with their siblings'
words too. ``named`` decides: what tells a template from its siblings (name, variant,
version) has to be there whole, in one stretch of the window with the share; where such
words of two licenses overlap the one with the larger share stays, then the longer one.

Words are lower-cased (A-Z) and rid of punctuation, so notices wrapped in comments, in
capitals or broken over lines count. Null and empty texts hold nothing. The templates are a
parameter; the smallest minima of all (64 numbers each) are broadcast with the shingles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradpath.llm.frames import map_text
from gradpath.llm.words import split, windows

SHINGLE = 3
CONTAINED = 0.8
HASHES = 64
LEAST_WINDOW = 8
_DRAW = np.random.default_rng(20240608)
_A = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64)

# Notices of public licenses. The long ones are the stewards' words; the short ones
# are common forms, those of MIT, Apache-2.0, GPL-3.0 and CC-BY-NC-4.0 as the test tables have them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at"),
    ("EPL-2.0", "This work is licensed under the Eclipse Public License, version 2.0."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("EPL-1.0", "This work is licensed under the Eclipse Public License, version 1.0."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("MPL-1.1", "This work is licensed under the Mozilla Public License, version 1.1."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License v2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License v3.0."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]

# Names, variants and versions; a template needs those that its own text holds.
TELLING = [
    "MIT License", "Software is furnished to do so, subject to the following conditions", "Apache License, Version 2.0", "Mozilla Public License, v. 2.0",
    "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License",
    "Eclipse Public License v. 2.0", "Eclipse Public License v1.0", "Eclipse Public License, version 2.0", "Eclipse Public License, version 1.0",
    "Mozilla Public License, version 2.0", "Mozilla Public License, version 1.1", "ISC License", "BSD License", "BSD 2-Clause License", "BSD 3-Clause License",
    "General Public License v2.0", "General Public License v2.1", "General Public License v3.0",
    "General Public License, version 2", "General Public License, version 2.1", "General Public License, version 3",
    "version 2 of the License", "version 2.1 of the License", "version 3 of the License",
    "CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC0 1.0",
    "Creative Commons Attribution 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NoDerivatives 4.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0",
]


def prepare(templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(window step, name, shingles, minima) of each template; those with fewer than three words are left out."""
    w = split(pa.array([t for _, t in templates], pa.large_string()), "plain", lower=True)
    g, whole = windows(w.hashes(), w.first, SHINGLE)
    out = []
    for k, (name, _) in enumerate(templates):
        own = np.unique(g[w.first[k] : w.first[k + 1]][whole[w.first[k] : w.first[k + 1]]])
        if len(own):
            step = LEAST_WINDOW
            while step < w.counts[k]:
                step *= 2
            out.append((step, name, own, (own[:, None] * _A + _B).min(0)))
    return out


def _places(words: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where a phrase begins among words, both as hashes."""
    if len(words) < len(phrase):
        return np.zeros(0, np.int64)
    return np.flatnonzero((np.lib.stride_tricks.sliding_window_view(words, len(phrase)) == phrase).all(1))


def needed(templates: Sequence[tuple[str, str]], telling: Sequence[str], contained: float) -> list[list[np.ndarray]]:
    """The phrases that each template of ``prepare`` needs, as word hashes: those of ``telling`` in its
    text; if there are none, its shingles that templates of other names lack though they reach the share."""
    said = split(pa.array(telling, pa.large_string()), "plain", lower=True)
    h = said.hashes()
    phrases = [h[a:b] for a, b in zip(said.first[:-1], said.first[1:]) if b > a]
    w = split(pa.array([t for _, t in templates], pa.large_string()), "plain", lower=True)
    h = w.hashes()
    texts = [(name, h[a:b]) for (name, _), a, b in zip(templates, w.first[:-1], w.first[1:]) if b - a >= SHINGLE]
    shingles = [{tuple(v[i : i + SHINGLE].tolist()) for i in range(len(v) - SHINGLE + 1)} for _, v in texts]
    out = []
    for (name, v), own in zip(texts, shingles):
        need = [p for p in phrases if len(_places(v, p))]
        if not need:
            lacking = [own - other for (n, _), other in zip(texts, shingles) if n != name and len(own & other) >= contained * len(own)]
            need = [np.array(x, np.uint64) for x in sorted(set().union(*lacking))]
        out.append(need)
    return out


def stretches(words: np.ndarray, g: np.ndarray, own: np.ndarray, need: list[np.ndarray], contained: float) -> list[list[tuple[int, int]]]:
    """The shortest stretches of a window that hold the share of ``own`` and all that is needed; of each
    the (begin, end) words of what is needed, or of the whole stretch if nothing is."""
    at = np.flatnonzero(np.isin(g, own))
    events = [(p, 0, k) for p, k in zip(at.tolist(), np.searchsorted(own, g[at]).tolist())]
    events += [(p, 1, k) for k, phrase in enumerate(need) for p in _places(words, phrase).tolist()]
    events.sort()
    seen: dict[tuple[int, int], int] = {}
    have, out, lo = [0, 0], [], 0
    full = lambda: have[1] == len(need) and have[0] / len(own) >= contained
    for hi, (_, kind, k) in enumerate(events):
        have[kind] += not seen.get((kind, k))
        seen[kind, k] = seen.get((kind, k), 0) + 1
        if not full():
            continue
        while full():
            last = events[lo]
            seen[last[1:]] -= 1
            have[last[1]] -= not seen[last[1:]]
            lo += 1
        inside = events[lo - 1 : hi + 1]
        if need:
            first = {k: p for p, kind, k in reversed(inside) if kind}
            out.append([(p, p + len(need[k])) for k, p in first.items()])
        else:
            out.append([(inside[0][0], inside[-1][0] + SHINGLE)])
    return out


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(id, license, containment, at, windows): the licenses each document names, the best share of
    a template's shingles, where that window begins (in words) and how many windows reached the share."""
    return _scan(docs, templates, id_col, text_col, contained, None)


def named(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED, telling: Sequence[str] = TELLING) -> DataFrame:
    """What ``scan`` gives, of the licenses that a document really names."""
    return _scan(docs, templates, id_col, text_col, contained, needed(templates, telling, contained))


def _scan(docs: DataFrame, templates: Sequence[tuple[str, str]], id_col: str, text_col: str, contained: float, need: list[list[np.ndarray]] | None) -> DataFrame:
    known = prepare(templates)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ready = shared.value
        w = split(batch.column("text"), "plain", lower=True)
        h = w.hashes()
        g, whole = windows(h, w.first, SHINGLE)
        g = g[whole]
        counts = np.maximum(w.counts - SHINGLE + 1, 0)  # shingles of each text
        first = np.concatenate(([0], np.cumsum(counts)))
        steps = sorted({t[0] for t in ready})
        blocks = {s: -(-counts // s) for s in steps}  # blocks of shingles; a window is two neighbours
        begin = {s: np.concatenate(([0], np.cumsum(blocks[s]))) for s in steps}
        if not len(g) or not ready:
            return None
        step = steps[0]
        doc = np.repeat(np.arange(len(counts)), blocks[step])
        start = first[doc] + (np.arange(len(doc)) - begin[step][doc]) * step
        found: dict[int, set] = {t: set() for t in range(len(ready))}
        for p in range(HASHES):
            low, size = np.minimum.reduceat(g * _A[p] + _B[p], start), step
            for s in steps:
                while size < s:  # neighbours of a text join, the last may stay alone
                    n_old = -(-counts // size)
                    n_new = -(-counts // (2 * size))
                    old, new = np.concatenate(([0], np.cumsum(n_old))), np.concatenate(([0], np.cumsum(n_new)))
                    d = np.repeat(np.arange(len(counts)), n_new)
                    a = old[d] + 2 * (np.arange(len(d)) - new[d])
                    low = np.where(a + 1 < old[d + 1], np.minimum(low[a], low[np.minimum(a + 1, len(low) - 1)]), low[a])
                    size *= 2
                wanted = np.array([t[3][p] for t in ready if t[0] == s])
                which = [k for k, t in enumerate(ready) if t[0] == s]
                order = np.argsort(wanted)
                at = np.minimum(np.searchsorted(wanted[order], low), len(wanted) - 1)
                hits = np.flatnonzero(wanted[order][at] == low)
                for b in hits.tolist():
                    for k in np.flatnonzero(wanted == low[b]).tolist():
                        found[which[k]].add(b)
        out, cores = [], []
        for k, spots in found.items():
            if not spots:
                continue
            s, name, own, _ = ready[k]
            doc_of = np.repeat(np.arange(len(counts)), blocks[s])
            both = {x for b in spots for x in (b - 1, b) if x >= 0 and doc_of[x] == doc_of[b]}
            for b in sorted(both):
                d = int(doc_of[b])
                lo = first[d] + (b - begin[s][d]) * s
                there = g[lo : min(lo + 2 * s, first[d + 1])]
                share = np.isin(own, there).mean()
                if share >= contained:
                    at = int(lo - first[d])
                    if need is not None:
                        words = h[w.first[d] + at : min(w.first[d] + at + 2 * s + SHINGLE - 1, w.first[d + 1])]
                        cores += [(d, share, len(own), len(out), [(at + x, at + y) for x, y in core]) for core in stretches(words, there, own, need[k], contained)]
                    out.append((d, name, float(share), at))
        if need is not None:
            # the best first; another license's words that overlap with what stays are not named
            stay, kept = set(), {}
            for d, _, _, n, core in sorted(cores, key=lambda c: (c[0], -c[1], -c[2], c[3])):
                name = out[n][1]
                if all(name == other or y <= x0 or y0 <= x for x, y in core for x0, y0, other in kept.get(d, ())):
                    kept.setdefault(d, set()).update((x, y, name) for x, y in core)
                    stay.add(n)
            out = [out[n] for n in sorted(stay)]
        best: dict[tuple[int, str], list] = {}
        for d, name, share, at in out:
            got = best.setdefault((d, name), [share, at, set()])
            got[2].add(at)
            if (share, -at) > (got[0], -got[1]):
                got[0], got[1] = share, at
        if not best:
            return None
        keys = sorted(best)
        ids = batch.column("id").take(pa.array([d for d, _ in keys]))
        values = [best[k] for k in keys]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([n for _, n in keys]), pa.array([v[0] for v in values]), pa.array([v[1] for v in values], pa.int32()), pa.array([len(v[2]) for v in values], pa.int32())],
            ["id", "license", "containment", "at", "windows"])

    return map_text(rows, "text", work, "id bigint, license string, containment double, at int, windows int")
