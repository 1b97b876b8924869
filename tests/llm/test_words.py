"""Words and windows against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from gradpath.llm import frames
from gradpath.llm.words import split, windows

TEXT = st.text(alphabet="aB \t\n\x0b.é1Zß\x00", max_size=30)


def plain(text, kind):
    pattern = rb"[^\x20\x09-\x0D]+" if kind == "space" else rb"[A-Za-z0-9\x80-\xff]+"
    return re.findall(pattern, (text or "").encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.sampled_from(["space", "plain"]))
def test_words_and_hashes(texts, kind):
    w = split(pa.array(texts, pa.string()), kind)
    want = [plain(t, kind) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for xs in want for x in xs]
    assert [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == flat
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(flat))
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(1, 6))
def test_windows(texts, k):
    w = split(pa.array(texts, pa.string()))
    g, ok = windows(w.hashes(), w.first, k)
    want = [tuple(x[i : i + k]) if i + k <= len(x) else None for x in map(lambda t: plain(t, "space"), texts) for i in range(len(x))]
    assert ok.tolist() == [x is not None for x in want]
    seen = {}
    for x, v in zip(want, g.tolist()):
        if x is not None:
            assert seen.setdefault(x, v) == v
    assert len(set(seen.values())) == len(seen)


def test_sliced_column_and_pieces():
    column = pa.array(["skip me", "a b", None, "c" * 50, "d"], pa.string())
    assert split(column.slice(1)).counts.tolist() == [2, 0, 1, 1]
    batch = pa.RecordBatch.from_arrays([column, pa.array(range(5))], ["text", "n"])
    got = list(frames.pieces(iter([batch]), "text", 10))
    assert [x for p in got for x in p.column("n").to_pylist()] == list(range(5))
    assert max(p.num_rows for p in got) < 5


def test_long_word():
    w = split(pa.array(["x" * 100 + " " + "x" * 99, "x" * 100], pa.string()))
    h = w.hashes()
    assert h[0] == h[2] != h[1] and np.all(w.ends - w.starts == [100, 99, 100])
