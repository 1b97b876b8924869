"""Words and word hashes of whole Arrow text columns, worked out with numpy.

A batch is read as one byte buffer with offsets, so nothing is done per document or per
word in Python. Two definitions of a word:

* ``space``: a run of bytes other than blank and 0x09-0x0D (the contracts' words);
* ``plain``: a run of ASCII letters, digits and bytes of non-ASCII characters, so that
  punctuation and markers around a word do not change it.

Null texts count as empty. A word's hash is 64 bits over its bytes and its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_PLAIN = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)
IN_WORD = {"space": ~_SPACE, "plain": _PLAIN}
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing function; works on a copy."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[ends[0] : ends[-1]], ends - ends[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


@dataclass
class Words:
    """The words of a batch: byte positions, and where each document's words begin."""

    data: np.ndarray  # bytes, followed by eight of padding
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # document i has words first[i] to first[i + 1] - 1

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document's place in the batch, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word; eight bytes are taken at a time."""
        size = self.ends - self.starts
        wide = np.ndarray(max(len(self.data) - 7, 0), "<u8", self.data, strides=(1,))
        h = mix(size.astype(np.uint64))
        todo, at = np.arange(len(size)), 0
        while len(todo):
            part = wide[self.starts[todo] + at] & _LOW_BYTES[np.minimum(size[todo] - at, 8)]
            h[todo] = mix(h[todo] ^ part)
            at += 8
            todo = todo[size[todo] > at]
        return h


def split(column: pa.Array, kind: str = "space", lower: bool = False) -> Words:
    """The words of a text column."""
    raw, ends = text_buffer(column)
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = LOWER[raw] if lower else raw
    inside = np.zeros(len(raw) + 1, np.bool_)
    inside[:-1] = IN_WORD[kind][data[: len(raw)]]
    change = np.zeros(len(raw) + 1, np.bool_)
    change[1:] = inside[1:] != inside[:-1]
    change[0] = inside[0]
    edge = ends[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    joined = edge[inside[edge - 1] & inside[edge]]  # a word that ends where the next text begins with one
    begins = change & inside
    begins[joined] = True
    stops = change & ~inside
    stops[joined] = True
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops), np.searchsorted(starts, ends))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each place on, mask of places where k words of one document follow).

    The hash of a window comes from doubling: two halves that overlap where k is no power of two.
    """
    n = len(h)
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the document's end
    got, size = h.copy(), 1
    while size < k:
        step = min(size, k - size)
        nxt = np.zeros(n, np.uint64)
        nxt[: max(n - step, 0)] = got[step:]
        got = mix(got ^ (nxt * _M1 + _STEP))
        size += step
    return got, left >= k


def pack(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, as an (n, 2) array."""
    padded = np.concatenate(([False], flags, [False]))
    return np.flatnonzero(padded[1:] != padded[:-1]).reshape(-1, 2)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, how often each occurs), by sorting."""
    x = np.sort(x)
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[start], np.diff(np.append(start, len(x)))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed numbers that Spark has."""
    return x.view(np.int64)
