"""XXH64 of many byte ranges at once, in numpy. The numbers are the public algorithm's."""

from __future__ import annotations

import numpy as np

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of ``data[starts[i]:ends[i]]`` for each i; ``data`` has eight bytes of padding behind it."""
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    four = np.ndarray(max(len(data) - 3, 0), "<u4", data, strides=(1,))
    begin = lambda *add: np.uint64((seed + sum(map(int, add))) % 2**64)
    size = ends - starts
    at, h = starts.copy(), np.full(len(starts), begin(P5), np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        acc = [np.full(len(long), v, np.uint64) for v in (begin(P1, P2), begin(P2), begin(), begin(-int(P1)))]
        todo = np.arange(len(long))
        while len(todo):
            for k in range(4):
                acc[k][todo] = _round(acc[k][todo], eight[at[long[todo]] + 8 * k])
            at[long[todo]] += 32
            todo = todo[ends[long[todo]] - at[long[todo]] >= 32]
        mixed = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
        for a in acc:
            mixed = (mixed ^ _round(np.zeros(len(a), np.uint64), a)) * P1 + P4
        h[long] = mixed
    h += size.astype(np.uint64)
    todo = np.flatnonzero(ends - at >= 8)
    while len(todo):
        lane = _round(np.zeros(len(todo), np.uint64), eight[at[todo]])
        h[todo] = _rotated(h[todo] ^ lane, 27) * P1 + P4
        at[todo] += 8
        todo = todo[ends[todo] - at[todo] >= 8]
    todo = np.flatnonzero(ends - at >= 4)
    h[todo] = _rotated(h[todo] ^ four[at[todo]].astype(np.uint64) * P1, 23) * P2 + P3
    at[todo] += 4
    todo = np.flatnonzero(ends > at)
    while len(todo):
        h[todo] = _rotated(h[todo] ^ data[at[todo]].astype(np.uint64) * P5, 11) * P1
        at[todo] += 1
        todo = todo[ends[todo] > at[todo]]
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)
