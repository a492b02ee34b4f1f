"""Vectorised handling of whole texts in Arrow batches.

A batch's texts are taken in blocks of whole documents (about BLOCK bytes; a longer text is a
block of its own). Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r. Null
texts are empty. Word hashes are 64-bit polynomial hashes that are mixed afterwards, so the same
word has the same hash on every executor and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Odd multipliers that combine the words of a shingle.
MIX = [((0xD1342543DE82EF95 * (2 * i + 1)) ^ (0x2545F4914F6CDD1D << i)) & MASK | 1 for i in range(16)]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base & MASK
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step & MASK
    return out[:n]


class _Tables:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK + 1)
            cls.up, cls.down = _powers(size, BASE), _powers(size, pow(BASE, -1, 1 << 64))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs


def blocks(column, size: int = BLOCK):
    """(first row, last row + 1, bytes, offsets within them) of consecutive documents."""
    data, offs = utf8(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block (space: which bytes end one), and each document's first word (n + 1 entries)."""
    word = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    start, end = word.copy(), word.copy()
    if len(data):
        start[1:] &= ~word[:-1] | edge[1:-1]
        end[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges."""
    up, down = _Tables.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of a block's documents in order (a shorter document's whole
    sequence is its only one), and each document's first shingle (n + 1 entries)."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    if len(h) >= k:
        every = h[: len(h) - k + 1] * np.uint64(MIX[0])
        for j in range(1, k):
            every = every + h[j : len(h) - k + 1 + j] * np.uint64(MIX[j])
        full = np.flatnonzero(n >= k)
        where = np.repeat(first[full] - (c := np.concatenate([[0], np.cumsum(count[full])]))[:-1], count[full]) + np.arange(c[-1])
        into = np.repeat(at[full] - c[:-1], count[full]) + np.arange(c[-1])
        out[into] = every[where]
    for size in range(1, k):
        if len(short := np.flatnonzero(n == size)):
            total = np.full(len(short), size * MIX[k] & MASK, dtype=np.uint64)
            for j in range(size):
                total += h[first[short] + j] * np.uint64(MIX[j])
            out[at[short]] = total
    return mix(out), at
