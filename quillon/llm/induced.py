"""External induced suffix sorting of a shard, with common-prefix values.

Suffixes are L or S as in SA-IS. The sorted suffixes at LMS positions seed two passes: one up
through the characters that induces the L suffixes, one down that induces the S suffixes. The
queue of suffixes that wait for their character is a monotone priority queue: it holds (position,
common prefix with the one before) tuples in a bucket per character, in order of arrival, and
writes buckets to disk beyond MEMORY tuples. Each step takes all that waits for the least (or
greatest) character at once. A pushed suffix's common-prefix value is one more than the least value
between its source and the source pushed to the same character before it, found by range minima
inside a step and a running minimum per character across steps. Values stop at CAP.

LMS substrings are sorted and named by the same two passes; the reduced string of names is sorted
by doubling ranks, until all differ or CAP characters are covered (ties beyond do not matter here).
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

from . import _text

CAP, MEMORY = 511, 1 << 19
BIG = np.int32(1 << 20)


class Queue:
    """Buckets of (position, common prefix) in order of arrival, on disk beyond MEMORY tuples."""

    def __init__(self, size: int):
        self.chunks: list[list[np.ndarray]] = [[] for _ in range(size)]
        self.held, self.folder = 0, None

    def push(self, char: int, rows: np.ndarray) -> None:
        self.chunks[char].append(rows)
        self.held += len(rows)
        if self.held > MEMORY:
            self.folder = self.folder or tempfile.mkdtemp(prefix="queue-")
            for c, held in enumerate(self.chunks):
                if held:
                    with open(os.path.join(self.folder, str(c)), "ab") as f:
                        for x in held:
                            f.write(x.tobytes())
                    self.chunks[c] = []
            self.held = 0

    def take(self, char: int) -> np.ndarray:
        """All that has arrived for a character since it was taken last."""
        parts = []
        if self.folder and os.path.exists(path := os.path.join(self.folder, str(char))):
            parts.append(np.fromfile(path, dtype=np.int32).reshape(-1, 2))
            os.remove(path)
        parts += self.chunks[char]
        self.held -= sum(map(len, self.chunks[char]))
        self.chunks[char] = []
        return np.concatenate(parts) if parts else np.zeros((0, 2), dtype=np.int32)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class _Minima:
    """Range minima by a sparse table."""

    def __init__(self, g: np.ndarray):
        self.rows = [g]
        while (1 << len(self.rows)) <= len(g):
            a, w = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(a[:-w], a[w:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of g[lo:hi]; BIG for empty ranges."""
        out = np.full(len(lo), BIG, dtype=np.int32)
        n = hi - lo
        level = np.where(n > 0, np.frexp(n.astype(np.float64))[1] - 1, -1)
        for k in np.unique(level[level >= 0]):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


class Induction:
    """One text (uint16, ends in its only 0) and the passes over it."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.size = int(text.max()) + 1
        run = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))  # last of each run
        last = np.repeat(run, np.diff(np.concatenate([[-1], run])))
        self.s_type = text < text[np.minimum(last + 1, n - 1)]
        self.s_type[-1] = True
        self.run = (last - np.arange(n)).astype(np.int32) + 1
        self.lms = np.flatnonzero(self.s_type[1:] & ~self.s_type[:-1]) + 1

    def _pass(self, seeds: list[np.ndarray], up: bool, values: bool) -> list[np.ndarray]:
        """Induces L (up) or S suffixes; seeds: per character the (position, value) rows of the
        other kind, in the order in which they are met. Returns rows per character, in that order."""
        text, queue = self.text, Queue(self.size)
        kind = ~self.s_type if up else self.s_type
        carry = np.full(self.size, BIG, dtype=np.int32)
        pushed = np.zeros(self.size, dtype=bool)
        out: list[np.ndarray] = []

        def step(rows: np.ndarray, char: int) -> np.ndarray:
            """Pushes what precedes rows; returns those of the same character."""
            pred = rows[:, 0] - 1
            ok = np.flatnonzero((pred >= 0) & kind[np.maximum(pred, 0)])
            p = pred[ok]
            c = text[p]
            order = np.argsort(c, kind="stable")
            c, p, src = c[order], p[order], ok[order]
            new = np.zeros((len(p), 2), dtype=np.int32)
            new[:, 0] = p
            cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
            if values:
                mins = _Minima(g := np.ascontiguousarray(rows[:, 1]))
                if len(c):
                    lo = np.concatenate([[0], src[:-1] + 1])
                    lo[cut] = 0
                    v = mins.of(lo, src + 1)
                    first = c[cut]
                    v[cut] = np.where(pushed[first], np.minimum(v[cut], carry[first]), -1)
                    new[:, 1] = np.minimum(v + 1, CAP)
                np.minimum(carry, g.min(initial=BIG), out=carry)
                if len(c):
                    ends = src[np.append(cut[1:], len(c)) - 1] + 1
                    carry[first] = mins.of(ends, np.full(len(ends), len(g)))
                    pushed[first] = True
            same = np.zeros((0, 2), dtype=np.int32)
            for a, b in zip(cut, np.append(cut[1:], len(c))[: len(cut)], strict=True):
                if c[a] == char:
                    same = new[a:b]
                else:
                    queue.push(int(c[a]), new[a:b])
            return same

        try:
            for char in range(self.size) if up else range(self.size - 1, -1, -1):
                rows, mine = queue.take(char), []
                while len(rows):
                    if values and not mine:
                        rows[0, 1] = 0  # the one met before has another character
                    mine.append(rows)
                    rows = step(rows, char)
                mine = np.concatenate(mine) if mine else rows
                out.append(mine)
                other = seeds[char]
                if len(other):
                    if values:
                        other = other.copy()
                        other[0, 1] = min(self.run[mine[-1, 0]], self.run[other[0, 0]]) if len(mine) else 0
                    step(other, char)
        finally:
            queue.close()
        return out if up else out[::-1]

    def _both(self, seeds: list[np.ndarray], values: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        low = self._pass(seeds, True, values)

        def back(rows: np.ndarray) -> np.ndarray:
            """Rows in descending order; a value belongs to a row and the one met before it."""
            out = rows[::-1].copy()
            if len(out):
                out[1:, 1] = out[:-1, 1].copy()
                out[0, 1] = 0
            return out

        first = [np.zeros((0, 2), dtype=np.int32) for _ in range(self.size)]
        first[0] = np.array([[len(self.text) - 1, 0]], dtype=np.int32)
        down = self._pass([back(r) if c else first[0] for c, r in enumerate(low)], False, values)
        high = [back(r) for r in down]
        high[0] = first[0]
        return low, high

    def _seeds(self, order: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        rows = np.stack([order, value], axis=1).astype(np.int32)
        c = self.text[order]
        by = np.argsort(c, kind="stable")
        return np.split(rows[by], np.searchsorted(c[by], np.arange(1, self.size)))

    def _names(self) -> tuple[np.ndarray, int]:
        """Order-preserving names of the LMS substrings, in text order."""
        lms, text = self.lms, self.text
        zero = np.zeros(len(lms), dtype=np.int64)
        _, high = self._both(self._seeds(lms, zero), False)
        is_lms = np.zeros(len(text), dtype=bool)
        is_lms[lms] = True
        order = np.concatenate([r[:, 0] for r in high])
        order = order[is_lms[order]]
        at = np.searchsorted(lms, order)
        end = np.append(lms[1:], len(text) - 1)[at] + 1
        key = self.prints(order, np.minimum(end, len(text)))
        names = np.empty(len(lms), dtype=np.int64)
        names[at] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        return names, int(names.max()) + 1

    def prints(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        up, down = _text._Tables.get(len(self.text) + 1)
        if not hasattr(self, "total"):
            self.total = np.zeros(len(self.text) + 1, dtype=np.uint64)
            np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[: len(self.text)], out=self.total[1:])
        return _text.mix((self.total[stop] - self.total[start]) * down[start] + (stop - start).astype(np.uint64))

    def _sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        names, kinds = self._names()
        m, step = len(names), 1
        rank = names
        while kinds < m and step < CAP:
            key = rank * (m + 1)
            key[: m - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(m, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
            kinds, step = int(rank[order[-1]]) + 1, step * 2
        order = self.lms[np.argsort(rank, kind="stable")]
        value = np.zeros(m, dtype=np.int64)
        a, b, n = order[:-1], order[1:], len(self.text)
        room = np.minimum(n - a, n - b)
        got = np.zeros(len(a), dtype=np.int64)
        for bit in (256, 128, 64, 32, 16, 8, 4, 2, 1):
            more = np.minimum(got + bit, room)
            same = self.prints(a, a + more) == self.prints(b, b + more)
            got = np.where(same, more, got)
        value[1:] = got
        return order, value

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array and common-prefix values (up to CAP) with the suffix before."""
        low, high = self._both(self._seeds(*self._sorted_lms()), True)
        parts, values = [], []
        for a, b in zip(low, high, strict=True):
            for rows in (a, b):
                parts.append(rows[:, 0])
                v = rows[:, 1].copy()
                if len(v):
                    v[0] = min(self.run[a[-1, 0]], self.run[b[0, 0]]) if rows is b and len(a) else 0
                values.append(v)
        return np.concatenate(parts), np.concatenate(values)


def suffix_array(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix values of a text, without its end mark."""
    x = np.append(np.frombuffer(text, dtype=np.uint8).astype(np.uint16) + np.uint16(1), np.uint16(0))
    sa, lcp = Induction(x).sort()
    return sa[1:], lcp[1:]
