"""Benchmark passages in documents, by SimHash over item-sized windows.

Words are lower-cased runs of other bytes than white space. A window's fingerprint is the 64-bit
SimHash of its word pairs, kept as running sums, so that a window of any size costs one difference.
Item sizes fall into classes (each within a tenth above its class size): an item's first words of
that size stand for it, against every window of that size in every document. Fingerprints are cut
into four blocks of 16 bits: two within RADIUS bits of each other agree in some block but for
RADIUS // 4 bits, so tables of all such neighbours of each item's blocks find every pair within
the radius. These pairs are decided by the weighted Jaccard similarity (least over greatest counts)
of five-word shingles between the item and the document's window of the item's own length.

The benchmark is read in blocks of ITEMS items, each of which is sent to all executors and goes
once over the documents. Nulls: null texts are empty, an item without words finds nothing, null
ids are carried. A document shorter than an item is one window. Rows with equal ids are merged in
the result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._shared import read

K, NUM, DEN, RADIUS, BLOCKS, ITEMS, CHUNK = 5, 80, 100, 15, 4, 4096, 16384
_NEAR = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), r)], dtype=np.uint16)


def _sums(h: np.ndarray) -> np.ndarray:
    """Running sums (n, 64) of the signs of the bits of word pairs; row i: the pairs before i."""
    pairs = _text.mix(h[:-1] * np.uint64(_text.MIX[0]) + h[1:] * np.uint64(_text.MIX[1]))
    signs = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    kind = np.int16 if len(h) < 1 << 15 else np.int32
    out = np.zeros((len(h), 64), dtype=kind)
    np.cumsum(signs * np.int8(2) - np.int8(1), axis=0, dtype=kind, out=out[1:])
    return out


def _prints(sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    return np.packbits(sums[stop] > sums[start], axis=1).view(np.uint64).reshape(-1)


def _shingles(h: np.ndarray) -> np.ndarray:
    return _text.shingles(h, np.array([0, len(h)]), K)[0]


class Items:
    """A block of benchmark items, ready for search."""

    def __init__(self, rows: list[tuple[object, str]]):
        data = [(i, self._words(t or "")) for i, t in rows]
        data = [(i, h) for i, h in data if len(h)]
        self.ids, self.lengths = [i for i, _ in data], [len(h) for _, h in data]
        self.bags = [Counter(_shingles(h).tolist()) for _, h in data]
        self.classes: list[tuple[int, list[int], np.ndarray, list[np.ndarray]]] = []
        left = sorted(range(len(data)), key=lambda i: self.lengths[i])
        while left:
            size = self.lengths[left[0]]
            mine = [i for i in left if self.lengths[i] <= size * 1.1][:64]
            left = [i for i in left if i not in set(mine)]
            prints = np.array([_prints(_sums(data[i][1][:size]), np.array([0]), np.array([size - 1]))[0] for i in mine], dtype=np.uint64)
            mask = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(mine) <= np.iinfo(t).bits)  # small tables stay in cache
            tables = [np.zeros(1 << 16, dtype=mask) for _ in range(BLOCKS)]
            for no, p in enumerate(prints.view(np.uint16).reshape(-1, BLOCKS)):
                for t, block in zip(tables, p, strict=True):
                    t[_NEAR ^ block] |= mask(1 << no)
            self.classes.append((size, mine, prints, tables))

    @staticmethod
    def _words(text: str) -> np.ndarray:
        data = _text.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        starts, ends, _ = _text.words(data, np.array([0, len(data)]))
        return _text.hashes(data, starts, ends)

    def search(self, h: np.ndarray, first: np.ndarray):
        """(document, item, first word, similarity) of the best window of each pair that is found.
        h: word hashes of a block of documents; first: each document's first word."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found: set[tuple[int, int]] = set()
        longest = max((c[0] for c in self.classes), default=0)
        for at in range(0, len(h), CHUNK):
            part = h[at : at + CHUNK + longest]
            sums, here = _sums(part), doc[at : at + CHUNK + longest]
            for size, mine, prints, tables in self.classes:
                n = min(CHUNK, len(part) - size + 1)
                if n <= 0 or size < 2:
                    continue
                self._hits(_prints(sums, slice(0, n), slice(size - 1, size - 1 + n)), np.flatnonzero(here[:n] == here[size - 1 : size - 1 + n]), at, mine, prints, tables, found)
        n, whole = np.diff(first), {}
        for size, mine, prints, tables in self.classes:  # documents shorter than a class are one window
            few = np.flatnonzero((n < size) & (n >= 2) & (n * DEN >= size * (NUM - 10)) | ((n == 1) & (size == 1)))
            for d in few:
                if d not in whole:
                    whole[d] = _prints(_sums(h[first[d] : first[d + 1]]), np.array([0]), np.array([n[d] - 1]))
                self._hits(whole[d], np.array([0]), int(first[d]), mine, prints, tables, found)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        last, own = -1, None
        for s, i in sorted(found):
            d, size = int(doc[s]), self.lengths[i]
            if d != last:
                last, own = d, _shingles(h[first[d] : first[d + 1]]).tolist()
            start = max(0, min(s - int(first[d]), int(n[d]) - size))
            if min(size, n[d]) >= K:  # the window's shingles are some of the document's
                bag = Counter(own[start : start + min(size, int(n[d])) - K + 1])
            else:
                bag = Counter(_shingles(h[first[d] + start : first[d] + min(start + size, int(n[d]))]).tolist())
            least = sum((bag & self.bags[i]).values())
            most = bag.total() + self.bags[i].total() - least
            if DEN * least >= NUM * most and (least / most, -start) > best.get((d, i), (0.0, 0)):
                best[d, i] = (least / most, -start)
        return [(d, i, -start, sim) for (d, i), (sim, start) in best.items()]

    @staticmethod
    def _hits(own, valid, at, mine, prints, tables, found) -> None:
        own = own[valid]
        blocks = own.view(np.uint16).reshape(-1, BLOCKS)
        masks = tables[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            masks |= tables[b][blocks[:, b]]
        some = np.flatnonzero(masks)
        own, masks, valid = own[some], masks[some], valid[some]
        if not len(some):
            return
        # all pairs of a window and an item whose bit its mask holds, at once
        width = 8 * masks.itemsize
        pairs = np.flatnonzero(np.unpackbits(masks.view(np.uint8), bitorder="little").view(bool))
        x, no = pairs >> (width.bit_length() - 1), pairs & (width - 1)
        near = np.bitwise_count(own[x] ^ prints[no]) <= RADIUS
        found.update((at + s, mine[i]) for s, i in zip(valid[x[near]].tolist(), no[near].tolist(), strict=True))


def _search(batches, items: Items):
    for batch in batches:
        ids, out = batch.column("doc_id"), []
        for i, _, data, offs in _text.blocks(batch.column("text")):
            data = _text.LOWER[data]
            starts, ends, first = _text.words(data, offs)
            if len(starts):
                out += [(i + d, items.ids[n], s, sim) for d, n, s, sim in items.search(_text.hashes(data, starts, ends), first)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.float64())], ["doc_id", "item_id", "start", "similarity"])


def _clean(batches, items: Items):
    """Rows whose text holds none of the items."""
    for batch in batches:
        for i, j, data, offs in _text.blocks(batch.column("text")):
            keep, data = np.ones(j - i, dtype=bool), _text.LOWER[data]
            starts, ends, first = _text.words(data, offs)
            if len(starts):
                keep[[d for d, *_ in items.search(_text.hashes(data, starts, ends), first)]] = False
            yield batch.slice(i, j - i).filter(pa.array(keep))


def _item_blocks(benchmark: DataFrame):
    """The benchmark in blocks of ITEMS items; one empty block if it has none."""
    block, some = [], False
    for row in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS:
            yield Items(block)
            block, some = [], True
    if block or not some:
        yield Items(block)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (first word of the best window) and similarity of each pair of a
    document and a benchmark item that it holds."""
    docs = docs.select("doc_id", "text")
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, start long, similarity double"
    parts = [docs.mapInArrow(partial(_search, items=items), ddl) for items in _item_blocks(benchmark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col2")).alias("start"), F.col("b.similarity").alias("similarity"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Each row is judged by its own text, so null and repeated
    ids need no rule; rows of null or empty text stay."""
    for items in _item_blocks(read(spark, sf_dir, "benchmark")):
        docs = docs.mapInArrow(partial(_clean, items=items), docs.schema)
    return docs


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
