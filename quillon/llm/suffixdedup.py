"""Exact removal of long repeated byte strings, by external induced suffix sorting of shards.

Every LENGTH-byte window of a document has an anchor: its K-byte gram of least hash (the leftmost of
equals), which depends on the window's bytes alone. Equal windows have equal anchors at equal
places, so windows are dealt to shards by the hash of their anchor and no pair is lost. Consecutive
windows with the same anchor are one stretch (about 170 windows). Stretches of equal bytes are
counted by partial aggregation, which settles copies of any number; an anchor hash with a single
stretch in the corpus holds no repeat. Of what is left, one stretch of each kind goes to its
shard, where the induced sorter (induced.py) orders all suffixes with common-prefix values:
windows that share LENGTH bytes and start at different places are repeats. A window reaches half of
LENGTH - K bytes beyond its anchor on one side at least, so only stretches whose bytes on one side
of the anchor equal another stretch's so far are sorted.

An anchor of more than HOT different stretches is not sent to one task: the windows of its stretches
are hashed one by one, and hashes that occur twice, counted by partial aggregation, are repeats. All
windows of a stretch hold its anchor, so what its repeated windows cover is one range.

The same windows over words instead of bytes (PASSAGE words, grams of GRAM words) tell which documents
hold a passage of more than 50 words that another document holds too, however short the words; there
all stretches that equal counts don't settle go by the windows' hashes.

Nulls: a null text is empty; a null doc_id is carried. Rows of equal doc_id and text are repeats
of each other (but one document for passages); rows of equal doc_id and other text are kept apart.
Texts under LENGTH bytes have no windows. Other columns are ignored. All hashes have 64 bits and
stretches compare by two.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._shared import Table, read
from .induced import Induction

LENGTH, K, BLOCK, SHARD, HOT = 400, 64, 1 << 18, 2 << 20, 1 << 13
PASSAGE, GRAM = 51, 8


def _spans(values: np.ndarray):
    """A function that hashes ranges of values."""
    up, down = _text._Tables.get(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return lambda a, b: _text.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _stretches(values: np.ndarray, offs: np.ndarray, length: int, k: int):
    """(document, first window in it, windows, anchor's place after the first window, anchor hash,
    hash of the values, of which the number of windows is a part) of the stretches of a block."""
    n = len(values)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    span, grams = _spans(values), n - k + 1
    h = span(np.arange(grams), np.arange(grams) + k)
    bits = max(20, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = (h & ~low) | np.arange(grams, dtype=np.uint64)
    w, width = length - k + 1, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < w:
        m = np.minimum(m[: len(m) - (w - width)], m[w - width :])
    size = np.diff(offs)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    s = np.arange(len(doc)) + np.repeat(offs[:-1] - np.concatenate([[0], np.cumsum(np.maximum(size - length + 1, 0))])[:-1], np.maximum(size - length + 1, 0))
    at = (m[s] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(s)))
    first, anchor = s[new], at[new]
    return [doc[new], first - offs[doc[new]], count, anchor - first, h[anchor], span(first, first + count - 1 + length)]


def _scan(batches, length: int, k: int, passage: int):
    for batch in batches:
        parts = []
        for i, _, data, offs in _text.blocks(batch.column("text"), BLOCK):
            both = [(0, _stretches(data, offs, length, k))]
            if passage:
                starts, ends, first = _text.words(data, offs)
                both.append((1, _stretches(_text.hashes(data, starts, ends), first, passage, GRAM)))
            parts += [[x[0] + i, np.full(len(x[0]), unit, np.int8), *x[1:]] for unit, x in both]
        row, unit, first, count, lead, h, c = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 7
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (unit, first, count, lead)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))],
            ["uid", "unit", "first", "count", "lead", "anchor", "bytes"],
        )


def _cut(batches, length: int, k: int, passage: int):
    """Of the stretches that are wanted of each document: their bytes, or the hashes of their windows;
    and the hashes of what lies left and right of the anchor, as far as half a window reaches."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield _cut_part(batch.slice(i, 256), length, k, passage)


def _cut_part(batch, length: int, k: int, passage: int):
    data, offs = _text.utf8(batch.column("text"))
    rows, texts, hashed, left, right = [], [], [], [], []
    for i, want in enumerate(batch.column("want").to_pylist()):
        text = data[offs[i] : offs[i + 1]]
        for unit, window, gram in ((0, length, k), (1, passage, GRAM)):
            mine = [x for x in want if x["unit"] == unit]
            if not mine:
                continue
            values = _text.hashes(text, *_text.words(text, np.array([0, len(text)]))[:2]) if unit else text
            span, reach = _spans(values), -(-(window - gram) // 2)
            first, count, lead = (np.array([x[c] for x in mine], dtype=np.int64) for c in ("first", "count", "lead"))
            at, last = first + lead, first + count - 1 + window
            before, after = span(np.maximum(at - reach, first), at), span(at + gram, np.minimum(at + gram + reach, last))
            for j, x in enumerate(mine):
                rows.append((i, unit, x["first"], x["anchor"]))
                left.append(int(before[j].view(np.int64)) if lead[j] >= reach else None)
                right.append(int(after[j].view(np.int64)) if at[j] + gram + reach <= last[j] else None)
                texts.append(None if x["hot"] else text[x["first"] : last[j]].tobytes())
                w = np.arange(x["first"], x["first"] + x["count"])
                hashed.append(span(w, w + window).view(np.int64) if x["hot"] else None)
    row, unit, first, anchor = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [batch.column("uid").take(pa.array(row, pa.int64())), pa.array(unit, pa.int32()), pa.array(first, pa.int32()), pa.array(anchor, pa.int64()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(texts, pa.binary()), pa.array(hashed, pa.list_(pa.int64()))],
        ["uid", "unit", "first", "anchor", "left", "right", "text", "windows"],
    )


def repeats(texts: list[bytes], place: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch, the windows (by start) that also occur at another place of the shard.
    place: number of each stretch's first byte, unique for each byte of the corpus in this shard."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(2)
    joined[begin[1:] - 1] = 1
    sa, lcp = Induction(np.append(joined, np.uint16(0))).sort()
    of = np.repeat(np.arange(len(texts)), lens + 1)
    rel = np.arange(len(of)) - begin[of]
    sa, lcp = sa[1:], lcp[1:]
    run = np.cumsum(lcp < length)
    ok = rel[sa] + length <= lens[of[sa]]
    sa, run = sa[ok], run[ok]
    if not len(sa):
        return [np.zeros(0, np.int64) for _ in texts]
    where = place[of[sa]] + rel[sa]
    cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    several = np.minimum.reduceat(where, cut) != np.maximum.reduceat(where, cut)
    hit = np.sort(sa[np.repeat(several, np.diff(np.append(cut, len(sa))))])
    split = np.searchsorted(hit, begin)
    return [hit[split[i] : split[i + 1]] - begin[i] for i in range(len(texts))]


def _shards(batches, length: int):
    """Takes rows in order of anchor; sorts about SHARD bytes of whole anchors at a time."""
    rows, size = [], 0

    def flush():
        ids, places, out = {}, [], []
        for uid, first, _, _ in rows:
            places.append((ids.setdefault(uid, len(ids)) << 40) + first)
        for r, hits in zip(rows, repeats([r[3] for r in rows], np.array(places, dtype=np.int64), length), strict=True):
            if len(hits):
                edge = np.flatnonzero(np.diff(hits) > length)
                lo, hi = hits[np.concatenate([[0], edge + 1])], hits[np.append(edge, len(hits) - 1)] + length
                out += [(r[0], r[1] + int(a), r[1] + int(b)) for a, b in zip(lo, hi, strict=True)]
        return out

    for batch in batches:
        ready = []
        for r in zip(*(batch.column(c).to_pylist() for c in ("uid", "first", "anchor", "text")), strict=True):
            if size >= SHARD and r[2] != rows[-1][2]:
                ready += flush()
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
        yield _ranges(ready)
    if rows:
        yield _ranges(flush())


def _ranges(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["uid", "lo", "hi"])


def _result(batches):
    for batch in batches:
        data, offs = _text.utf8(batch.column("text"))
        out = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offs[i] : offs[i + 1]]
            keep = np.zeros(len(text) + 1, dtype=np.int32)
            for x in spans or ():
                keep[x["lo"]] += 1
                keep[x["hi"]] -= 1
            gone = np.cumsum(keep)[:-1] > 0
            starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            out.append((len(text), int(gone.sum()), starts, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), batch.column("shares_passage")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, passage: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs (uid, text) -> (uid, lo, hi), byte ranges that other places repeat, and with passage the
    (uid) of documents that hold so many words in a row that another document holds."""
    found = Table(docs.mapInArrow(partial(_scan, length=length, k=k, passage=passage), "uid long, unit int, first int, count int, lead int, anchor long, bytes long"), "stretches")
    # equal bytes have equal anchors, places of the anchor and numbers of windows; any member can stand for a kind
    one = [F.first(c).alias(c) for c in ("unit", "uid", "first", "count", "lead")]
    kinds = Table(found.df.groupBy("anchor", "bytes").agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi"), *one), "kinds")
    several = kinds.df.where("if(unit = 0, n > 1, lo <> hi)").select("anchor", "bytes")
    same = found.df.join(several, ["anchor", "bytes"], "left_semi").select("uid", "unit", F.when(F.col("unit") == 0, F.col("first")).alias("lo"), F.expr(f"if(unit = 0, first + count - 1 + {length}, null)").alias("hi"))
    same = Table(same.distinct(), "same").df
    found.drop()
    mixed = kinds.df.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("kinds > 1").selectExpr("anchor", "kinds", "lo <> hi as several")
    want = kinds.df.drop("lo", "hi").join(mixed, "anchor").where("unit = 0 or several").select("uid", F.struct("unit", "first", "count", "lead", "anchor", F.expr(f"unit = 1 or kinds > {HOT}").alias("hot")).alias("want"))
    want = want.groupBy("uid").agg(F.collect_list("want").alias("want"))
    cut = docs.join(want, "uid").select("uid", "text", "want").mapInArrow(partial(_cut, length=length, k=k, passage=passage), "uid long, unit int, first int, anchor long, left long, right long, text binary, windows array<long>")
    cut = Table(cut, "cut")
    kinds.drop()
    # a stretch is alone if on neither side of the anchor another stretch has the same
    sides = [cut.df.where(F.col(c).isNotNull()).select("anchor", F.lit(c).alias("side"), F.col(c).alias("context")) for c in ("left", "right")]
    shared = sides[0].unionByName(sides[1]).groupBy("anchor", "side", "context").count().where("count > 1")
    for c in ("left", "right"):
        with_ = shared.where(F.col("side") == c).select("anchor", F.col("context").alias(c), F.lit(True).alias(f"same_{c}"))
        cut_ = (cut.df if c == "left" else cut_).join(with_, ["anchor", c], "left")  # noqa: F821
    live = Table(cut_.where("same_left or same_right").select("uid", "unit", "first", "anchor", "text", "windows"), "live")
    cut.drop()
    sorted_ = live.df.where("windows is null").select("uid", "first", "anchor", "text").repartition("anchor").sortWithinPartitions("anchor", "uid", "first")
    other = Table(sorted_.mapInArrow(partial(_shards, length=length), "uid long, lo int, hi int"), "repeats").df
    # windows one by one: bytes that stand at another place
    bytes_ = live.df.where("unit = 0 and windows is not null").select("uid", "first", F.posexplode("windows").alias("at", "window"))
    twice = bytes_.groupBy("window").count().where("count > 1").select("window")
    hot = Table(bytes_.join(twice, "window", "left_semi").groupBy("uid", "first").agg(F.min("at").alias("a"), F.max("at").alias("b")), "windows").df
    spans = same.where("unit = 0").select("uid", "lo", "hi").unionByName(hot.select("uid", F.expr("first + a").alias("lo"), F.expr(f"first + b + {length}").alias("hi"))).unionByName(other)
    # passages that stand in another document, for documents of which none is known yet
    told = same.where("unit = 1").select("uid")
    words = live.df.where("unit = 1").select("uid", F.explode("windows").alias("passage"))
    shared = words.groupBy("passage").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi").select("passage")
    more = Table(words.join(told, "uid", "left_anti").join(shared, "passage", "left_semi").select("uid").distinct(), "passages").df
    live.drop()
    return spans, told.unionByName(more)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, passage: int = PASSAGE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage (a
    passage of so many words stands in another document too), a row per row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    ranges, shared = repeated_spans(docs.select("uid", "text"), length, k, passage)
    spans = ranges.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).join(shared.withColumn("shares", F.lit(True)), "uid", "full")
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.join(spans, "uid", "left").select("doc_id", "text", "spans", F.coalesce("shares", F.lit(False)).alias("shares_passage"))
    return both.mapInArrow(_result, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
