"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of letters (ASCII letters and all bytes from 128), and their first four,
five and six bytes, hashed to 2^20 buckets. The machine is fitted on at most SAMPLE labelled rows
(those of the least hashes of doc_id; crc32(doc_id) mod 5 of 0 is held out). Spark counts every
bucket by class. Buckets enter the machine, as present or absent, in two ways: the TERMS that tell
the classes apart best alone (a z-score of LEAST_Z at least), and those that tell together: of the
PAIRED most frequent others and the former, the members of pairs whose presence together shifts
the share of a class beyond what the two do alone (PAIR_Z). The machine has a bias, a weight per
term and FACTORS latent factors, whose products weigh each pair of terms. It is trained in numpy by
Adam, with a fixed seed, on the logistic loss, a batch of rows at a time. To the driver go only the
chosen buckets of each row. Scoring is one pass over whole texts with the fitted table.

Nulls: a null text is empty and gets the score of no terms; null labels are not learnt from; a null
doc_id is hashed as null and held out. Without labelled rows every score is 0. Repeated label rows
count as often as they occur. Only text enters a score; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._shared import Table, read

BUCKETS, TERMS, FACTORS, SAMPLE, EPOCHS, BATCH, RATE, SHRINK, LEAST_Z = 1 << 20, 1024, 8, 16_000, 30, 256, 0.02, 2e-4, 3.0
PAIRED, PAIR_Z, MOST = 1024, 6.0, 1 << 11
OTHER = np.ones(256, dtype=bool)
OTHER[97:123] = False
OTHER[128:] = False


def _terms(text):
    """(first row, documents' number, document and bucket of each term) of blocks."""
    for i, j, data, offs in _text.blocks(text):
        data = _text.LOWER[data]
        starts, ends, first = _text.words(data, offs, OTHER)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        parts = [(doc, _text.hashes(data, starts, ends))]
        for size in (4, 5, 6):
            longer = ends - starts > size
            s = starts[longer]
            parts.append((doc[longer], _text.mix(_text.hashes(data, s, s + size) + np.uint64(size))))
        yield i, j - i, np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _examples(batches):
    for batch in batches:
        rows = []
        for _, n, doc, bucket in _terms(batch.column("text")):
            both = np.unique(doc * BUCKETS + bucket)
            cut = np.searchsorted(both, np.arange(n + 1) * BUCKETS)
            rows += [both[cut[d] : cut[d + 1]] % BUCKETS for d in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "terms"])


def _chosen(batches, column: np.ndarray):
    for batch in batches:
        cols = [column[x.values.to_numpy()] for x in batch.column("terms")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([c[c >= 0].tobytes() for c in cols], pa.binary())], ["toxic", "columns"])


class Machine:
    """A fitted factorization machine: column of each bucket (-1: none), bias, weights, factors."""

    def __init__(self, column: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.column, self.bias, self.weights, self.factors = column, bias, weights, factors

    def score(self, n: int, doc: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        col = self.column[bucket]
        use = col >= 0
        both = np.unique(doc[use] * MOST + col[use])
        d, c = both // MOST, both % MOST
        v = self.factors[c]
        z = np.full(n, self.bias) + np.bincount(d, self.weights[c], n)
        for f in range(FACTORS):
            z += 0.5 * (np.bincount(d, v[:, f], n) ** 2 - np.bincount(d, v[:, f] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Labelled rows as compressed sparse rows of chosen columns."""

    def __init__(self, rows: list[tuple[int, bytes]], width: int):
        self.y = np.array([r[0] for r in rows], dtype=np.float32)
        self.cut = np.concatenate([[0], np.cumsum([len(r[1]) // 2 for r in rows])]).astype(np.int64)
        self.col, self.width = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.int16), width

    def dense(self, at: np.ndarray) -> np.ndarray:
        n = self.cut[at + 1] - self.cut[at]
        x = np.zeros((len(at), self.width), dtype=np.float32)
        place = np.repeat(self.cut[at] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        x[np.repeat(np.arange(len(at)), n), self.col[place]] = 1
        return x

    def keep(self, use: np.ndarray) -> Rows:
        """The same rows with only the columns in use, numbered anew."""
        out, to = Rows([], int(use.sum())), np.where(use, np.cumsum(use) - 1, -1).astype(np.int16)
        col = to[self.col]
        out.y, out.col = self.y, col[col >= 0]
        out.cut = np.concatenate([[0], np.cumsum(col >= 0)])[self.cut]
        return out


def together(rows: Rows) -> np.ndarray:
    """Which columns belong to a pair that tells the classes apart beyond its members: the z-score of
    the interaction, the both-present share of class 1 less what the log-odds of each alone add up to."""
    w = rows.width
    pair, one = np.zeros((2, w, w), dtype=np.float32), np.zeros((2, w))
    for k in range(0, len(rows.y), 1024):
        at = np.arange(k, min(k + 1024, len(rows.y)))
        x = rows.dense(at)
        for c in (0, 1):
            part = x[rows.y[at] == c]
            pair[c] += part.T @ part
            one[c] += part.sum(axis=0)
    total = np.array([(rows.y == 0).sum(), (rows.y == 1).sum()], dtype=np.float32)
    score, spread = np.zeros((w, w), dtype=np.float32), np.zeros((w, w), dtype=np.float32)
    for c, sign in ((1, 1), (0, -1)):  # the four cells of each pair's table, half a row added to each
        n = one[c].astype(np.float32)
        for cell, s in ((pair[c], 1), (n[:, None] - pair[c], -1), (n[None, :] - pair[c], -1), (total[c] - n[:, None] - n[None, :] + pair[c], 1)):
            score += sign * s * np.log(cell + np.float32(0.5))
            spread += 1 / (cell + np.float32(0.5))
    z = np.abs(score) / np.sqrt(spread)
    np.fill_diagonal(z, 0)
    return z.max(axis=1, initial=0) >= PAIR_Z


def fit(rows: Rows, buckets: np.ndarray) -> Machine:
    """Trains on rows whose columns stand for buckets."""
    column = np.full(BUCKETS, -1, dtype=np.int16)
    y, width = rows.y, max(rows.width, 1)
    if not len(y) or not 0 < y.sum() < len(y):
        return Machine(column, 40.0 if len(y) and y.all() else -40.0, np.zeros(width), np.zeros((width, FACTORS)))
    column[buckets] = np.arange(len(buckets))
    rng = np.random.default_rng(11)
    params = [np.array([np.log(y.sum() / (len(y) - y.sum()))], dtype=np.float32), np.zeros(rows.width, dtype=np.float32), rng.normal(0, 0.01, (rows.width, FACTORS)).astype(np.float32)]
    moments, step = [(np.zeros_like(q), np.zeros_like(q)) for q in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            at = order[k : k + BATCH]
            xb, (w0, w, v) = rows.dense(at), params
            xv = xb @ v
            score = w0 + xb @ w + 0.5 * ((xv**2).sum(1) - xb @ (v**2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[at]) / len(at)
            grads = [g.sum(keepdims=True), xb.T @ g + SHRINK * w, xb.T @ (g[:, None] * xv) - (xb.T @ g)[:, None] * v + SHRINK * v]
            step += 1
            for q, d, (m1, m2) in zip(params, grads, moments, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                q -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Machine(column, float(params[0][0]), params[1].astype(float), params[2].astype(float))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on at most SAMPLE labelled rows that are not held out."""
    known = labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", "toxic")
    known = Table(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE), "sample")
    joined = docs.select("doc_id", "text").join(F.broadcast(known.df), "doc_id").select("toxic", "text")
    examples = Table(joined.mapInArrow(_examples, "toxic int, terms array<int>"), "examples")
    n, m = examples.df.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    m -= n
    if not n or not m:
        machine = fit(Rows([(int(n > 0), b"")] * min(n + m, 1), 0), np.zeros(0, np.int64))
    else:
        counts = examples.df.select("toxic", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where("n >= 3")
        p = (F.col("n") + 1) / (n + m + 2)
        z = F.abs(F.col("a") / n - (F.col("n") - F.col("a")) / m) / F.sqrt(p * (1 - p) * (1 / n + 1 / m))
        counts = Table(counts.withColumn("z", F.round(z, 9)), "terms")
        alone = [r[0] for r in counts.df.where(f"z > {LEAST_Z}").orderBy(F.desc("z"), "bucket").limit(TERMS).select("bucket").collect()]
        often = counts.df.where(f"n between {0.005 * (n + m)} and {0.6 * (n + m)}").orderBy(F.desc("n"), "bucket").limit(PAIRED + TERMS).select("bucket")
        others = [r[0] for r in often.collect() if r[0] not in set(alone)][:PAIRED]
        buckets = np.array(alone + others, dtype=np.int64)
        column = np.full(BUCKETS, -1, dtype=np.int16)
        column[buckets] = np.arange(len(buckets))
        chosen = examples.df.mapInArrow(partial(_chosen, column=column), "toxic int, columns binary")
        rows = Rows(sorted((r[0], bytes(r[1])) for r in chosen.collect()), len(buckets))
        use = together(rows) | (np.arange(len(buckets)) < len(alone))
        machine = fit(rows.keep(use), buckets[use])
        counts.drop()
    examples.drop()
    known.drop()
    return machine


def _score(batches, machine: Machine):
    for batch in batches:
        out = [machine.score(n, doc, bucket) for _, n, doc, bucket in _terms(batch.column("text"))]
        score = np.concatenate(out) if out else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, score, predicted, a row per row."""
    machine = train(docs, labels)
    rows = docs.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(True)).alias("held_out"), "text")
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(partial(_score, machine=machine), ddl)


def _verdict(machine: Machine):
    def toxic(batches):
        for batch in batches:
            for i, n, doc, bucket in _terms(batch.column("text")):
                yield batch.slice(i, n).filter(pa.array(machine.score(n, doc, bucket) < 0.5))

    return toxic


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic (score below 0.5)."""
    machine = train(docs, read(spark, sf_dir, "labels"))
    return docs.mapInArrow(_verdict(machine), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
