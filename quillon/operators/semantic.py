"""Dense retrieval over windows, and fusion of rankings."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import bm25, top


#: Questions scored in one pass over the windows; they are sent to all executors.
BLOCK = 2048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length 1; empty, zero and not finite vectors are errors."""
    bad = (F.size(v) == 0) | (norm(v) == 0) | F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("vectors must be finite and not zero"))).otherwise(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0])


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def _best(batches, ids: np.ndarray, queries: np.ndarray, k: int):
    """The best chunks of each batch for each question. A chunk among the k best of all is among the k
    best of the batch that holds its best window."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column("v")
        flat, n = v.flatten().to_numpy(), batch.num_rows
        if len(flat) != n * queries.shape[1]:
            raise ValueError("vectors of windows and questions differ in length")
        score = np.clip(flat.reshape(n, -1) @ queries.T, -1, 1)
        chunk = batch.column("chunk_id")
        keys, owner = np.unique(np.array(chunk.to_pylist(), dtype=object), return_inverse=True)
        best = np.full((len(keys), len(ids)), -2.0)
        np.maximum.at(best, owner, score)
        order = np.argsort(-np.round(best, 10), axis=0, kind="stable")[:k]  # keys are in order, so ties go by chunk
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(ids)), len(order))), pa.array(keys[order.ravel()].tolist(), chunk.type), pa.array(np.take_along_axis(best, order, axis=0).ravel())], ["no", "chunk_id", "s"])


def dense(windows: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """windows (chunk_id, embedding), queries (query_id, embedding): the stated query set against all
    windows; each chunk counts by its best window. Returns query_id, chunk_id, score, rank.
    The questions go over the windows in blocks, as a matrix product per batch."""
    w = windows.select("chunk_id", unit(F.col("embedding")).alias("v"))
    chunk = windows.schema["chunk_id"].dataType.simpleString()
    spark, out, held = windows.sparkSession, None, []

    def flush():
        nonlocal out
        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(held)], f"no long, query_id {queries.schema['query_id'].dataType.simpleString()}")
        vectors = np.array([v for _, v in held], dtype=np.float64)
        part = w.mapInArrow(partial(_best, ids=np.arange(len(held)), queries=vectors, k=k + 8), f"no long, chunk_id {chunk}, s double")
        part = part.groupBy("no", "chunk_id").agg(F.max("s").alias("score")).join(F.broadcast(ids), "no").select("query_id", "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
        held.clear()

    for row in queries.select("query_id", unit(F.col("embedding")).alias("q")).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            flush()
    if held:
        flush()
    if out is None:
        out = queries.select("query_id").limit(0).crossJoin(windows.select("chunk_id").limit(0)).withColumn("score", F.lit(0.0))
    return top(out, k, ["query_id"])


def token_pieces(text: str, embedder, budget: int, limit: int, overlap: int, prefix: str) -> list[str]:
    """The text whole if it fits the limit with its prefix, else windows of up to budget tokens, each
    shortened until it fits when it is tokenised again; the last ends with the text."""
    if embedder.count(prefix + text) <= limit:
        return [text]
    ids, out, start = embedder.encode(text), [], 0
    while start < len(ids):
        stop = min(start + budget, len(ids))
        piece = embedder.decode(ids[start:stop])
        while embedder.count(prefix + piece) > limit:
            stop -= 1
            if stop <= start:
                raise ValueError("no window fits the token budget")
            piece = embedder.decode(ids[start:stop])
        out.append(piece)
        start = len(ids) if stop == len(ids) else max(start + 1, stop - overlap)
    return out


def _embed(batches, make: Callable, column: str, prefix: str, windows: bool, limit: int, overlap: int):
    embedder = None
    for batch in batches:
        key, no, vectors = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(column).to_pylist(), strict=True):
            embedder = embedder or make()  # an empty corpus loads nothing
            text = text or ""
            if windows:
                pieces = token_pieces(text, embedder, limit - embedder.count(prefix), limit, overlap, prefix)
            elif embedder.count(prefix + text) > limit:
                raise ValueError("the question has too many tokens")
            else:
                pieces = [text]
            for j, v in enumerate(embedder.vectors([prefix + p for p in pieces])):
                key.append(i)
                no.append(j)
                vectors.append(np.asarray(v, dtype=np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(key, batch.column(0).type), pa.array(no, pa.int32()), pa.array(vectors, pa.list_(pa.float32()))], [batch.schema.names[0], "window_no", "embedding"])


def embed_passages(chunks: DataFrame, make: Callable, limit: int = 512, overlap: int = 64, prefix: str = "passage: ") -> DataFrame:
    """chunks (chunk_id, text) -> chunk_id, window_no, embedding. make gives an embedder, once for each
    partition that has rows: encode(text) -> ids, decode(ids) -> text, count(text), vectors(texts)."""
    ddl = f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, window_no int, embedding array<float>"
    return chunks.select("chunk_id", "text").mapInArrow(partial(_embed, make=make, column="text", prefix=prefix, windows=True, limit=limit, overlap=overlap), ddl)


def embed_queries(questions: DataFrame, make: Callable, limit: int = 512, prefix: str = "query: ") -> DataFrame:
    """questions (query_id, question) -> query_id, embedding; a question over the limit is an error, never cut."""
    ddl = f"query_id {questions.schema['query_id'].dataType.simpleString()}, window_no int, embedding array<float>"
    return questions.select("query_id", "question").mapInArrow(partial(_embed, make=make, column="question", prefix=prefix, windows=False, limit=limit, overlap=0), ddl).drop("window_no")


def uncovered(chunks: DataFrame, windows: DataFrame) -> DataFrame:
    """Chunks without a window, and windows without a chunk; both must be empty."""
    a = chunks.select("chunk_id").distinct().join(windows, "chunk_id", "left_anti").select("chunk_id", F.lit("no window").alias("fault"))
    return a.unionByName(windows.select("chunk_id").distinct().join(chunks, "chunk_id", "left_anti").select("chunk_id", F.lit("no chunk").alias("fault")))


def fuse(*rankings: DataFrame, k: int = 5, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, chunk_id, rank)."""
    if constant <= 0:
        raise ValueError("the constant must be positive")
    rows = None
    for r in rankings:
        part = r.select("query_id", "chunk_id", (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return top(rows.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")), k, ["query_id"])


def fingerprint(chunks: DataFrame, metadata: str, *keys: str) -> DataFrame:
    """One SHA-256 per keys of all (chunk_id, text) and the embedder's metadata, in any row order. Without keys
    the rows' digests are joined by 4,096 buckets first, so that no task gets them all."""
    each = F.sha2(F.concat(F.col("chunk_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))), 256)
    rows, one = chunks.select(*keys, each.alias("h")), F.array_join(F.array_sort(F.collect_list("h")), "")
    if not keys:
        rows = rows.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.concat(F.min(F.substring("h", 1, 3)), F.sha2(one, 256)).alias("h"))
    return rows.groupBy(*keys).agg(F.sha2(F.concat(F.lit(metadata), one), 256).alias("fingerprint"))


def retrieve(chunks: DataFrame, questions: DataFrame, mode: str = "bm25", k: int = 5, windows: DataFrame | None = None, vectors: DataFrame | None = None, depth: int = 20) -> DataFrame:
    """Hits by bm25, dense or hybrid; the latter two need windows (chunk_id, embedding) of the chunks
    and vectors (query_id, embedding) of the questions."""
    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "bm25" and (windows is None or vectors is None):
        raise ValueError("dense retrieval needs windows and vectors")
    if mode == "bm25":
        return bm25(chunks, questions, k)
    if mode == "dense":
        return dense(windows, vectors, k)
    return fuse(bm25(chunks, questions, max(k, depth)), dense(windows, vectors, max(k, depth)), k=k)
