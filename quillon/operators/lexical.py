"""BM25 over chunks, for whole batches of questions.

chunks: (chunk_id, document_id, text); questions: (query_id, question). Statistics are narrow tables
keyed by term; only terms of the questions reach a shuffle. scope="document" keeps N, average
length and document frequencies apart by document_id, else the corpus is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators._cut import cut

K1, B = 1.5, 0.75
#: Up to so many distinct terms of questions are sent to all executors; beyond, joins shuffle.
WANTED = 1 << 18


def term_frequency(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("document_id", "chunk_id", "term").agg(F.count("*").alias("tf"))


def document_length(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "chunk_id", F.size(T.tokens(F.col("text"))).cast("long").alias("length"))


def corpus_size(lengths: DataFrame, scope: list[str]) -> DataFrame:
    """n chunks and their average length (empty chunks count; 1 where it would be 0)."""
    return lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("average"))


def document_frequency(tf: DataFrame, scope: list[str]) -> DataFrame:
    return tf.groupBy(*scope, "term").agg(F.count("*").alias("df"))


def chunk_frequency(chunks: DataFrame, scope: list[str]) -> DataFrame:
    """Document frequencies straight from chunks: a chunk's terms are made distinct before any shuffle."""
    return chunks.select(*scope, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy(*scope, "term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, size: DataFrame, scope: list[str]) -> DataFrame:
    return _weighed(df.join(size, scope) if scope else df.crossJoin(F.broadcast(size)))  # size: a single row


def _weighed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("idf", F.expr("ln(1 + (n - df + 0.5D) / (df + 0.5D))"))


def top(scored: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best of each group by score, then chunk_id."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    order = Window.partitionBy(*keys).orderBy(F.round("score", 10).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def _wanted_counts(chunks: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """document_id, chunk_id, term, tf, length: terms of chunks that are wanted, and for each chunk a row of
    the empty term, dealt out by the columns by. Texts are tokenised once; all that follows reads the same shuffled rows."""
    toks = chunks.select("document_id", "chunk_id", T.tokens(F.col("text")).alias("toks")).select("document_id", "chunk_id", F.size("toks").cast("long").alias("length"), F.explode(F.concat("toks", F.array(F.lit("")))).alias("term"))
    toks = toks.select("document_id", "chunk_id", "length", F.coalesce("term", F.lit("")).alias("term"))
    kept = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term")))
    return toks.join(kept, "term", "left_semi").repartition(*by).groupBy("document_id", "chunk_id", "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 5, scope: str = "corpus") -> DataFrame:
    """query_id, document_id, chunk_id, score, rank of the k best chunks of each question.

    With few terms the counts are shuffled once, by chunk (or by document for that scope), and neither pairs of
    question and chunk nor the statistics of a document are shuffled again."""
    keys = ["document_id"] if scope == "document" else []
    wanted = questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term")).select("query_id", F.coalesce("term", F.lit("")).alias("term"))
    terms = wanted.select("term").distinct()
    few = terms.limit(WANTED + 1).count() <= WANTED
    counts = _wanted_counts(chunks, F.broadcast(terms) if few else terms, keys or ["document_id", "chunk_id"])
    # the row of the empty term counts chunks; its mark is computed behind the shuffle, so that no filter reaches below it
    if keys:
        own, term = Window.partitionBy(*keys), Window.partitionBy(*keys, "term")
        rows = counts.withColumns({"df": F.count("*").over(term), "n": F.count(F.when(F.col("term") == "", 1)).over(own), "total": F.sum(F.when(F.col("term") == "", F.col("length"))).over(own)})
        rows = _weighed(rows.withColumn("average", F.expr("coalesce(nullif(total / n, 0D), 1D)")))
    else:
        # no length is below 0: the filter only keeps the column, so that all read one shuffle
        stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("total"), F.max(F.col("term") == "").alias("all")).where("total >= 0")
        size = stats.where("all").select(F.col("df").alias("n"), F.expr("coalesce(nullif(total / df, 0D), 1D)").alias("average"))
        weights = idf(stats.select("term", "df"), size, [])
        rows = counts.join(F.broadcast(weights) if few else weights, "term")
    rows = rows.join(F.broadcast(wanted) if few else wanted, "term")
    part = F.expr(f"idf * tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * length / average))")
    scored = rows.groupBy("query_id", "document_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")
    return top(scored, k, ["query_id", *keys])


def keep(hits: DataFrame) -> DataFrame:
    """Hits that several steps read, computed once."""
    return cut(hits)


def texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with their chunks' columns. Up to WANTED hits go to the chunks, so that no text is shuffled."""
    few = hits.limit(WANTED + 1).count() <= WANTED
    return (F.broadcast(hits) if few else hits).join(chunks, "chunk_id")
