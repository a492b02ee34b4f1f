"""Retrieval quality: evidence recall over hits and gold passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import layout, lexical


def evidence_recall(gold: DataFrame, hits: DataFrame, chunks: DataFrame, by_page: bool = False) -> DataFrame:
    """gold (query_id, document_id, quote; by_page: page too): share of each question's gold that stands in its
    hits, texts normalised (NFKC, white space)."""
    where = ["document_id", "page"] if by_page else ["document_id"]
    texts = lexical.texts(hits.select("query_id", "chunk_id"), chunks.select("chunk_id", *where, "text")).select("query_id", *where, T.normalized(F.col("text")).alias("t"))
    g = gold.select("query_id", *where, T.normalized(F.col("quote")).alias("q")).distinct()
    found = g.alias("g").join(texts.alias("t"), ["query_id", *where], "left")
    each = found.groupBy("query_id", *where, "q").agg(F.max(F.coalesce(F.contains("t", "q"), F.lit(False)).cast("double")).alias("hit"))
    return each.groupBy("query_id").agg(F.avg("hit").alias("recall"), F.count("*").alias("n_gold"))


def summary(recall: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Mean recall overall (null group; null over no questions) and by a property of the question."""
    rows = recall.join(groups, "query_id")
    values = F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("questions")
    overall = rows.agg(*values).select(F.lit(None).cast(groups.schema[by].dataType).alias(by), "recall", "questions")
    return rows.groupBy(by).agg(*values).unionByName(overall)


def candidates(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits per question, none included: the probe of questions without an answer."""
    return questions.select("query_id").join(hits.select("query_id", "chunk_id"), "query_id", "left").groupBy("query_id").agg(F.count("chunk_id").alias("candidates"))


def report(rows: DataFrame) -> DataFrame:
    """rows (query_id, answerable, kind, language, document_id, recall, bound) -> section, value, recall, bound,
    questions: means over the answerable questions overall, those on tables, by language and by document."""
    r = rows.where("answerable")
    values = F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.when(F.col("kind") == "table", F.col("bound"))), 6).alias("bound"), F.count("*").alias("questions")
    part = lambda name, d, value: d.groupBy(value.cast("string").alias("value")).agg(*values).select(F.lit(name).alias("section"), "value", "recall", "bound", "questions")
    overall = r.agg(*values).select(F.lit("overall").alias("section"), F.lit(None).cast("string").alias("value"), "recall", "bound", "questions")
    return overall.unionByName(part("tables", r.where("kind = 'table'"), F.lit("table"))).unionByName(part("language", r, F.col("language"))).unionByName(part("document", r, F.col("document_id")))


def availability(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether all of a question's gold (query_id, document_id, quote) is in some chunk."""
    g = gold.select("query_id", "document_id", T.normalized(F.col("quote")).alias("q")).distinct()
    c = chunks.join(gold.select("document_id").distinct(), "document_id", "left_semi").select("document_id", T.normalized(F.col("text")).alias("t"))
    each = g.join(c, "document_id", "left").groupBy("query_id", "document_id", "q").agg(F.max(F.coalesce(F.contains("t", "q"), F.lit(False))).alias("there"))
    return each.groupBy("query_id").agg(F.bool_and("there").alias("available"), F.count("*").alias("n_gold"))


def has_evidence(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs (gold_id, chunk_id): equal document and page, the quote in the text, and a box of the chunk around
    the centre of the gold's box."""
    c = chunks.select("chunk_id", "document_id", "page", T.normalized(F.col("text")).alias("t"), "boxes")
    g = gold.select("gold_id", "document_id", "page", T.normalized(F.col("quote")).alias("q"), "bbox")
    return g.join(c, ["document_id", "page"]).where(F.contains("t", "q") & F.exists("boxes", lambda b: layout.contains_center(b, F.col("bbox")))).select("gold_id", "chunk_id")


def bound_cells(cells: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold (gold_id, chunk_id, value, row_label, column_label, bbox, and row_context where it is told) that a
    bindable cell matches: equal but for compatibility forms and white space, its row holding the
    context, its box around the centre of the gold's."""
    same = lambda x: T.compact(T.nfkc(x))
    names = ("value", "row_label", "column_label")
    c = cells.select("chunk_id", *(same(F.col(x)).alias(f"c_{x}") for x in names), "box", *([same(F.col("row_text")).alias("c_row")] if "row_text" in cells.columns else [F.lit("").alias("c_row")]))
    context = same(F.col("row_context")) if "row_context" in gold.columns else F.lit(None).cast("string")
    g = gold.withColumns({f"g_{x}": same(F.col(x)) for x in names} | {"g_row": context})
    cond = layout.contains_center(F.col("box"), F.col("bbox")) & (F.col("g_row").isNull() | F.contains("c_row", "g_row"))
    hit = g.join(c, [F.col(f"g_{x}") == F.col(f"c_{x}") for x in names] + [g["chunk_id"] == c["chunk_id"], cond], "left_semi")
    return hit.select(*gold.columns)


def provenance(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, sha256 of each table's rows in any order: the digest of the sorted digests' prefixes is
    taken by 4,096 buckets first, so that no task gets more than a bucket."""
    out = None
    for name, t in tables.items():
        each = t.select(F.sha2(F.to_json(F.struct(*(t[c] for c in t.columns))), 256).alias("h"))
        buckets = each.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
        one = buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "h"))), ""), 256).alias("sha256")).select(F.lit(name).alias("name"), "n_rows", "sha256")
        out = one if out is None else out.unionByName(one)
    return out


def compare_chunkers(chunkers: dict[str, DataFrame], questions: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """Recall@k of the same questions over several sets of chunks (chunk_id, document_id, text)."""
    out = None
    for name, chunks in chunkers.items():
        r = evidence_recall(gold, lexical.keep(lexical.bm25(chunks, questions, k=k)), chunks).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("questions")).select(F.lit(name).alias("chunker"), "recall", "questions")
        out = r if out is None else out.unionByName(r)
    return out
