"""Index files: {schema_version, paper, chunks}, versions 1 (without tables) and 2; and Parquet indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<x0:double,top:double,x1:double,bottom:double>"
TABLE = f"struct<rows:array<array<struct<text:string,bbox:{BBOX}>>>,extraction:string,caption:string>"
CHUNK = f"struct<id:string,document_id:string,page:int,section:string,kind:string,text:string,block_ids:array<string>,boxes:array<{BBOX}>,table:{TABLE}>"
INDEX = f"schema_version int, paper struct<id:string,name:string,pages:int,warnings:array<string>>, chunks array<{CHUNK}>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of index files; another version is an error, a missing caption is empty."""
    rows = spark.read.schema(INDEX).option("multiLine", True).json(path)
    checked = F.when(F.col("schema_version").isin(1, 2), F.col("chunks")).otherwise(F.raise_error(F.lit("unsupported schema_version")))
    c = rows.select(F.explode(checked).alias("c")).select("c.*")
    table = F.when(F.col("table").isNotNull(), F.col("table").withField("caption", F.coalesce(F.col("table.caption"), F.lit(""))))
    return c.withColumn("table", table)


def write_index(chunks: DataFrame, path: str) -> None:
    """The engine's own form: Parquet by document."""
    chunks.write.partitionBy("document_id").parquet(path)


def export_index(papers: DataFrame, chunks: DataFrame, path: str) -> None:
    """Index files of version 2: papers (id, name, pages, warnings) with their chunks, an object a line."""
    own = chunks.select(F.col("document_id").alias("_id"), F.from_json(F.to_json(F.struct(*(F.col(c) for c in chunks.columns))), CHUNK).alias("c"))
    own = own.groupBy("_id").agg(F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["page"] != b["page"], a["page"] - b["page"]).when(a["id"] < b["id"], -1).otherwise((a["id"] > b["id"]).cast("int"))).alias("chunks"))
    rows = papers.join(own, F.col("id") == F.col("_id"), "left").select(F.lit(2).alias("schema_version"), F.struct("id", "name", "pages", "warnings").alias("paper"), F.coalesce("chunks", F.expr(f"cast(array() as array<{CHUNK}>)")).alias("chunks"))
    write_json(rows, path)


def scan_files(spark: SparkSession, path: str, max_bytes: int = 30 << 20, sha256: dict[str, str] | None = None) -> DataFrame:
    """PDF files by content: document_id (16 hex digits of SHA-256), name, path, content, and why one is refused:
    its size, its first bytes, or another digest than sha256 has for its name."""
    f = spark.read.format("binaryFile").load(path)
    name, digest = F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)
    why = F.when(F.col("length") > max_bytes, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
    if sha256:
        pinned = F.create_map(*(F.lit(x) for pair in sha256.items() for x in pair))
        why = F.coalesce(why, F.when(F.try_element_at(pinned, name) != digest, "another digest"))
    return f.select(F.substring(digest, 1, 16).alias("document_id"), name.alias("name"), "path", "content", why.alias("refused"))


def within_pages(pages: DataFrame, most: int = 200) -> DataFrame:
    """document_id, pages of documents (document_id, page) with so many pages at most; more are an error."""
    n = pages.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))
    return n.select("document_id", F.when(F.col("pages") <= most, F.col("pages")).otherwise(F.raise_error(F.lit("a document has too many pages"))).alias("pages"))


QA = f"id string, paper_id string, pair_id string, language string, question string, reference_answer string, answerable boolean, evidence array<struct<page:int,quote:string,bbox:array<double>,kind:string,table:struct<row_label:string,column_label:string,row_context:string>>>, review string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Annotated questions of JSON files: arrays of objects. answerable where it is not told: has evidence."""
    rows = spark.read.schema(QA).option("multiLine", True).json(path)
    return rows.withColumn("answerable", F.coalesce("answerable", F.size("evidence") > 0))


def gold_of(questions: DataFrame) -> DataFrame:
    """gold_id, query_id, document_id, page, quote, kind, bbox, and the labels of table gold; a row per evidence."""
    e = questions.select(F.col("id").alias("query_id"), F.col("paper_id").alias("document_id"), F.posexplode("evidence").alias("no", "e"))
    b = F.col("e.bbox")
    bbox = F.when(F.size(b) == 4, F.struct(b[0].alias("x0"), b[1].alias("top"), b[2].alias("x1"), b[3].alias("bottom")))
    return e.select(F.concat("query_id", F.lit(":"), F.col("no")).alias("gold_id"), "query_id", "document_id", "e.page", "e.quote", "e.kind", bbox.alias("bbox"), "e.table.row_label", "e.table.column_label", "e.table.row_context")


def highlights(chunks: DataFrame) -> DataFrame:
    """What a renderer of pages needs: document_id, page, chunk_id, boxes."""
    return chunks.select("document_id", "page", "chunk_id", "boxes")


def read_vectors(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame:
    """Windows cached for a fingerprint: chunk_id, window_no, embedding."""
    return spark.read.parquet(f"{folder}/{fingerprint}")


def write_vectors(windows: DataFrame, folder: str, fingerprint: str) -> None:
    """Raw vectors; an existing cache is never overwritten."""
    windows.write.mode("errorifexists").parquet(f"{folder}/{fingerprint}")


def write_json(rows: DataFrame, path: str) -> None:
    """Answers or reports, one JSON object a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
