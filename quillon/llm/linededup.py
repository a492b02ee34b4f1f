"""Removal of boilerplate lines that many distinct sites share.

A line's key is a 64-bit hash of its whole text. HyperLogLog sketches of the sites merge by
aggregation per key (partial sketches before the shuffle, so a line in a third of all rows is no
hot key). Keys whose estimate is far above the threshold are boilerplate, far below are not, and
those in between (BAND each way) are decided by exact distinct counts. Every copy of a boilerplate
line goes, but for its first: the one in the document with the least doc_id, so that a page copied
to many sites keeps one whole copy. Lines of fewer than MIN_WORDS words are left alone.

Nulls: a null text stays null, and has no lines; a null site counts as one site of its own. A
null doc_id sorts last, so such rows keep a line only if all rows with it are null. Empty lines
stay. Rows with the same doc_id are handled alike. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Table, free, read

SITES, MIN_WORDS, LG_K, BAND = 10, 3, 9, 0.35
WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame, site: str) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"), F.explode(F.split("text", "\n", -1)).alias("line"))
    several = F.col("line").rlike(rf"^[\x20\x09-\x0D]*(?:{WORD}[\x20\x09-\x0D]+){{{MIN_WORDS - 1}}}[^\x20\x09-\x0D]")
    return rows.where(several).select("doc_id", "site", F.xxhash64("line").alias("key"))


def spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """Keys of boilerplate lines: (key, first), first the least doc_id with it."""
    lines = _lines(docs, site)
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # one site, or fewer rows than sites asked for, needs no estimate
    sketched = sketched.where(f"lo <> hi and n >= {sites}").select("key", "first", F.hll_sketch_estimate("sketch").alias("about")).where(f"about >= {sites * (1 - BAND)}")
    keys = Table(sketched, "spread")
    near = keys.df.where(f"about <= {sites * (1 + BAND)}").select("key")
    exact = lines.join(near, "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("sites")).where(f"sites >= {sites}").select("key")
    sure = keys.df.where(f"about > {sites * (1 + BAND)}")
    return sure.select("key", "first").unionByName(keys.df.join(exact, "key").select("key", "first"))


def dedup_lines(docs: DataFrame, site: str = "source", sites: int = SITES, count: str = "_n_removed") -> DataFrame:
    """docs (doc_id, text, site, ...) -> docs with the lines taken out of text, and their number (count)."""
    own, gone = free(docs, "_id"), free(docs, "_keys")
    spread = Table(spread_lines(docs, site, sites), "boilerplate").df
    hits = _lines(docs, site).join(spread, "key").where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "key").distinct()
    out = hits.groupBy("doc_id").agg(F.collect_list("key").alias(gone)).withColumnRenamed("doc_id", own)
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), F.xxhash64(x)))
    joined = docs.join(out, F.col("doc_id").eqNullSafe(F.col(own)), "left")
    return joined.select(
        *(F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(count),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; documents of which no word is left go. n_chars follows."""
    count = free(docs, "_n_removed")
    out = dedup_lines(docs, count=count).where(f"{count} = 0 or text rlike '{WORD}'".replace("\\", "\\\\"))
    chars = F.when(F.col(count) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, n_lines_kept, and the SHA-256 of the text that is left."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("_n_removed").alias("n_removed"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
  SELECT line, min(doc_id) AS first FROM l WHERE len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) >= {MIN_WORDS}
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= {SITES}
), m AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND l.doc_id <> b.first AS gone FROM l LEFT JOIN b USING (line)
), k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (NOT gone) AS n, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN 0 ELSE greatest(n, 1) END::BIGINT AS n_lines, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
