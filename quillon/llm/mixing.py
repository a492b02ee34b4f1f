"""Mixing sources to target weights with hash-threshold histograms, without sorting rows.

A source's target is its share of BUDGET times all words, at most CAP times its own words (the
excess goes to the others by weight). Every document of a source is taken floor(target / size)
times. For the rest of the target, words are summed by source and by the first 12 bits of a hash of
doc_id; cumulative sums find the bucket in which the budget ends, and only rows in such boundary
buckets are summed by the next 12 bits, until each holds a single hash. Documents below it are
taken once more, and those at it if that brings the source nearer to its target. Thresholds are
nested: a larger budget takes a superset.

Nulls: a null text has size 0; a null source is a source, last in order; a null doc_id is hashed
as the empty text. Rows with equal doc_id have equal hashes and are taken together. Empty sources
have target 0; an empty table gives no rows. Nothing depends on the number or order of partitions,
so reruns agree. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Table, free, read

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 12


def hashed(docs: DataFrame) -> DataFrame:
    """Adds _source, _size (words) and _hash (60 bits) to documents."""
    key = F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumns({
        "_source": F.col("source"),
        "_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_hash": F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long"),
    })


def targets(sizes: DataFrame) -> DataFrame:
    """(_source, source_size) -> with target. One row per source goes through one task; the level
    is where capping the sources of the lowest cap per weight leaves a share that no other exceeds."""
    everything, before = Window.partitionBy(), Window.orderBy("ratio", "ord").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.col("ord") % len(WEIGHTS) + 1).cast("int"))
    x = sizes.withColumn("ord", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    x = x.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(CAP)).withColumn("ratio", F.expr("cap / weight"))
    x = x.withColumn("budget", F.sum("source_size").over(everything) * F.lit(BUDGET))
    x = x.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("level", F.expr("(budget - capped) / open"))
    x = x.withColumn("level", F.max(F.expr("CASE WHEN level <= ratio THEN level END")).over(everything))
    return x.select("_source", "source_size", F.expr("least(cap, coalesce(level * weight, cap))").alias("target"))


def thresholds(rows: DataFrame) -> DataFrame:
    """rows (_source, _size, _hash) -> one row per source: source_size, target, times (taken at
    least so often), _edge (boundary hash, null: none) and _at_edge (whether that is taken too)."""
    plan = Table(targets(rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))), "targets").df
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.expr("target / source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.expr("target - times * source_size"))
    state = plan.select(F.col("_source").alias("s"), "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"), F.lit(HASH_BITS).alias("shift"))
    shift = HASH_BITS
    while True:
        here = rows.join(state, F.col("_source").eqNullSafe(F.col("s")) & (F.shiftright("_hash", shift) == F.col("prefix")))
        shift -= STEP_BITS
        bins = here.groupBy("s", "rest", "before", F.shiftright("_hash", shift).alias("bin")).agg(F.sum("_size").alias("words"), F.min("_hash").alias("lo"), F.max("_hash").alias("hi"))
        bins = bins.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("bin")))
        edge = bins.where("upto > rest").groupBy("s").agg(F.min_by(F.struct("rest", (F.col("upto") - F.col("words")).alias("before"), F.col("bin").alias("prefix"), "words", "lo", "hi"), "bin").alias("e")).select("s", "e.*")
        state = Table(edge, "edge").df
        if shift == 0 or state.where("lo <> hi").isEmpty():
            break
    edge = state.select("s", F.col("lo").alias("_edge"), F.expr("before + words - rest < rest - before").alias("_at_edge"))
    return plan.join(edge, F.col("_source").eqNullSafe(F.col("s")), "left").select("_source", "source_size", "target", "times", "_edge", "_at_edge")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("_source", "_plan_source")
    more = F.coalesce((F.col("_hash") < F.col("_edge")) | ((F.col("_hash") == F.col("_edge")) & F.col("_at_edge")), F.lit(False))
    return rows.join(plan, F.col("_source").eqNullSafe(F.col("_plan_source"))).withColumn("_copies", F.col("times") + more.cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text, ...) -> doc_id, size, source_size, target, taken, a row per row."""
    rows = Table(hashed(docs.select("doc_id", "source", "text")).select("doc_id", "_source", "_size", "_hash"), "mix").df
    out = _taken(rows, Table(thresholds(rows), "plan").df)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.expr("_copies * _size").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with copies: how often (copies_ where documents have that name)."""
    rows = hashed(docs.select("doc_id", "source", "text", F.struct("*").alias("_row")))
    thin = Table(rows.select("_source", "_size", "_hash"), "mix").df
    out = _taken(rows, Table(thresholds(thin), "plan").df)
    return out.where("_copies > 0").select("_row.*", F.col("_copies").alias(free(docs, "copies")))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(ord % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t
), c AS (
  SELECT doc_id, size, source_size, target, times, target - times * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  (size * (times + CASE WHEN upto <= rest OR (upto - same <= rest AND upto - rest < rest - (upto - same)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
