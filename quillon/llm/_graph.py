"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Table


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> Table:
    """edges (u, v) of any order -> table (node, component), component the least node reachable. Nodes
    without a link to another node are absent. Each round is a table in the shared folder."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Table(edges, "edges")
    state = _state(now.df)
    while True:
        after = Table(_small(_large(now.df).where("u <> v").distinct()).distinct(), "edges")
        now.drop()
        now, before, state = after, state, _state(after.df)
        if state == before:
            stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out = Table(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "components")
            now.drop()
            return out
