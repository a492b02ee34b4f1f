"""A training-data pipeline over documents: toxic documents, boilerplate lines, near duplicates and
benchmark passages go, and what is left is mixed to target weights. Each stage takes all that the
one before it kept, written as Parquet and read again; all but the last return documents' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, linededup, minhash, mixing, toxicity
from quillon.llm._shared import Table, read

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
]

#: A learnt stage has no SQL; tests hold the operators against brute force, near duplicates and leaks as stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        table = Table(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = table.df, table
    return docs
