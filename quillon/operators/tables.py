"""Cells of tables: rows ARRAY<ARRAY<STRUCT<text, bbox>>>, the first row being the header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as a letter of a label.
LETTER = r"[A-Za-z\u3400-\u9fff]"


def cells(tables: DataFrame) -> DataFrame:
    """One row per data cell that can be bound: chunk_id, row, column, row_label, column_label, value,
    claim, box, boxes (of label, header, value and context), row_text. Label, header and value must be
    there, with a box and on one line; label and header need a letter. A label that several rows have
    gets the row's other lettered cells as context."""
    rows = tables.select("chunk_id", F.col("rows")[0].alias("header"), F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda r: F.trim(r[0]["text"])).alias("labels"), F.posexplode("rows").alias("row", "cells")).where("row >= 1")
    rows = rows.select("*", F.posexplode("cells").alias("column", "cell")).where("column >= 1")
    label, head = F.col("cells")[0], F.try_element_at("header", F.col("column") + 1)
    whole = lambda c: (F.trim(c["text"]) != "") & c["bbox"].isNotNull() & ~c["text"].contains("\n")
    ok = whole(label) & whole(head) & whole(F.col("cell")) & label["text"].rlike(LETTER) & head["text"].rlike(LETTER)
    same = F.size(F.filter("labels", lambda x: x == F.trim(label["text"]))) > 1
    pairs = F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.trim(F.try_element_at("header", i + 1)["text"]).alias("h"), c["text"].alias("t"), c["bbox"].alias("b")))
    context = F.filter(pairs, lambda p: (p["i"] >= 1) & (p["i"] != F.col("column")) & p["b"].isNotNull() & ~p["t"].contains("\n") & p["t"].rlike(LETTER) & (p["h"] != ""))
    shown = F.when(same, F.array_join(F.transform(context, lambda p: F.concat(p["h"], F.lit("="), F.trim(p["t"]))), "; ")).otherwise("")
    claim = F.concat(F.trim(label["text"]), F.when(shown != "", F.concat(F.lit(" / "), shown)).otherwise(""), F.lit(" · "), F.trim(head["text"]), F.lit("："), F.trim("cell.text"))
    return rows.where(ok).select("chunk_id", "row", "column", F.trim(label["text"]).alias("row_label"), F.trim(head["text"]).alias("column_label"), F.trim("cell.text").alias("value"), claim.alias("claim"), F.col("cell.bbox").alias("box"), F.concat(F.array(label["bbox"], head["bbox"], F.col("cell.bbox")), F.when(same, F.transform(context, lambda p: p["b"])).otherwise(F.slice(F.array(label["bbox"]), 1, 0))).alias("boxes"), F.array_join(F.transform("cells", lambda c: F.coalesce(c["text"], F.lit(""))), " ").alias("row_text"))


def cell_reference(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (chunk_id, row, column) with the bound cell, or no row where it cannot be bound."""
    return cells(tables).join(wanted, ["chunk_id", "row", "column"], "left_semi")
