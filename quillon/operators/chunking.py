"""Sections and chunks of ordered blocks (document_id, page, ord, kind, flow, text, and bbox and table where
they come from pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators.layout import BBOX, TABLE


def blocks_of(documents: DataFrame, page_lines: int = 40) -> DataFrame:
    """Blank lines go; the others are blocks of pages of page_lines lines. A document's lines stay
    one row until they are exploded, so nothing is shuffled."""
    rows = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    rows = rows.where(F.trim(T.collapse(F.col("text"))) != "").withColumn("page", (F.floor(F.col("ord") / page_lines) + 1).cast("int"))
    return rows.withColumn("kind", F.when(T.is_heading(F.col("text")), "heading").otherwise("text")).withColumn("flow", F.lit("single"))


def sections(blocks: DataFrame) -> DataFrame:
    """Adds section: the last heading so far, across pages; a heading belongs to its own."""
    w = Window.partitionBy("document_id").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w), F.lit("Front matter")))


def expand_tables(blocks: DataFrame, max_chars: int = 1400) -> DataFrame:
    """Blocks with part (null, or the number of a part), boxes and id: a table whose text is too long becomes
    several blocks, cut between rows, whose boxes are only those of the cells that they keep."""
    b = blocks
    for name, kind in (("bbox", BBOX), ("table", TABLE)):
        if name not in b.columns:
            b = b.withColumn(name, F.lit(None).cast(kind))
    b = b.withColumn("id", F.concat(F.col("document_id").cast("string"), F.lit(":p"), F.col("page"), F.lit(":b"), F.col("ord")))
    own = F.when(F.col("bbox").isNotNull(), F.array("bbox")).otherwise(F.expr(f"cast(array() as array<{BBOX}>)"))
    long = (F.col("kind") == "table") & F.col("table").isNotNull() & (F.length("text") > max_chars)
    rest = b.where(~F.coalesce(long, F.lit(False))).select("*", F.lit(None).cast("int").alias("part"), own.alias("boxes"))
    if "table" not in blocks.columns:
        return rest
    cut = b.where(long)
    parts = table_parts(cut.select("id", "text", F.col("table.caption").alias("caption"), F.col("table.rows").alias("rows")), max_chars).where("part is not null")
    parts = parts.select(F.col("id").alias("_id"), "part", F.col("rows").alias("_rows"), F.col("text").alias("_text"))
    each = cut.join(parts, F.col("id") == F.col("_id"))
    table = F.struct(F.col("_rows").alias("rows"), F.col("table.extraction").alias("extraction"), F.col("table.caption").alias("caption")).cast(TABLE)
    cols = {"text": F.col("_text"), "table": table, "id": F.concat("id", F.lit(":rows"), F.col("part"))}
    return rest.unionByName(each.select(*(cols.get(c, F.col(c)).alias(c) for c in b.columns), "part", boxes_of(F.col("_rows")).alias("boxes")))


def pack(blocks: DataFrame, max_chars: int = 1400) -> DataFrame:
    """Greedy packing of blocks of equal (page, section, kind, flow) into chunks of up to max_chars:
    document_id, chunk_no, id, page, section, kind, text, block_ids, boxes, table. Headings end a chunk and are
    left out; a table, or a part of one, is a chunk of its own and keeps its cells.

    Chunks never cross a heading or a change of key, so each run between those is folded by itself."""
    if max_chars < 100:
        raise ValueError("max_chars must be at least 100")
    order = Window.partitionBy("document_id").orderBy("page", "ord", "part")
    key = F.struct("page", "section", "kind", "flow")
    rows = expand_tables(blocks, max_chars)
    rows = rows.withColumn("new", F.coalesce((key != F.lag(key).over(order)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind <> 'heading'")
    item = F.struct("page", "ord", "part", "section", "kind", "text", "id", "boxes", "table")
    runs = rows.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["ord"] != b["ord"], a["ord"] - b["ord"]).otherwise(F.coalesce(a["part"] - b["part"], F.lit(0)))).alias("items"))
    start = F.struct(F.lit(0).alias("no"), F.lit(0).alias("held"), F.expr("cast(array() as array<int>)").alias("nos"))

    def step(acc, b):
        n = F.length(b["text"])
        fresh = (acc["held"] == 0) | (acc["held"] + n > max_chars)
        alone = (n >= max_chars) | (b["kind"] == "table")
        no = acc["no"] + fresh.cast("int")
        held = F.when(alone, 0).otherwise(F.when(fresh, 0).otherwise(acc["held"]) + n + 1)
        return F.struct(no.alias("no"), held.cast("int").alias("held"), F.concat(acc["nos"], F.array(no)).alias("nos"))

    numbered = runs.select("document_id", "run", F.explode(F.arrays_zip(F.aggregate("items", start, step)["nos"].alias("no"), F.col("items").alias("b"))).alias("x"))
    bs = F.array_sort(F.collect_list("x.b"), lambda a, b: F.when(a["ord"] != b["ord"], a["ord"] - b["ord"]).otherwise(F.coalesce(a["part"] - b["part"], F.lit(0))))
    chunks = numbered.groupBy("document_id", "run", F.col("x.no").alias("no")).agg(bs.alias("bs"))
    first, text, ids = F.element_at("bs", 1), F.concat_ws("\n", F.col("bs.text")), F.col("bs.id")
    chunk_no = F.row_number().over(Window.partitionBy("document_id").orderBy("run", "no"))
    id_ = F.substring(F.sha2(F.concat(F.concat_ws("|", ids), F.lit("|"), text), 256), 1, 16)
    return chunks.select("document_id", chunk_no.alias("chunk_no"), id_.alias("id"), first["page"].alias("page"), first["section"].alias("section"), first["kind"].alias("kind"), text.alias("text"), ids.alias("block_ids"), F.flatten("bs.boxes").alias("boxes"), F.when(F.size("bs") == 1, first["table"]).alias("table"))


def fixed_windows(blocks: DataFrame, size: int = 1400) -> DataFrame:
    """Baseline: per page, the text of its blocks (each with a newline) cut every size characters:
    document_id, page, start, text, id, block_ids of the blocks that a window overlaps."""
    item = F.struct("ord", "text", F.concat(F.col("document_id").cast("string"), F.lit(":p"), F.col("page"), F.lit(":b"), F.col("ord")).alias("id"))
    rows = blocks.where("kind <> 'heading'").groupBy("document_id", "page").agg(F.array_sort(F.collect_list(item)).alias("bs"))
    places = F.transform("bs", lambda b, i: F.struct(b["id"].alias("id"), F.aggregate(F.slice("bs", 1, i), F.lit(0), lambda n, x: n + F.length(x["text"]) + 1).alias("a"), (F.length(b["text"]) + 1).alias("n")))
    rows = rows.select("document_id", "page", F.concat(F.array_join(F.col("bs.text"), "\n"), F.lit("\n")).alias("all"), places.alias("places"))
    rows = rows.select("document_id", "page", "all", "places", F.explode(F.sequence(F.lit(0), F.length("all") - 1, F.lit(size))).alias("start"))
    text = F.substring("all", F.col("start") + 1, F.lit(size))
    met = F.transform(F.filter("places", lambda p: (p["a"] + p["n"] > F.col("start")) & (p["a"] < F.col("start") + size)), lambda p: p["id"])
    id_ = F.substring(F.sha2(F.concat(F.lit("fixed:"), F.col("page"), F.lit(":"), F.col("start"), F.lit(":"), text), 256), 1, 16)
    return rows.select("document_id", "page", F.col("start").cast("long").alias("start"), text.alias("text"), id_.alias("id"), met.alias("block_ids"))


def table_parts(tables: DataFrame, max_chars: int = 1400) -> DataFrame:
    """tables (id, text, caption, rows) -> id, part, rows, text. A table whose text is too long is cut
    between rows: each part repeats the header (and the caption), and the last spanning row (a label
    without a box, all else empty) if it lies before the part. A row that is too long stays whole.
    Others come back as they are, with a null part. Lines are measured at the whole table's width."""
    width = F.array_max(F.transform("rows", lambda r: F.size(r)))
    size = lambda c: F.length(F.replace(F.coalesce(c["text"], F.lit("")), F.lit("|"), F.lit("\\|")))
    blank = lambda c: F.coalesce(c["text"], F.lit("")) == ""
    line = lambda r: F.aggregate(r, F.lit(0), lambda a, c: a + size(c)) + 3 * width + 1
    spanning = lambda r: ~blank(r[0]) & r[0]["bbox"].isNull() & F.forall(F.slice(r, 2, F.size(r)), blank)
    caption = F.coalesce("caption", F.lit(""))
    top = line(F.col("rows")[0]) + 6 * width + 2 + F.when(caption != "", F.length(caption) + 1).otherwise(0)
    long = tables.where(F.length("text") > max_chars).withColumn("lines", F.transform("rows", lambda r, i: F.struct(i.alias("i"), line(r).alias("n"), spanning(r).alias("span")))).withColumn("top", top)
    start = F.expr("named_struct('part', -1, 'held', 0, 'lead', 0, 'group', 0, 'n', 0, 'out', cast(array() as array<struct<part:int,lead:int,i:int>>))")

    def step(acc, x):
        group, n = F.when(x["span"], x["i"]).otherwise(acc["group"]), F.when(x["span"], x["n"]).otherwise(acc["n"])
        fresh = (acc["part"] < 0) | (acc["held"] + 1 + x["n"] > max_chars)
        carried = F.when((group > 0) & (group != x["i"]), group).otherwise(0)
        lead, part = F.when(fresh, carried).otherwise(acc["lead"]), acc["part"] + fresh.cast("int")
        held = F.when(fresh, F.col("top") + F.when(carried > 0, n + 1).otherwise(0)).otherwise(acc["held"]) + 1 + x["n"]
        item = F.struct(part.alias("part"), lead.alias("lead"), x["i"].alias("i"))
        return F.struct(part.alias("part"), held.cast("int").alias("held"), lead.alias("lead"), group.alias("group"), n.alias("n"), F.concat(acc["out"], F.array(item)).alias("out"))

    cut = long.withColumn("cut", F.aggregate(F.slice("lines", 2, F.size("lines")), start, step)["out"])
    each = cut.select("id", "caption", "rows", F.explode("cut").alias("c")).groupBy("id", F.col("c.part").alias("part")).agg(
        F.any_value("caption").alias("caption"), F.any_value(F.col("rows")[0]).alias("head"), F.any_value(F.when(F.col("c.lead") > 0, F.get("rows", F.col("c.lead")))).alias("lead"),
        F.transform(F.array_sort(F.collect_list(F.struct("c.i", F.get("rows", F.col("c.i")).alias("row")))), lambda x: x["row"]).alias("body"),
    )
    rows = F.concat(F.array("head"), F.when(F.col("lead").isNotNull(), F.array("lead")).otherwise(F.slice(F.array("head"), 1, 0)), F.col("body"))
    each = each.select("id", "part", "caption", rows.alias("rows"))
    text = F.concat(T.markdown(F.transform("rows", lambda r: F.transform(r, lambda c: c["text"]))), F.when(caption != "", F.concat(F.lit("\n"), caption)).otherwise(""))
    return each.select("id", "part", "rows", text.alias("text")).unionByName(tables.where(F.length("text") <= max_chars).select("id", F.lit(None).cast("int").alias("part"), "rows", "text"))


def boxes_of(rows):
    """Boxes of the cells that have one."""
    return F.filter(F.transform(F.flatten(rows), lambda c: c["bbox"]), lambda b: b.isNotNull())


def token_windows(texts: DataFrame, budget: int = 448, overlap: int = 64) -> DataFrame:
    """texts (chunk_id, tokens) -> chunk_id, window_no, tokens: windows of budget tokens that overlap;
    the last ends with the text, and a text without tokens is one empty window."""
    if not 0 <= overlap < budget:
        raise ValueError("overlap must be less than the budget")
    n = F.size("tokens")
    last = F.greatest(F.ceil((n - overlap) / (budget - overlap)) - 1, F.lit(0)).cast("int")
    rows = texts.select("chunk_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return rows.select("chunk_id", "window_no", F.slice("tokens", F.col("window_no") * (budget - overlap) + 1, F.lit(budget)).alias("tokens"))
