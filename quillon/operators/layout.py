"""Geometry of pages: glyphs, lines, words, tables between rules, columns and reading order.

Tables of glyphs (document_id, page, glyph_id, text, x0, top, x1, bottom), edges and boxes are keyed by
document and page; every join and window has both, so that pages of all documents are independent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.operators._cut import cut
from quillon.operators.tables import LETTER

PAGE = ("document_id", "page")
BBOX = "struct<x0:double,top:double,x1:double,bottom:double>"
TABLE = f"struct<rows:array<array<struct<text:string,bbox:{BBOX}>>>,extraction:string,caption:string>"
# Fixed value: how a table's caption begins.
CAPTION = r"(?i)^(?:Table|表)\s*\p{Nd}+"
SIDES = ("x0", "top", "x1", "bottom")


def box_of(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def box(row: str = "") -> Column:
    """The struct of a row's four sides."""
    return F.struct(*(F.col(f"{row}{s}").cast("double").alias(s) for s in SIDES))


def overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller area (1 at least)."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    tall = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    area = lambda x: (x["x1"] - x["x0"]) * (x["bottom"] - x["top"])
    return wide * tall / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def contains_center(box: Column, target: Column, margin: float = 1.0) -> Column:
    """Whether the target's centre lies in the box, give or take the margin."""
    x, y = (target["x0"] + target["x1"]) / 2, (target["top"] + target["bottom"]) / 2
    return x.between(box["x0"] - margin, box["x1"] + margin) & y.between(box["top"] - margin, box["bottom"] + margin)


def merge_intervals(rows: DataFrame, *keys: str) -> DataFrame:
    """Unions of (left, right) that touch or overlap, per keys."""
    w = Window.partitionBy(*keys).orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col("left") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*keys, "island").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("island")


def lines_of(glyphs: DataFrame, *keys: str, tolerance: float = 3.0) -> DataFrame:
    """Adds line, from 1 on: a glyph whose top is more than the tolerance below the one before starts one.
    A glyph that stands there twice counts once."""
    once = glyphs.dropDuplicates([*keys, "glyph_id"])
    w = Window.partitionBy(*keys).orderBy("top", "glyph_id")
    rows = once.withColumn("new", F.coalesce((F.col("top") - F.lag("top").over(w) > tolerance).cast("int"), F.lit(1)))
    return rows.withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("new")


def words_of(glyphs: DataFrame, *keys: str, tolerance: float = 1.0) -> DataFrame:
    """Glyphs of lines to words: a gap above the tolerance or a blank glyph starts one. A glyph that stands
    for several letters is one glyph. keys (document, page and line unless given), word, text, the
    word's box and the ids of its glyphs."""
    keys = keys or (*PAGE, "line")
    w = Window.partitionBy(*keys).orderBy("x0", "glyph_id")
    blank = F.trim("text") == ""
    gap = F.col("x0") - F.lag("x1").over(w) > tolerance
    rows = glyphs.dropDuplicates([*keys, "glyph_id"]).withColumn("blank", blank)
    rows = rows.withColumn("new", F.coalesce((gap | F.lag("blank").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("word", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).where("not blank")
    letters = F.array_sort(F.collect_list(F.struct("x0", "glyph_id", "text")))
    words = rows.groupBy(*keys, "word").agg(letters.alias("g"), *(f(s).alias(s) for f, s in ((F.min, "x0"), (F.min, "top"), (F.max, "x1"), (F.max, "bottom"))))
    return words.select(*keys, "word", F.array_join(F.transform("g", lambda x: x["text"]), "").alias("text"), *SIDES, F.transform("g", lambda x: x["glyph_id"]).alias("glyphs"))


def line_texts(words: DataFrame, *keys: str) -> DataFrame:
    """keys, text (words in order, a space between) and box of lines of words."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "text"))), lambda x: x["text"])
    return words.groupBy(*keys).agg(F.array_join(parts, " ").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def _inside(glyphs: DataFrame, boxes: DataFrame, *keys: str) -> DataFrame:
    """Glyphs of their page's boxes (document_id, page, *keys, box), with the keys; by centres."""
    b = boxes.select(*PAGE, *keys, F.col("box").alias("_box"))
    return glyphs.join(b, list(PAGE)).where(contains_center(F.col("_box"), F.struct(*SIDES), 0.0)).drop("_box")


def _regions(edges: pd.DataFrame, page_lines: pd.DataFrame) -> pd.DataFrame:
    """Spans of at least three rules and 20 points of one page. Rules of about equal extent form a family, told
    by its first rule; captions in between part it."""
    families: list[list[tuple[float, float, float]]] = []
    for x0, x1, top in edges.sort_values(["top", "x0", "x1"])[["x0", "x1", "top"]].itertuples(index=False):
        own = [f for f in families if abs(f[0][0] - x0) <= 3 and abs(f[0][1] - x1) <= 3]
        if not own:
            families.append([(x0, x1, top)])
        elif top - own[0][-1][2] > 2:
            own[0].append((x0, x1, top))
    out = []
    for f in families:
        left, right = min(r[0] for r in f), max(r[1] for r in f)
        captions = page_lines[(page_lines["x1"] > left) & (page_lines["x0"] < right)]["top"].tolist()
        start = 0
        for i in range(1, len(f) + 1):
            parted = i == len(f) or (f[i][2] > f[i - 1][2] + 3 and any(f[i - 1][2] + 1 <= c <= f[i][2] - 1 for c in captions))
            if parted:
                if i - start >= 3 and f[i - 1][2] - f[start][2] >= 20:
                    out.append((left, f[start][2], right, f[i - 1][2]))
                start = i
    keys = edges.iloc[0] if len(edges) else {}
    return pd.DataFrame([(*(keys[k] for k in PAGE), n, {s: float(v) for s, v in zip(SIDES, r, strict=True)}) for n, r in enumerate(out)], columns=[*PAGE, "region", "box"])


def ruled_regions(edges: DataFrame, lines: DataFrame, width: float = 80.0) -> DataFrame:
    """edges (document_id, page, orientation, x0, top, x1, bottom; within their page), lines of text
    (document_id, page, text, x0, top, x1, bottom) -> document_id, page, region, box. Which family a rule
    belongs to depends on the rules above it, so a page's rules are folded in order, in one group."""
    rules = edges.where((F.col("orientation") == "h") & (F.col("x1") - F.col("x0") >= width)).select(*PAGE, "x0", "x1", "top")
    captions = lines.where(F.col("text").rlike(CAPTION)).select(*PAGE, "x0", "x1", "top")
    ids = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in PAGE)
    return rules.groupBy(*PAGE).cogroup(captions.groupBy(*PAGE)).applyInPandas(_regions, f"{ids}, region int, box {BBOX}").where("box is not null")


def captions(regions: DataFrame, glyphs: DataFrame, near: float = 22.0) -> DataFrame:
    """document_id, page, region, caption: the lines from a caption's start on, up to a gap of more than 7 or
    another start, that end or begin within so many points of the region; the nearest, and a strip as
    wide as the region before one 24 points wider on each side."""
    b, key = F.col("box"), [*PAGE, "region", "margin", "side"]
    strip = lambda m, side, top, bottom: F.struct(F.lit(m).alias("margin"), F.lit(side).alias("side"), F.struct((b["x0"] - m).alias("x0"), top.alias("top"), (b["x1"] + m).alias("x1"), bottom.alias("bottom")).alias("box"))
    strips = F.array(*(strip(m, *s) for m in (0.0, 24.0) for s in (("above", b["top"] - 80, b["top"]), ("below", b["bottom"], b["bottom"] + 65))))
    each = regions.select(*PAGE, "region", b.alias("of"), F.explode(strips).alias("s")).select(*PAGE, "region", "of", "s.*")
    lines = line_texts(words_of(lines_of(_inside(glyphs, each.drop("of"), "region", "margin", "side"), *key), *key, "line"), *key, "line")
    w = Window.partitionBy(*key).orderBy("line")
    lines = lines.withColumn("start", F.col("text").rlike(CAPTION)).withColumn("gap", F.col("top") - F.lag("bottom").over(w))
    whole = Window.partitionBy(*key)
    first, last = F.min(F.when(F.col("start"), F.col("line"))).over(whole), F.max(F.when(F.col("start"), F.col("line"))).over(whole)
    lines = lines.withColumn("begin", F.when(F.col("side") == "above", last).otherwise(first)).where("line >= begin")
    stop = F.sum(((F.col("line") > F.col("begin")) & (F.col("start") | (F.col("gap") > 7))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    found = lines.withColumn("stop", stop).where("stop = 0").groupBy(*key).agg(text.alias("text"), F.min_by("top", "line").alias("top"), F.max_by("bottom", "line").alias("bottom"))
    found = found.join(regions.select(*PAGE, "region", "box"), [*PAGE, "region"])
    distance = F.when(F.col("side") == "above", F.col("box.top") - F.col("bottom")).otherwise(F.col("top") - F.col("box.bottom"))
    found = found.withColumn("distance", distance).where(F.col("distance").between(0, near))
    return found.groupBy(*PAGE, "region").agg(F.min_by("text", F.struct("margin", "distance", "text")).alias("caption"))


def ruled_tables(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """document_id, page, region, box, table: regions with a caption, a header line with letters and two lines
    or more with two numbers or more, whose words leave one to eleven gaps of 4 points or more. Words go to
    columns by their centres; other lines become spanning rows without boxes. The header needs letters
    beyond the first column, and lines of numbers a lettered label and every cell."""
    key, line = [*PAGE, "region"], [*PAGE, "region", "line"]
    words = cut(words_of(lines_of(_inside(glyphs, regions, "region"), *key), *line).withColumn("digit", F.col("text").rlike(r"\p{Nd}")))
    lines = line_texts(words, *line).join(words.groupBy(*line).agg(F.count_if("digit").alias("digits")), line)
    lines = cut(lines.withColumn("kind", F.when(F.col("line") == 1, "header").when(F.col("digits") >= 2, "numbers").otherwise("span")))
    ok = lines.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "numbers").alias("numbers"), F.max(F.when(F.col("line") == 1, F.col("text").rlike(LETTER))).alias("head"))
    ok = ok.where("n >= 3 and numbers >= 2 and head").select(*key)
    kept = cut(words.join(lines.select(*line, "kind"), line).join(ok, key, "left_semi"))
    runs = merge_intervals(kept.where("kind = 'numbers'").select(*key, F.col("x0").alias("left"), F.col("x1").alias("right")), *key)
    gap = F.lead("left").over(Window.partitionBy(*key).orderBy("left"))
    gaps = runs.withColumn("next", gap).where(F.col("next") - F.col("right") >= 4).groupBy(*key).agg(F.sort_array(F.collect_list((F.col("right") + F.col("next")) / 2)).alias("gutters")).where(F.size("gutters").between(1, 11))
    cell = kept.join(gaps, key).withColumn("column", F.when(F.col("kind") == "span", 0).otherwise(column_of(F.col("gutters"), (F.col("x0") + F.col("x1")) / 2)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "text"))), lambda x: x["text"]), " ")
    cells = cell.groupBy(*line, "kind", "column").agg(text.alias("text"), F.struct(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")).alias("bbox"), F.any_value(F.size("gutters") + 1).alias("n"))
    item = F.struct(F.col("text"), F.when(F.col("kind") != "span", F.col("bbox")).alias("bbox"))
    rows = cells.groupBy(*line, "kind", "n").agg(F.map_from_entries(F.collect_list(F.struct("column", item))).alias("at"))
    empty = F.expr(f"named_struct('text', '', 'bbox', cast(null as {BBOX}))")
    rows = rows.withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("at", i), empty)))
    lettered, full = lambda c: c["text"].rlike(LETTER), lambda c: c["text"] != ""
    good = F.when(F.col("kind") == "header", F.forall(F.slice("cells", 2, F.col("n")), lettered)).when(F.col("kind") == "numbers", lettered(F.col("cells")[0]) & F.forall("cells", full)).otherwise(F.lit(True))
    tables = rows.withColumn("good", good).groupBy(*key).agg(F.bool_and("good").alias("good"), F.transform(F.array_sort(F.collect_list(F.struct("line", "cells"))), lambda x: x["cells"]).alias("rows")).where("good")
    out = cut(tables).join(captions(regions, glyphs), key).join(regions, key)
    return out.select(*key, "box", F.struct("rows", F.lit("horizontal-rules-word-gutters").alias("extraction"), "caption").alias("table"))


def not_overlapping(candidates: DataFrame, accepted: DataFrame, most: float = 0.5) -> DataFrame:
    """candidates (document_id, page, no, box, ...) without those that share more than most with an accepted
    box (document_id, page, box) of their page, or with a candidate before them that stays."""
    t = accepted.select(*PAGE, "box").toDF("_d", "_p", "_taken")
    free = candidates.join(t, (F.col("document_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & (overlap(F.col("box"), F.col("_taken")) > most), "left_anti")
    page = free.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("no", "box"))).alias("all"))
    kept = F.aggregate("all", F.slice(F.col("all"), 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x["box"], y["box"]) > most), acc).otherwise(F.concat(acc, F.array(x))))
    return free.join(page.select(*PAGE, F.explode(kept).alias("k")).select(*PAGE, F.col("k.no").alias("no")), [*PAGE, "no"], "left_semi")


def column_of(gutters: Column, center: Column) -> Column:
    """Number of the column that a centre lies in; a gutter at the centre counts as passed."""
    return F.size(F.filter(gutters, lambda g: g <= center))


def outside(glyphs: DataFrame, boxes: DataFrame, margin: float = 0.5) -> DataFrame:
    """Glyphs whose centre lies in none of the boxes (document_id, page, box) of their page."""
    b = boxes.select(*PAGE, "box").toDF("_d", "_p", "_b")
    return glyphs.join(b, (F.col("document_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & contains_center(F.col("_b"), F.struct(*SIDES), margin), "left_anti")


def accepted_grids(grids: DataFrame) -> DataFrame:
    """Grids (rows: arrays of cells) of two rows and columns at least, of which 65 % of cells hold text."""
    cells = F.flatten("rows")
    filled = F.size(F.filter(cells, lambda c: F.coalesce(F.trim(c["text"]), F.lit("")) != ""))
    return grids.where((F.size("rows") >= 2) & (F.array_max(F.transform("rows", lambda r: F.size(r))) >= 2) & (filled / F.size(cells) >= 0.65))


def gutters(words: DataFrame, width: float) -> DataFrame:
    """words (document_id, page, line, x0, x1) -> document_id, page, gutter: the middle of the longest run of
    x positions that the most central gaps leave empty, on pages where six lines and 35 % of eligible
    lines agree."""
    w = Window.partitionBy(*PAGE, "line")
    o = w.orderBy("x0")
    rows = words.select(*PAGE, "line", "x1", F.lead("x0").over(o).alias("next"), F.row_number().over(o).alias("i"), F.count("*").over(w).alias("n"), F.min("x0").over(w).alias("lo"), F.max("x1").over(w).alias("hi"))
    rows = rows.where((F.col("n") >= 8) & (F.col("lo") < width * 0.4) & (F.col("hi") > width * 0.6))
    eligible = rows.where("i = 1").groupBy(*PAGE).agg(F.count("*").alias("eligible"))
    gap, mid = F.col("next") - F.col("x1"), (F.col("next") + F.col("x1")) / 2
    gaps = rows.where((F.col("i") >= 3) & (F.col("n") - F.col("i") >= 3) & gap.between(8, width * 0.18) & mid.between(width * 0.4, width * 0.6))
    lo, hi = F.greatest(F.ceil(F.col("x1") + 1), F.lit(int(width * 0.4))), F.least(F.floor(F.col("next") - 1), F.lit(int(width * 0.6)))
    votes = gaps.where(lo <= hi).select(*PAGE, F.explode(F.sequence(lo, hi)).alias("x")).groupBy(*PAGE, "x").agg(F.count("*").alias("support"))
    best = votes.withColumn("most", F.max("support").over(Window.partitionBy(*PAGE))).where("support = most and most >= 6").join(eligible, list(PAGE)).where("eligible >= 6 and most / eligible >= 0.35")
    runs = best.withColumn("run", F.col("x") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("x"))).groupBy(*PAGE, "run").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return runs.groupBy(*PAGE).agg(F.min_by((F.col("a") + F.col("b")) / 2, F.struct(F.col("a") - F.col("b"), "a")).alias("gutter"))


def text_objects(words: DataFrame, gutters_: DataFrame) -> DataFrame:
    """words of lines -> document_id, page, line, part, text, box: a line that crosses its page's gutter is cut
    there if no word does, both sides have words and lie 8 points apart or more."""
    w = Window.partitionBy(*PAGE, "line")
    g = F.col("gutter")
    rows = words.join(gutters_, list(PAGE), "left")
    rows = rows.withColumn("a", F.max(F.when(F.col("x1") <= g, F.col("x1"))).over(w)).withColumn("b", F.min(F.when(F.col("x0") >= g, F.col("x0"))).over(w)).withColumn("across", F.max((F.col("x0") < g) & (F.col("x1") > g)).over(w))
    cut = (~F.col("across")) & (F.col("b") - F.col("a") >= 8)
    rows = rows.withColumn("part", F.when(F.coalesce(cut, F.lit(False)) & (F.col("x0") >= g), 2).otherwise(1))
    return line_texts(rows, *PAGE, "line", "part").where("text <> ''").select(*PAGE, "line", "part", "text", box().alias("box"))


def reading_order(objects: DataFrame, gutters_: DataFrame) -> DataFrame:
    """objects (document_id, page, object_id, box, ...) with position (from 1) and flow. Without a gutter
    (document_id, page, gutter) by top and left, flow single. With one, objects across it part the page
    into bands; in a band left comes before right, each by top, then the object that ends it."""
    b, g = F.col("box"), F.col("gutter")
    rows = objects.join(gutters_, list(PAGE), "left")
    side = F.when(g.isNull(), "single").when((b["x0"] < g) & (b["x1"] > g), "wide").when((b["x0"] + b["x1"]) / 2 < g, "left").otherwise("right")
    rows = rows.withColumn("side", side)
    wide = Window.partitionBy(*PAGE, "side").orderBy(b["top"], "object_id")
    rows = rows.withColumn("nth", F.row_number().over(wide))
    page = Window.partitionBy(*PAGE)
    tops = F.array_sort(F.collect_list(F.when(F.col("side") == "wide", b["top"])).over(page))
    passed = F.size(F.filter("tops", lambda t: t <= (b["top"] + b["bottom"]) / 2))
    rows = rows.withColumn("tops", tops).withColumn("band", F.when(F.col("side") == "wide", F.col("nth") - 1).when(F.col("side") == "single", 0).otherwise(passed))
    order = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    by = page.orderBy("band", order, b["top"], F.when(F.col("side") == "single", b["x0"]), "object_id")
    flow = F.when(F.col("side") == "single", "single").otherwise(F.concat(F.lit("band"), F.col("band"), F.lit("-"), F.col("side")))
    return rows.withColumn("position", F.row_number().over(by)).withColumn("flow", flow).drop("gutter", "side", "nth", "tops", "band")


def warnings(pages: DataFrame, glyphs: DataFrame, images: DataFrame, refused: DataFrame) -> DataFrame:
    """document_id, page, warning: pages (document_id, page) without text or with images, grids that were
    refused (document_id, page), and what holds for every document (page null)."""
    said = lambda rows, text: rows.select("document_id", F.col("page").cast("int").alias("page"), text.alias("warning"))
    out = said(pages.join(glyphs.select(*PAGE).distinct(), list(PAGE), "left_anti"), F.lit("no text layer; the page needs character recognition and is not searched"))
    counted = images.groupBy(*PAGE).count()
    out = out.unionByName(said(counted, F.concat(F.col("count"), F.lit(" images, whose content is not searched"))))
    out = out.unionByName(said(refused, F.lit("a sparse or incomplete grid is left as text")))
    every = pages.select("document_id").distinct().withColumn("page", F.lit(None).cast("int"))
    return out.unionByName(said(every, F.lit("reading order and ruled tables are recovered from coordinates; headers of several lines, tables without rules and formulas need a look at the source")))


def page_blocks(glyphs: DataFrame, edges: DataFrame, grids: DataFrame, width: float = 612.0) -> DataFrame:
    """Blocks of pages in reading order: document_id, page, ord, kind, flow, text, bbox, table. Tables between
    rules come first, then grids (document_id, page, no, box, rows) that are full enough and free; what
    lies in neither is text, cut at the page's gutter."""
    lined = line_texts(words_of(lines_of(glyphs, *PAGE)), *PAGE, "line")
    ruled = cut(ruled_tables(cut(ruled_regions(edges, lined)), glyphs))
    free = not_overlapping(accepted_grids(grids), ruled)
    text = lambda t: F.concat(T.markdown(F.transform(t["rows"], lambda r: F.transform(r, lambda c: c["text"]))), F.when(t["caption"] != "", F.concat(F.lit("\n"), t["caption"])).otherwise(""))
    grid = free.select(*PAGE, "box", F.struct("rows", F.lit("grid").alias("extraction"), F.lit("").alias("caption")).cast(TABLE).alias("table"))
    tables = ruled.select(*PAGE, "box", F.col("table").cast(TABLE).alias("table")).unionByName(grid).withColumn("text", text(F.col("table"))).where("trim(text) <> ''")
    tables = cut(tables)
    words = cut(words_of(lines_of(outside(glyphs, tables), *PAGE)))
    gutter = cut(gutters(words, width))
    lines = text_objects(words, gutter).select(*PAGE, "box", F.lit(None).cast(TABLE).alias("table"), "text")
    objects = lines.unionByName(tables.select(*PAGE, "box", "table", "text"))
    objects = objects.withColumn("object_id", F.struct(F.col("box.top"), F.col("box.x0"), "text"))
    kind = F.when(F.col("table").isNotNull(), "table").when(T.is_heading(F.col("text")), "heading").otherwise("text")
    return reading_order(objects, gutter).select(*PAGE, (F.col("position") - 1).alias("ord"), kind.alias("kind"), "flow", "text", F.col("box").alias("bbox"), "table")


def source_text(glyphs: DataFrame, gold: DataFrame) -> DataFrame:
    """gold (gold_id, document_id, page, bbox, quote) -> gold_id, valid: whether the quote stands, white space
    aside, in the glyphs inside its box."""
    inside = _inside(glyphs, gold.select(*PAGE, "gold_id", F.col("bbox").alias("box")), "gold_id")
    lines = line_texts(words_of(lines_of(inside, *PAGE, "gold_id"), *PAGE, "gold_id", "line"), *PAGE, "gold_id", "line")
    texts = lines.groupBy("gold_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return gold.join(texts, "gold_id", "left").select("gold_id", F.contains(T.compact(T.nfkc(F.coalesce("text", F.lit("")))), T.compact(T.nfkc(F.col("quote")))).alias("valid"))
