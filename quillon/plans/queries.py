"""The engine's queries over the supplied tables, each with DuckDB SQL for the same rows.

Stand-ins: lines of documents are blocks and chunks, benchmark passages are questions, a passage that
a document holds whole is gold evidence, embeddings are windows of chunks of five.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators._cut import cut
from quillon.operators import answering, chunking, evaluation, layout, lexical, semantic, tables


def _read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _chunks(s, d) -> DataFrame:
    return _read(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).select((F.col("document_id") * 1000000 + F.col("ord")).alias("chunk_id"), "document_id", "text")


def _questions(s, d) -> DataFrame:
    return _read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
LINES = """chunks AS (SELECT doc_id * 1000000 + pos - 1 AS chunk_id, doc_id AS document_id, line AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))"""


def _terms(text: str) -> str:
    folded = f"replace(replace(lower(coalesce({text}, '')), 'ß', 'ss'), 'ſ', 's')"
    return rf"list_concat(list_filter(regexp_extract_all({folded}, '[a-z0-9]+(?:\.[0-9]+)?'), lambda t: NOT list_contains({STOP}, t)), flatten(list_transform(regexp_extract_all({folded}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"


TOKENS = f"{LINES}, tok AS (SELECT chunk_id, document_id, {_terms('text')} AS terms FROM chunks), tf AS (SELECT document_id, chunk_id, term, count(*) AS tf FROM (SELECT document_id, chunk_id, unnest(terms) AS term FROM tok) GROUP BY ALL), len AS (SELECT document_id, chunk_id, len(terms)::BIGINT AS length FROM tok)"
QT = f"q AS (SELECT DISTINCT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark)"


def _bm25(scope: str) -> str:
    by, eq = ("document_id, ", "USING (document_id, term)") if scope == "document" else ("", "USING (term)")
    size = "GROUP BY document_id" if scope == "document" else ""
    join = "JOIN size USING (document_id)" if scope == "document" else "CROSS JOIN size"
    part = "PARTITION BY query_id, document_id" if scope == "document" else "PARTITION BY query_id"
    return f"""{TOKENS}, {QT}, size AS (SELECT {by}count(*) AS n, coalesce(nullif(avg(length), 0), 1) AS average FROM len {size}),
    df AS (SELECT {by}term, count(*) AS df FROM tf GROUP BY {by}term),
    w AS (SELECT *, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df {join}),
    scored AS (SELECT query_id, tf.document_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) AS score
      FROM tf JOIN w {eq} JOIN len USING (document_id, chunk_id) JOIN q USING (term) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER ({part} ORDER BY round(score, 10) DESC, chunk_id) AS rank FROM scored)"""


HITS = f"WITH {_bm25('corpus')}, hits AS (SELECT * FROM ranked WHERE rank <= 5)"


def _hits(s, d) -> DataFrame:
    return lexical.bm25(_chunks(s, d), _questions(s, d))


def _kept(s, d) -> DataFrame:
    """The hits, for queries that read them and their chunks' texts more than once."""
    return lexical.keep(_hits(s, d))


def _gold(s, d) -> DataFrame:
    """Passages, of any length but blank, that a document's text holds whole, across lines too. Spark
    sends the questions to all documents, or pairs blocks of both where they are many."""
    b = _read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote")).where(T.collapse(F.col("text")) != "")
    c = _read(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return c.join(b, F.contains("text", "quote")).select("query_id", "document_id", "quote").distinct()


COLLAPSE = r"trim(regexp_replace({0}, '[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
_col = lambda x: COLLAPSE.replace("{0}", x)
GOLD = f"gold AS (SELECT DISTINCT item_id AS query_id, doc_id AS document_id, b.text AS quote FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE {_col('b.text')} <> '')"
RECALL = f"{HITS}, {GOLD}, each AS (SELECT g.query_id, g.document_id, g.quote, max(CASE WHEN h.chunk_id IS NULL THEN 0.0 ELSE 1.0 END) AS hit FROM gold g LEFT JOIN (SELECT hits.query_id, c.document_id, c.text FROM hits JOIN chunks c USING (chunk_id)) AS x ON x.query_id = g.query_id AND x.document_id = g.document_id AND contains({_col('x.text')}, {_col('g.quote')}) LEFT JOIN (SELECT 1 AS chunk_id) h ON x.query_id IS NOT NULL GROUP BY ALL), rec AS (SELECT query_id, avg(hit) AS recall, count(*) AS n_gold FROM each GROUP BY query_id)"


#: Numbers of a text in SQL without look-around: the text is cut into runs of digits and points (even places)
#: and what lies between. A run that is a number counts unless a letter is before it; a sign before it counts
#: unless it follows a letter, digit or point, a percent mark after it unless a digit or point follows.
NUMBERS = rf"""SELECT DISTINCT doc_id, number FROM (SELECT doc_id, unnest(list_transform(list_filter(range(2, len(seg) + 1, 2), lambda i: regexp_full_match(seg[i], '[0-9]+(?:\.[0-9]+)?') AND NOT regexp_matches(seg[i - 1], '[A-Za-z]$')),
  lambda i: CASE WHEN regexp_matches(seg[i - 1], '(^|[^A-Za-z])[+-]$') AND (length(seg[i - 1]) >= 2 OR i = 2) THEN right(seg[i - 1], 1) ELSE '' END || seg[i] || CASE WHEN starts_with(seg[i + 1], '%') AND (length(seg[i + 1]) >= 2 OR i + 1 = len(seg)) THEN '%' ELSE '' END)) AS number
  FROM (SELECT doc_id, string_split(regexp_replace({_col('text')}, '([0-9.]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS seg FROM documents))"""
WORDS = "w AS (SELECT vec_id // 5 AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT chunk_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM w), qv AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 20 = 0), qu AS (SELECT query_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS q FROM qv)"


def _windows(s, d) -> DataFrame:
    return _read(s, d, "embeddings").select(F.expr("vec_id div 5").alias("chunk_id"), "embedding")


def _vector_queries(s, d) -> DataFrame:
    return _read(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vector_partners(s, d) -> DataFrame:
    """Another query for each: those at the same place from the other end."""
    q = _vector_queries(s, d).select("query_id")
    return q.join(F.broadcast(q.agg(F.max("query_id").alias("last")))).select("query_id", (F.col("last") - F.col("query_id")).alias("partner"))


HEADING_SQL = T.HEADING.replace("(?i)", "")
BLOCKS = rf"""blocks AS (SELECT document_id, (pos // 40 + 1)::INT AS page, pos::INT AS ord, text, CASE WHEN regexp_matches(text, '{HEADING_SQL}', 'i') THEN 'heading' ELSE 'text' END AS kind
  FROM (SELECT document_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id AS document_id, flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 25 = 0 THEN ['3 Results', x] WHEN i = 1 AND doc_id % 2 = 0 THEN ['Abstract', x] ELSE [x] END)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE {_col('text')} <> ''),
sec AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Front matter') AS section FROM blocks)"""


def _sections(s, d) -> DataFrame:
    """Lines with headings put in before some by rule, since the supplied texts have none; every line stays."""
    put = lambda x, i: F.when(i % 25 == 24, F.array(F.lit("3 Results"), x)).when((i == 0) & (F.col("doc_id") % 2 == 0), F.array(F.lit("Abstract"), x)).otherwise(F.array(x))
    line = F.flatten(F.transform(F.split("text", "\n", -1), put))
    docs = _read(s, d, "documents").where("text is not null").select("doc_id", F.array_join(line, "\n").alias("text"))
    return chunking.sections(chunking.blocks_of(docs))


PACK = f"""WITH RECURSIVE {BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, ord) AS rn, document_id || ':p' || page || ':b' || ord AS id FROM sec),
r AS (SELECT document_id, rn, CASE WHEN kind = 'heading' THEN 0 ELSE 1 END AS no, CASE WHEN kind = 'heading' OR length(text) >= 1400 THEN 0 ELSE length(text) + 1 END AS held, page, section, kind = 'heading' AS head FROM n WHERE rn = 1
  UNION ALL SELECT n.document_id, n.rn, CASE WHEN n.kind = 'heading' THEN r.no WHEN r.held = 0 OR r.page <> n.page OR r.section <> n.section OR r.held + length(n.text) > 1400 THEN r.no + 1 ELSE r.no END,
    CASE WHEN n.kind = 'heading' OR length(n.text) >= 1400 THEN 0 WHEN r.held = 0 OR r.page <> n.page OR r.section <> n.section OR r.held + length(n.text) > 1400 THEN length(n.text) + 1 ELSE r.held + length(n.text) + 1 END, n.page, n.section, n.kind = 'heading'
  FROM r JOIN n ON n.document_id = r.document_id AND n.rn = r.rn + 1),
c AS (SELECT n.document_id, r.no AS chunk_no, min(n.page) AS page, min(n.section) AS section, string_agg(n.text, chr(10) ORDER BY n.rn) AS text, string_agg(n.id, '|' ORDER BY n.rn) AS ids FROM n JOIN r USING (document_id, rn) WHERE NOT r.head GROUP BY ALL)
SELECT document_id, chunk_no, page, section, text, substr(sha256(ids || '|' || text), 1, 16) AS id FROM c"""

CELLS = "t AS (SELECT p_brand || '/' || (p_partkey // 300) AS brand, list(struct_pack(t := p_type, n := p_name, s := p_size) ORDER BY p_partkey) AS items FROM part GROUP BY ALL)"


def _tables(s, d) -> DataFrame:
    """A table per brand and 300 part keys; every fifth part's size cell has no box."""
    box = F.expr("named_struct('x0', 0D, 'top', 0D, 'x1', 1D, 'bottom', 1D)")
    cell = lambda text, ok=True: F.struct(text.cast("string").alias("text"), F.when(F.lit(True) if ok is True else ok, box).alias("bbox"))
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "p_type", "p_name", "p_size")))
    t = _read(s, d, "part").groupBy(F.expr("concat(p_brand, '/', p_partkey div 300)").alias("brand")).agg(items.alias("items"))
    header = F.array(cell(F.lit("Type")), cell(F.lit("Name")), cell(F.lit("Size")))
    body = F.transform("items", lambda x: F.array(cell(x["p_type"]), cell(x["p_name"]), cell(x["p_size"], x["p_partkey"] % 5 != 0)))
    return t.select(F.col("brand").alias("chunk_id"), F.concat(F.array(header), body).alias("rows"))


def _intervals(s, d) -> DataFrame:
    return _read(s, d, "lineitem").selectExpr("l_suppkey AS supplier", "l_partkey AS left", "l_partkey + cast(l_quantity AS long) AS right")


BOXES = "(SELECT l_orderkey, l_linenumber, 0.0 + l_linenumber AS a0, l_quantity AS a1, 20.0 + l_linenumber + l_quantity AS a2, 90.0 AS a3, l_quantity / 2 AS b0, 20.0 AS b1, 30.0 + l_quantity AS b2, 40.0 + l_quantity AS b3 FROM lineitem)"


def _boxes(s, d) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    sides = lambda *v: F.struct(*(x.cast("double").alias(k) for x, k in zip(v, layout.SIDES, strict=True)))
    return _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", sides(F.lit(0.0) + n, q, F.lit(20.0) + n + q, F.lit(90.0)).alias("a"), sides(q / 2, F.lit(20.0), q + 30.0, q + 40.0).alias("b"))


def _glyphs(s, d) -> DataFrame:
    """A page per part: its name's letters on one line, its type's on the next, a little uneven."""
    part = _read(s, d, "part")
    letters = lambda no, c: part.select(F.col("p_partkey").alias("document_id"), F.lit(1).alias("page"), F.lit(no).alias("no"), F.posexplode(F.split(c, "")).alias("i", "text"))
    g = letters(0, "p_name").unionByName(letters(1, "p_type")).where("text <> ''")
    return g.select("document_id", "page", (F.col("no") * 100000 + F.col("i")).alias("glyph_id"), "text", (F.col("i") * 5.0).alias("x0"), (F.col("i") * 5.0 + 4.5).alias("x1"), (F.col("no") * 12.0 + F.col("i") % 2).alias("top"), (F.col("no") * 12.0 + F.col("i") % 2 + 9.0).alias("bottom"))


OBJECTS = "(SELECT p_partkey // 20 AS page, p_partkey AS object_id, CASE WHEN p_partkey % 7 = 0 THEN 50.0 WHEN p_size % 2 = 0 THEN 50.0 ELSE 310.0 END AS x0, CASE WHEN p_partkey % 7 = 0 THEN 550.0 WHEN p_size % 2 = 0 THEN 290.0 ELSE 550.0 END AS x1, p_size * 12.0 AS top FROM part)"


def _objects(s, d) -> DataFrame:
    """Twenty parts a page by their size: every seventh is as wide as the page, the others stand left or right."""
    wide, left, key = F.col("p_partkey") % 7 == 0, F.col("p_size") % 2 == 0, F.col("p_partkey")
    box = F.struct(F.when(wide | left, 50.0).otherwise(310.0).alias("x0"), (F.col("p_size") * 12.0).alias("top"), F.when(wide, 550.0).when(left, 290.0).otherwise(550.0).alias("x1"), (F.col("p_size") * 12.0 + 10.0).alias("bottom"))
    return _read(s, d, "part").select(F.lit(0).alias("document_id"), F.floor(key / 20).alias("page"), key.alias("object_id"), box.alias("box"))


def _gutter_words(s, d) -> DataFrame:
    """A page per supplier, of five to eight lines of nine words; the gap's width differs by page."""
    k = F.col("s_suppkey")
    lines = _read(s, d, "supplier").select(F.lit(0).alias("document_id"), k.alias("page"), F.explode(F.sequence(F.lit(1), (k % 4 + 5).cast("int"))).alias("line"))
    x = F.explode(F.array(*(F.lit(float(v)) for v in (50, 100, 150, 200, 250)), *(F.lit(float(v)) + F.col("page") % 20 for v in (310, 360, 410, 460))))
    return lines.select("*", x.alias("x0")).withColumn("x1", F.col("x0") + 35)


def _table_pages(s, d) -> tuple[DataFrame, DataFrame]:
    """A table of twenty parts a page, between rules and under a caption: glyphs (a word each) and edges."""
    part = _read(s, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), (F.col("p_partkey") % 20 + 1).alias("row"), "p_type", F.col("p_size").cast("string").alias("size"), F.col("p_partkey").cast("string").alias("key"))
    words = lambda rows, row, texts: rows.select("page", row.alias("row"), F.explode(F.array(*(F.struct((F.lit(x) if isinstance(x, float) else x).alias("x"), t.alias("text")) for x, t in texts))).alias("w"))
    pages = part.select("page").distinct()
    body = words(part, F.col("row"), [(50.0, F.element_at(F.split("p_type", " "), 1)), (F.length(F.element_at(F.split("p_type", " "), 1)) * 5.0 + 53.0, F.element_at(F.split("p_type", " "), -1)), (300.0, F.col("size")), (400.0, F.col("key"))])
    head = words(pages, F.lit(0), [(50.0, F.lit("Type")), (300.0, F.lit("Size")), (400.0, F.lit("Key"))])
    title = words(pages, F.lit(-1), [(50.0, F.lit("Table")), (90.0, F.concat(F.col("page"), F.lit(".")))])
    g = body.unionByName(head).unionByName(title).select(F.lit(0).alias("document_id"), "page", (F.col("row") * 1000 + F.col("w.x")).cast("long").alias("glyph_id"), F.col("w.text").alias("text"), F.col("w.x").alias("x0"), (F.col("w.x") + F.length("w.text") * 5.0).alias("x1"), (100.0 + F.col("row") * 14 - F.when(F.col("row") < 0, 4.0).otherwise(0.0)).alias("top"))
    g = g.withColumn("bottom", F.col("top") + 9)
    y = F.explode(F.array(F.lit(97.0), F.lit(111.0), F.lit(400.0))).alias("top")
    edges = pages.select(F.lit(0).alias("document_id"), "page", y).select("*", F.lit("h").alias("orientation"), F.lit(45.0).alias("x0"), F.lit(500.0).alias("x1"), F.col("top").alias("bottom"))
    return g, edges


def _ruled(s, d) -> DataFrame:
    g, edges = _table_pages(s, d)
    lines = layout.line_texts(layout.words_of(layout.lines_of(g, *layout.PAGE)), *layout.PAGE, "line")
    t = layout.ruled_tables(cut(layout.ruled_regions(edges, lines)), g)
    rows = t.select("page", F.col("table.caption").alias("caption"), F.posexplode("table.rows").alias("row", "cells"))
    return rows.select("page", "caption", "row", F.posexplode("cells").alias("column", "c")).select("page", "caption", "row", "column", F.col("c.text").alias("text"))


def _claims(s, d, hits) -> DataFrame:
    """Claims made from hits: most quote their chunk, some quote or cite what is not there."""
    h = answering.extractive(hits, _chunks(s, d))
    return h.select("query_id", "claim_no", (F.col("chunk_id") + (F.col("query_id") % 4 == 3).cast("long") * 999983).alias("chunk_id"), F.concat("text", F.when(F.col("query_id") % 4 == 1, " 77").otherwise("")).alias("text"), F.concat("text", F.when(F.col("query_id") % 4 == 2, " not there").otherwise("")).alias("quote"))


_line = lambda *c: "'| ' || " + " || ' | ' || ".join(c) + " || ' |'"
TABLE_PARTS = f"""WITH RECURSIVE p AS (SELECT p_brand || '/' || (p_partkey // 300) AS id, row_number() OVER (PARTITION BY p_brand, p_partkey // 300 ORDER BY p_partkey) AS i, {_line('p_type', 'p_name', 'p_size')} AS line FROM part),
w AS (SELECT id, '| Type | Name | Size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM p GROUP BY id),
r AS (SELECT id, i, 0 AS part, 57 + 1 + length(line) AS held FROM p WHERE i = 1
  UNION ALL SELECT p.id, p.i, CASE WHEN held + 1 + length(line) > 400 THEN part + 1 ELSE part END, CASE WHEN held + 1 + length(line) > 400 THEN 57 ELSE held END + 1 + length(line) FROM r JOIN p ON p.id = r.id AND p.i = r.i + 1)
SELECT id, part::INT AS part, '| Type | Name | Size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) || 'Table 1. Parts' AS text FROM r JOIN p USING (id, i) JOIN w USING (id) WHERE length(w.text) > 400 GROUP BY id, part
UNION ALL SELECT id, NULL, text FROM w WHERE length(text) <= 400"""

QUERIES = {
    "tokenize_terms": (lambda s, d: _read(s, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("terms")),
        f"SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {_terms('text')} AS t FROM documents)"),
    "cjk_bigrams": (lambda s, d: s.sql("SELECT * FROM VALUES (1, '准确率99.2%提升'), (2, '图'), (3, 'The 模型 beats 基线方法') AS v(id, text)").select("id", F.array_join(T.tokens(F.col("text")), " ").alias("terms")),
        f"SELECT id, array_to_string({_terms('text')}, ' ') AS terms FROM (VALUES (1, '准确率99.2%提升'), (2, '图'), (3, 'The 模型 beats 基线方法')) AS v(id, text)"),
    "term_frequency": (lambda s, d: lexical.term_frequency(_chunks(s, d)), f"WITH {TOKENS} SELECT * FROM tf"),
    "document_length": (lambda s, d: lexical.document_length(_chunks(s, d)), f"WITH {TOKENS} SELECT * FROM len"),
    "avg_length": (lambda s, d: lexical.corpus_size(lexical.document_length(_chunks(s, d)), []).select("n", F.round("average", 6).alias("average")), f"WITH {TOKENS} SELECT count(*) AS n, round(avg(length), 6) AS average FROM len"),
    "document_frequency": (lambda s, d: lexical.chunk_frequency(_chunks(s, d), []), f"WITH {TOKENS} SELECT term, count(*) AS df FROM tf GROUP BY term"),
    "idf": (lambda s, d: lexical.idf(lexical.chunk_frequency(_chunks(s, d), []), lexical.corpus_size(lexical.document_length(_chunks(s, d)), []), []).select("term", F.round("idf", 6).alias("idf")), f"WITH {TOKENS} SELECT term, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf CROSS JOIN (SELECT count(*) AS n FROM len) GROUP BY term, n"),
    "bm25_topk": (lambda s, d: _hits(s, d).select("query_id", "document_id", "chunk_id", F.round("score", 6).alias("score"), "rank"), f"{HITS} SELECT query_id, document_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM hits"),
    "bm25_topk_per_document": (lambda s, d: lexical.bm25(_chunks(s, d), _questions(s, d), k=1, scope="document").select("query_id", "document_id", "chunk_id", F.round("score", 6).alias("score")), f"WITH {_bm25('document')} SELECT query_id, document_id, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 1"),
    "section_carry_forward": (lambda s, d: _sections(s, d).select("document_id", "page", "ord", "kind", "section"), f"WITH {BLOCKS} SELECT document_id, page, ord, kind, section FROM sec"),
    "chunk_pack": (lambda s, d: chunking.pack(_sections(s, d)).select("document_id", "chunk_no", "page", "section", "text", "id"), PACK),
    "fixed_windows": (lambda s, d: chunking.fixed_windows(_sections(s, d)).withColumn("block_ids", F.array_join("block_ids", "|")), f"WITH {BLOCKS}, a AS (SELECT document_id, page, string_agg(text, chr(10) ORDER BY ord) || chr(10) AS t FROM sec WHERE kind <> 'heading' GROUP BY ALL), p AS (SELECT document_id, page, t, unnest(range(0, length(t), 1400)) AS start FROM a), sp AS (SELECT document_id, page, ord, length(text) + 1 AS n, sum(length(text) + 1) OVER (PARTITION BY document_id, page ORDER BY ord) AS z FROM sec WHERE kind <> 'heading'), m AS (SELECT p.document_id, p.page, p.start, string_agg(document_id || ':p' || page || ':b' || ord, '|' ORDER BY ord) AS block_ids FROM p JOIN sp USING (document_id, page) WHERE z > start AND z - n < start + 1400 GROUP BY ALL) SELECT document_id, page, start, substr(t, (start + 1)::BIGINT, 1400) AS text, substr(sha256('fixed:' || page || ':' || start || ':' || substr(t, (start + 1)::BIGINT, 1400)), 1, 16) AS id, block_ids FROM p JOIN m USING (document_id, page, start)"),
    "number_tokens": (lambda s, d: _read(s, d, "documents").select("doc_id", F.explode(T.numbers(T.collapse(F.col("text")))).alias("number")), NUMBERS),
    "compact_text": (lambda s, d: _read(s, d, "documents").select("doc_id", F.sha2(T.compact(F.col("text")), 256).alias("h")), "SELECT doc_id, sha256(regexp_replace(text, '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g')) AS h FROM documents"),
    "table_markdown": (lambda s, d: _tables(s, d).select("chunk_id", T.markdown(F.transform("rows", lambda r: F.transform(r, lambda c: c["text"]))).alias("markdown")), f"WITH {CELLS} SELECT brand AS chunk_id, '| Type | Name | Size |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(items, lambda x: '| ' || x.t || ' | ' || x.n || ' | ' || x.s || ' |'), chr(10)) AS markdown FROM t"),
    "bindable_cells": (lambda s, d: tables.cells(_tables(s, d)).select("chunk_id", "row", "column", "row_label", "column_label", "value"), "WITH p AS (SELECT *, p_brand || '/' || (p_partkey // 300) AS brand, row_number() OVER (PARTITION BY p_brand, p_partkey // 300 ORDER BY p_partkey)::INT AS \"row\" FROM part) SELECT brand AS chunk_id, \"row\", 1 AS \"column\", p_type AS row_label, 'Name' AS column_label, p_name AS value FROM p UNION ALL SELECT brand, \"row\", 2, p_type, 'Size', p_size::VARCHAR FROM p WHERE p_partkey % 5 <> 0"),
    "unit_vectors": (lambda s, d: _read(s, d, "embeddings").select("vec_id", F.posexplode(semantic.unit(F.col("embedding"))).alias("no", "x")).select("vec_id", "no", F.round("x", 6).alias("x")), "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS no, round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS x FROM embeddings"),
    "maxpool_topk": (lambda s, d: semantic.dense(_windows(s, d), _vector_queries(s, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank"), f"WITH {WORDS}, m AS (SELECT query_id, chunk_id, max(greatest(-1, least(1, list_inner_product(v, q)))) AS score FROM u CROSS JOIN qu GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id)::INT AS rank FROM m) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM k WHERE rank <= 5"),
    "owner_coverage": (lambda s, d: semantic.uncovered(s.range(0, 3).withColumnRenamed("id", "chunk_id").unionByName(_windows(s, d).select("chunk_id")), _windows(s, d).where("chunk_id > 1")), "SELECT DISTINCT vec_id // 5 AS chunk_id, 'no window' AS fault FROM embeddings WHERE vec_id // 5 <= 1"),
    "rrf_fusion": (lambda s, d: semantic.fuse(semantic.dense(_windows(s, d), _vector_queries(s, d), k=20), semantic.dense(_windows(s, d), _vector_queries(s, d).join(_vector_partners(s, d), "query_id").select(F.col("partner").alias("query_id"), "embedding"), k=20)).select("query_id", "chunk_id", F.round("score", 8).alias("score"), "rank"), f"WITH {WORDS}, partners AS (SELECT vec_id AS query_id, max(vec_id) OVER () - vec_id AS partner FROM embeddings WHERE vec_id % 20 = 0), m AS (SELECT query_id, chunk_id, max(greatest(-1, least(1, list_inner_product(v, q)))) AS score FROM u CROSS JOIN qu GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id)::INT AS rank FROM m), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM k WHERE rank <= 20 UNION ALL SELECT partner, chunk_id, rank FROM k JOIN partners USING (query_id) WHERE rank <= 20) GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, chunk_id)::INT AS rank FROM f) SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM o WHERE rank <= 5"),
    "extractive_claims": (lambda s, d: answering.extractive(_kept(s, d), _chunks(s, d)).select("query_id", "claim_no", "chunk_id", "text"), f"{HITS} SELECT query_id, rank::INT AS claim_no, chunk_id, text FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 3"),
    "no_hit_abstain": (lambda s, d: answering.without_hits(_questions(s, d).unionByName(s.createDataFrame([(-1, "xylophonic biodiversity")], "query_id long, question string")), _hits(s, d)), f"{HITS} SELECT query_id, true AS abstain, 'no evidence was found' AS reason FROM (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1) WHERE query_id NOT IN (SELECT query_id FROM hits)"),
    "evidence_budget": (lambda s, d: answering.evidence_size(_kept(s, d), _chunks(s, d), 3000), f"{HITS} SELECT query_id, sum(length(text))::BIGINT AS chars, sum(length(text)) <= 3000 AS fits FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id"),
    "answer_verdict": (lambda s, d: (lambda hits: answering.validate(_claims(s, d, hits), hits, _chunks(s, d)))(_kept(s, d)), f"{HITS}, c AS (SELECT query_id, rank::INT AS claim_no, h.chunk_id + CASE WHEN query_id % 4 = 3 THEN 999983 ELSE 0 END AS chunk_id, {_col('text')} || CASE WHEN query_id % 4 = 1 THEN ' 77' ELSE '' END AS said, {_col('text')} || CASE WHEN query_id % 4 = 2 THEN ' not there' ELSE '' END AS quote FROM hits h JOIN chunks USING (chunk_id) WHERE rank <= 3), s AS (SELECT hits.query_id, chunk_id, {_col('text')} AS source FROM hits JOIN chunks USING (chunk_id)), j AS (SELECT c.query_id, claim_no, CASE WHEN source IS NULL THEN 'unknown citation' WHEN NOT contains(source, quote) THEN 'quote not in source' WHEN query_id % 4 = 1 AND NOT regexp_matches(quote, '(^|[^A-Za-z0-9.])77($|[^0-9.%])') THEN 'number not in quote' END AS why FROM c LEFT JOIN s USING (query_id, chunk_id)) SELECT query_id, bool_and(why IS NULL) AS valid, arg_min(why, CASE WHEN why IS NOT NULL THEN claim_no END) AS reason FROM j GROUP BY query_id"),
    "answers": (lambda s, d: answering.assemble(_questions(s, d).unionByName(s.createDataFrame([(-1, "xylophonic biodiversity")], "query_id long, question string")), _kept(s, d), _chunks(s, d)).select("query_id", "abstain", "reason", "verification", "validation_failed", F.size("claims").alias("claims"), F.size("hits").alias("hits"), F.col("hits")[0]["score"].alias("best")), f"{HITS} SELECT q.query_id, count(chunk_id) = 0 AS abstain, CASE WHEN count(chunk_id) = 0 THEN 'no evidence was found' ELSE 'the evidence is quoted' END AS reason, CASE WHEN count(chunk_id) > 0 THEN 'quote-provenance-only' END AS verification, false AS validation_failed, least(count(chunk_id), 3)::INT AS claims, nullif(count(chunk_id), 0)::INT AS hits, round(max(score), 4) AS best FROM (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1) q LEFT JOIN hits USING (query_id) GROUP BY q.query_id"),
    "evidence_recall": (lambda s, d: evaluation.evidence_recall(_gold(s, d), _kept(s, d), _chunks(s, d)).select("query_id", F.round("recall", 6).alias("recall"), "n_gold"), f"{RECALL} SELECT query_id, round(recall, 6) AS recall, n_gold FROM rec"),
    "recall_summary": (lambda s, d: evaluation.summary(evaluation.evidence_recall(_gold(s, d), _kept(s, d), _chunks(s, d)), _questions(s, d).select("query_id", (F.col("query_id") % 2).alias("grp")), "grp"), f"{RECALL} SELECT query_id % 2 AS grp, round(avg(recall), 6) AS recall, count(*) AS questions FROM rec GROUP BY GROUPING SETS ((query_id % 2), ())"),
    "interval_union": (lambda s, d: layout.merge_intervals(_intervals(s, d), "supplier"), "WITH i AS (SELECT l_suppkey AS supplier, l_partkey AS l, l_partkey + l_quantity::BIGINT AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY supplier ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), n AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT supplier, min(l) AS \"left\", max(r) AS \"right\" FROM n GROUP BY supplier, island"),
    "box_overlap": (lambda s, d: _boxes(s, d).select("l_orderkey", "l_linenumber", F.round(layout.overlap(F.col("a"), F.col("b")), 6).alias("share"), layout.contains_center(F.col("a"), F.col("b")).alias("inside")), f"SELECT l_orderkey, l_linenumber, round((greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(a3, b3) - greatest(a1, b1)) / greatest(1, least((a2 - a0) * (a3 - a1), (b2 - b0) * (b3 - b1))))::DOUBLE, 6) AS share, (b0 + b2) / 2 BETWEEN a0 - 1 AND a2 + 1 AND (b1 + b3) / 2 BETWEEN a1 - 1 AND a3 + 1 AS inside FROM {BOXES}"),
    "word_segmentation": (lambda s, d: layout.words_of(layout.lines_of(_glyphs(s, d), *layout.PAGE)).select("document_id", "line", "word", "text"), "SELECT p_partkey AS document_id, line::INT AS line, generate_subscripts(ws, 1)::INT AS word, unnest(ws) AS text FROM (SELECT p_partkey, 1 AS line, string_split(p_name, ' ') AS ws FROM part UNION ALL SELECT p_partkey, 2, string_split(p_type, ' ') FROM part)"),
    "reading_order": (lambda s, d: layout.reading_order(_objects(s, d), s.range(0, 1 << 20, 2).select(F.lit(0).alias("document_id"), F.col("id").alias("page"), F.lit(300.0).alias("gutter"))).select("page", "object_id", "position", "flow"), f"WITH o AS (SELECT *, CASE WHEN page % 2 = 1 THEN 'single' WHEN x0 < 300 AND x1 > 300 THEN 'wide' WHEN x0 < 300 THEN 'left' ELSE 'right' END AS side FROM {OBJECTS}), w AS (SELECT *, row_number() OVER (PARTITION BY page, side ORDER BY top, object_id) AS nth FROM o), b AS (SELECT w.*, CASE side WHEN 'single' THEN 0 WHEN 'wide' THEN nth - 1 ELSE (SELECT count(*) FROM w v WHERE v.page = w.page AND v.side = 'wide' AND v.top <= w.top + 5) END AS band FROM w) SELECT page, object_id, row_number() OVER (PARTITION BY page ORDER BY band, CASE side WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END, top, CASE WHEN side = 'single' THEN x0 END, object_id)::INT AS position, CASE side WHEN 'single' THEN 'single' ELSE 'band' || band || '-' || side END AS flow FROM b"),
    "unanswerable_probe": (lambda s, d: evaluation.candidates(_questions(s, d).unionByName(s.createDataFrame([(-1, "xylophonic biodiversity")], "query_id long, question string")), _hits(s, d)), f"{HITS} SELECT query_id, count(chunk_id) AS candidates FROM (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT -1) LEFT JOIN hits USING (query_id) GROUP BY query_id"),
    "prompt_payload": (lambda s, d: answering.prompts(_questions(s, d), _kept(s, d), _chunks(s, d)), f"{HITS} SELECT item_id AS query_id, to_json(struct_pack(question := any_value(b.text), evidence := list(struct_pack(chunk_id := chunk_id, text := c.text) ORDER BY rank)))::VARCHAR AS payload FROM benchmark b JOIN hits ON query_id = item_id JOIN chunks c USING (chunk_id) GROUP BY item_id"),
    "evidence_availability": (lambda s, d: evaluation.availability(_gold(s, d).unionByName(_gold(s, d).withColumn("document_id", F.col("document_id") + F.col("query_id") % 2)), _chunks(s, d)), f"WITH {LINES}, {GOLD}, g AS (SELECT DISTINCT query_id, document_id, {_col('quote')} AS q FROM (FROM gold UNION ALL SELECT query_id, document_id + query_id % 2, quote FROM gold)), e AS (SELECT g.query_id, g.document_id, g.q, count(c.text) AS n FROM g LEFT JOIN chunks c ON c.document_id = g.document_id AND contains({_col('c.text')}, g.q) GROUP BY ALL) SELECT query_id, bool_and(n > 0) AS available, count(*) AS n_gold FROM e GROUP BY query_id"),
    "table_value_claims": (lambda s, d: answering.table_values(_tables(s, d).select("chunk_id", F.posexplode("rows").alias("row", "r")).where("row >= 1").select("chunk_id", "row", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("column")), _tables(s, d)).select("chunk_id", "row", "column", "value", "claim", "valid"), "WITH p AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_partkey // 300, p_type) AS same, p_brand || '/' || (p_partkey // 300) AS brand, row_number() OVER (PARTITION BY p_brand, p_partkey // 300 ORDER BY p_partkey)::INT AS \"row\" FROM part) SELECT brand AS chunk_id, \"row\", c AS \"column\", CASE c WHEN 1 THEN p_name WHEN 2 THEN CASE WHEN p_partkey % 5 <> 0 THEN p_size::VARCHAR END END AS value, CASE WHEN c = 1 THEN p_type || ' · Name：' || p_name WHEN c = 2 AND p_partkey % 5 <> 0 THEN p_type || CASE WHEN same > 1 THEN ' / Name=' || p_name ELSE '' END || ' · Size：' || p_size END AS claim, c = 1 OR (c = 2 AND p_partkey % 5 <> 0) AS valid FROM p CROSS JOIN (VALUES (1), (2), (3)) AS v(c)"),
    "markdown_parse": (lambda s, d: _tables(s, d).select("chunk_id", F.explode(F.slice(T.parse_markdown(T.markdown(F.transform("rows", lambda r: F.transform(r, lambda c: c["text"])))), 2, F.size("rows"))).alias("r")).select("chunk_id", F.col("r")[0].alias("type"), F.col("r")[1].alias("name"), F.col("r")[2].alias("size")), "SELECT p_brand || '/' || (p_partkey // 300) AS chunk_id, p_type AS type, p_name AS name, p_size::VARCHAR AS size FROM part"),
    "table_parts": (lambda s, d: chunking.table_parts(_tables(s, d).select(F.col("chunk_id").alias("id"), T.markdown(F.transform("rows", lambda r: F.transform(r, lambda c: c["text"]))).alias("text"), F.lit("Table 1. Parts").alias("caption"), "rows"), 400).select("id", "part", "text"), TABLE_PARTS),
    "token_windows": (lambda s, d: chunking.token_windows(_read(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.split(F.coalesce("text", F.lit("")), " ", -1).alias("tokens"))).select("chunk_id", "window_no", F.array_join("tokens", " ").alias("text")), "WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS a FROM documents), w AS (SELECT doc_id, a, unnest(range(greatest(ceil((len(a) - 64) / 384), 1)::BIGINT)) AS n FROM t) SELECT doc_id AS chunk_id, n::INT AS window_no, array_to_string(a[n * 384 + 1 : n * 384 + 448], ' ') AS text FROM w"),
    "corpus_fingerprint": (lambda s, d: semantic.fingerprint(_chunks(s, d), "e5|", "document_id"), f"WITH {LINES}, h AS (SELECT document_id, sha256(chunk_id::VARCHAR || '|' || text) AS h FROM chunks) SELECT document_id, sha256('e5|' || string_agg(h, '' ORDER BY h)) AS fingerprint FROM h GROUP BY document_id"),
    "chunker_comparison": (lambda s, d: evaluation.compare_chunkers({"lines": _chunks(s, d), "sections": chunking.pack(_sections(s, d)).select((F.col("document_id") * 1000000 + F.col("chunk_no")).alias("chunk_id"), "document_id", "text"), "windows": chunking.fixed_windows(_sections(s, d)).select((F.col("document_id") * 1000000000 + F.col("page") * 1000000 + F.col("start")).alias("chunk_id"), "document_id", "text")}, _questions(s, d), cut(_gold(s, d))), None),
    "gutter_detection": (lambda s, d: layout.gutters(_gutter_words(s, d), 612.0).select("page", "gutter"), "SELECT s_suppkey AS page, (286 + 309 + s_suppkey % 20) / 2 AS gutter FROM supplier WHERE s_suppkey % 4 + 5 >= 6"),
    "ruled_tables": (_ruled, "WITH p AS (SELECT p_partkey // 20 AS page, p_partkey % 20 + 1 AS row, string_split(p_type, ' ') AS t, p_size, p_partkey FROM part), pages AS (SELECT page, 'Table ' || page || '.' AS caption FROM p GROUP BY page HAVING count(*) >= 2), r AS (SELECT page, (row_number() OVER (PARTITION BY page ORDER BY row))::INT AS row, [t[1] || ' ' || t[-1], p_size::VARCHAR, p_partkey::VARCHAR] AS cells FROM p UNION ALL SELECT page, 0, ['Type', 'Size', 'Key'] FROM pages) SELECT page, caption, row, (generate_subscripts(cells, 1) - 1)::INT AS \"column\", unnest(cells) AS text FROM r JOIN pages USING (page)"),
}


def queries() -> dict:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in QUERIES.items() if v[1]}
