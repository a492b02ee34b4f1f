"""Pages from glyphs to blocks, two documents at a time, so that pages of one never reach the other."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import chunking, evaluation, layout
from quillon.sources import index, settings

BOX = layout.BBOX
GLYPH = "document_id string, page int, glyph_id long, text string, x0 double, top double, x1 double, bottom double"
EDGE = "document_id string, page int, orientation string, x0 double, top double, x1 double, bottom double"


def _words(doc, page, x, top, text, gap=3.0, width=4.5):
    """A glyph for each letter, a gap between words."""
    out = []
    for word in text.split():
        for c in word:
            out.append([doc, page, c, float(x), float(top), x + width, top + 9.0])
            x += width
        x += gap
    return out


def _glyphs(spark, *lines):
    rows = [g for line in lines for g in line]
    return spark.createDataFrame([(d, p, i, c, x0, top, x1, bottom) for i, (d, p, c, x0, top, x1, bottom) in enumerate(rows)], GLYPH)


def _columns(doc):
    wide = [_words(doc, 1, 175, 37, "A full width heading across both columns")]
    left = [_words(doc, 1, 55, 82 + i * 13, f"Left{i:02} alpha beta gamma delta epsilon zeta eta") for i in range(12)]
    right = [_words(doc, 1, 330, 82 + i * 13, f"Right{i:02} theta iota kappa lambda mu nu xi") for i in range(12)]
    return wide + left + right


def _table(doc, caption=True, header="Method Score Cost", top=0.0):
    cells = lambda y, *ws: [g for x, w in zip((80, 305, 440), ws, strict=False) for g in _words(doc, 1, x, y + top, w)]
    title = [_words(doc, 1, 70, 60 + top, "Table 9. Unrelated comparison")] if caption else []
    edges = [(doc, 1, "h", 70.0, float(y + top), 520.0, float(y + top)) for y in (80, 103, 160)]
    return [*title, cells(93, *header.split()), cells(118, "Alpha encoder", "17.4", "3.2M"), cells(138, "Beta decoder", "28.6", "7.1M")], edges


def _blocks(spark, lines, edges=(), grids=()):
    g = spark.createDataFrame(list(grids), f"document_id string, page int, no int, box {BOX}, rows array<array<struct<text:string,bbox:{BOX}>>>")
    return layout.page_blocks(_glyphs(spark, *lines), spark.createDataFrame(list(edges), EDGE), g).orderBy("document_id", "page", "ord").collect()


def test_columns_are_read_one_after_the_other(spark):
    plain = [_words("b", 1, 55, 82 + i * 13, f"Line{i:02} the short prose holds several ordinary words without a gutter here") for i in range(12)]
    rows = _blocks(spark, _columns("a") + plain)
    a, b = ([r for r in rows if r.document_id == d] for d in "ab")
    assert a[0].text == "A full width heading across both columns" and a[0].flow == "band0-wide"
    assert [r.text[:4] for r in a[1:]] == ["Left"] * 12 + ["Righ"] * 12 and {r.flow for r in a[1:]} == {"band1-left", "band1-right"}
    assert [r.text[:6] for r in b] == [f"Line{i:02}" for i in range(12)] and {r.flow for r in b} == {"single"}


def test_tables_between_rules(spark):
    (a, ea), (b, eb), (c, ec) = _table("a"), _table("b", caption=False), _table("c", header="Method 1 2")
    rows = _blocks(spark, a + b + c, ea + eb + ec)
    tables = {r.document_id: r for r in rows if r.kind == "table"}
    assert set(tables) == {"a"}  # without a caption, or with numbers for a header, the text stays text
    t = tables["a"].table
    assert t.extraction == "horizontal-rules-word-gutters" and t.caption == "Table 9. Unrelated comparison"
    assert [[x.text for x in r] for r in t.rows] == [["Method", "Score", "Cost"], ["Alpha encoder", "17.4", "3.2M"], ["Beta decoder", "28.6", "7.1M"]]
    assert all(70 <= x.bbox.x0 < x.bbox.x1 <= 520 for r in t.rows for x in r)
    assert not any("28.6" in r.text for r in rows if r.document_id == "a" and r.kind == "text")
    assert all(any("28.6" in r.text for r in rows if r.document_id == d) for d in "bc")


def test_spanning_rows_and_caption_below(spark):
    lines, edges = _table("a", caption=False)
    lines = [*lines, _words("a", 1, 80, 128, "Group of models"), _words("a", 1, 70, 165, "Table 3: below"), _words("a", 1, 70, 176, "second line")]
    t = next(r.table for r in _blocks(spark, lines, edges) if r.kind == "table")
    assert t.caption == "Table 3: below\nsecond line"
    assert [(r[0].text, r[0].bbox is None) for r in t.rows] == [("Method", False), ("Alpha encoder", False), ("Group of models", True), ("Beta decoder", False)]


def test_grids(spark):
    lines, edges = _table("a")
    box = lambda *v: tuple(float(x) for x in v)
    cells = lambda *rows: [[(t, box(0, 0, 1, 1)) for t in r] for r in rows]
    full, sparse = cells(("x", "y"), ("1", "2")), cells(("60", "", ""), ("", "", ""))
    grids = [("a", 1, 0, box(70, 80, 520, 160), full), ("a", 1, 1, box(70, 400, 300, 500), full), ("a", 1, 2, box(72, 402, 298, 498), full), ("a", 1, 3, box(70, 600, 300, 700), sparse)]
    tables = [r for r in _blocks(spark, lines, edges, grids) if r.kind == "table"]
    assert [t.table.extraction for t in tables] == ["horizontal-rules-word-gutters", "grid"]


def test_words_keep_a_shared_glyph_once(spark):
    rows = [("a", 1, 1, "of", 0.0, 0.0, 5.0, 9.0), ("a", 1, 2, "ﬁ", 5.2, 0.0, 9.0, 9.0), ("a", 1, 2, "ﬁ", 5.2, 0.0, 9.0, 9.0), ("a", 1, 3, "x", 12.0, 1.0, 15.0, 9.0), ("b", 1, 4, "y", 9.5, 0.0, 11.0, 9.0)]
    out = layout.words_of(layout.lines_of(spark.createDataFrame(rows, GLYPH), *layout.PAGE)).orderBy("document_id", "word").collect()
    assert [(w.document_id, w.text, w.glyphs) for w in out] == [("a", "ofﬁ", [1, 2]), ("a", "x", [3]), ("b", "y", [4])]


def test_warnings(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2)], "document_id string, page int")
    g = _glyphs(spark, _words("a", 1, 0, 0, "x"))
    images = spark.createDataFrame([("a", 1), ("a", 1)], "document_id string, page int")
    out = sorted((r.page or 0, r.warning[:12]) for r in layout.warnings(pages, g, images, pages.where("page = 2")).collect())
    assert out == [(0, "reading orde"), (1, "2 images, wh"), (2, "a sparse or "), (2, "no text laye")]


def test_split_table_keeps_only_its_boxes(spark):
    cell = lambda t, y: (t, (0.0, float(y), 1.0, float(y + 1)))
    rows = [[cell("Method", 0), cell("Score", 0)]] + [[cell(f"Variant-{i}", i + 1), cell("100", i + 1)] for i in range(20)]
    ddl = f"document_id string, page int, ord int, kind string, flow string, section string, text string, bbox {BOX}, table {layout.TABLE}"
    whole = (0.0, 0.0, 1.0, 21.0)
    blocks = spark.createDataFrame([("a", 1, 0, "text", "single", "S", "before", whole, None), ("a", 1, 1, "table", "single", "S", "X" * 1500, whole, (rows, "grid", "Table 8.")), ("a", 1, 2, "text", "single", "S", "after", whole, None)], ddl)
    out = chunking.pack(blocks, 160).orderBy("chunk_no").collect()
    parts = out[1:-1]
    assert (out[0].text, out[-1].text) == ("before", "after") and len(parts) > 1 and all(len(p.text) <= 160 and p.kind == "table" for p in parts)
    assert [r[0].text for p in parts for r in p.table.rows[1:]] == [f"Variant-{i}" for i in range(20)]
    assert all(len(p.boxes) == 2 * len(p.table.rows) for p in parts) and max(b.top for b in parts[0].boxes) < 20
    assert [p.block_ids for p in parts] == [[f"a:p1:b1:rows{i}"] for i in range(len(parts))] and len({p.id for p in out}) == len(out)


def test_gold_stands_in_the_source(spark):
    lines, _ = _table("a")
    gold = spark.createDataFrame([("g", "a", 1, (300.0, 110.0, 340.0, 130.0), "17. 4"), ("h", "a", 1, (300.0, 130.0, 340.0, 150.0), "17.4"), ("i", "b", 1, (0.0, 0.0, 900.0, 900.0), "17.4")], f"gold_id string, document_id string, page int, bbox {BOX}, quote string")
    assert {r.gold_id: r.valid for r in layout.source_text(_glyphs(spark, *lines), gold).collect()} == {"g": True, "h": False, "i": False}


def test_report_and_provenance(spark):
    rows = spark.createDataFrame([(1, True, "table", "en", "p", 1.0, 0.5), (2, True, "text", "zh", "p", 0.0, None), (3, False, "text", "en", "q", None, None)], "query_id int, answerable boolean, kind string, language string, document_id string, recall double, bound double")
    got = {(r.section, r.value): (r.recall, r.bound, r.questions) for r in evaluation.report(rows).collect()}
    assert got == {("overall", None): (0.5, 0.5, 2), ("tables", "table"): (1.0, 0.5, 1), ("language", "en"): (1.0, 0.5, 1), ("language", "zh"): (0.0, None, 1), ("document", "p"): (0.5, 0.5, 2)}
    a, b = spark.range(100).repartition(5), spark.range(99, -1, -1)
    x, y, z = evaluation.provenance({"a": a, "b": b, "none": a.where("false")}).orderBy("name").collect()
    assert x.sha256 == y.sha256 != z.sha256 and (x.n_rows, z.n_rows) == (100, 0)


def test_index_files(spark, tmp_path):
    table = ([[("h", None), ("s", (0.0, 1.0, 2.0, 3.0))]], "grid", "")
    chunks = spark.createDataFrame([("c1", "d", 1, "S", "text", "ä", ["b"], [(0.0, 0.0, 1.0, 1.0)], None), ("c2", "d", 2, "S", "table", "t", ["b2"], [], table)], index.CHUNK.replace("struct<", "", 1)[:-1])
    papers = spark.createDataFrame([("d", "n.pdf", 2, ["w"]), ("e", "empty.pdf", 0, [])], "id string, name string, pages int, warnings array<string>")
    index.export_index(papers, chunks, f"{tmp_path}/json")
    assert "ä" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "json").glob("part-*"))
    back = spark.read.schema(index.INDEX).json(f"{tmp_path}/json")
    assert back.where("schema_version = 2").count() == 2
    (tmp_path / "one.json").write_text(back.where("paper.id = 'd'").toJSON().first())
    assert sorted(r.asDict(True)["id"] for r in index.read_index(spark, f"{tmp_path}/one.json").collect()) == ["c1", "c2"]
    got = {r.id: r for r in index.read_index(spark, f"{tmp_path}/one.json").collect()}
    assert got["c1"].table is None and got["c2"].table.rows[0][1].bbox.x1 == 2.0 and got["c2"].table.caption == ""
    (tmp_path / "three.json").write_text('{"schema_version": 3, "chunks": []}')
    with pytest.raises(Exception, match="schema_version"):
        index.read_index(spark, f"{tmp_path}/three.json").collect()
    index.write_index(chunks, f"{tmp_path}/parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 2


def test_vectors_are_written_once(spark, tmp_path):
    w = spark.createDataFrame([("c", 0, [1.0, 2.0])], "chunk_id string, window_no int, embedding array<float>")
    index.write_vectors(w, str(tmp_path), "f")
    assert index.read_vectors(spark, str(tmp_path), "f").collect() == w.collect()
    with pytest.raises(Exception, match="(?i)exist"):
        index.write_vectors(w, str(tmp_path), "f")


def test_files_and_questions(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    for name, data in (("good.pdf", b"%PDF-1.4 x"), ("bad.pdf", b"text"), ("pinned.pdf", b"%PDF-1.4 y")):
        (tmp_path / "pdf" / name).write_bytes(data)
    out = {r.name: r for r in index.scan_files(spark, f"{tmp_path}/pdf", sha256={"pinned.pdf": "0" * 64}).collect()}
    assert {k: r.refused for k, r in out.items()} == {"good.pdf": None, "bad.pdf": "not a PDF", "pinned.pdf": "another digest"}
    assert {r.refused for r in index.scan_files(spark, f"{tmp_path}/pdf", max_bytes=3).collect()} == {"too large"}
    (tmp_path / "qa.json").write_text('[{"id": "q", "paper_id": "d", "question": "?", "evidence": [{"page": 2, "quote": "x", "bbox": [0, 1, 2, 3], "kind": "table", "table": {"row_label": "r", "column_label": "c"}}]}, {"id": "n", "question": "?", "evidence": []}]')
    qa = index.read_questions(spark, f"{tmp_path}/qa.json")
    assert {r.id: r.answerable for r in qa.collect()} == {"q": True, "n": False}
    g = index.gold_of(qa).collect()
    assert [(r.gold_id, r.document_id, r.page, r.bbox.x1, r.row_label, r.row_context) for r in g] == [("q:0", "d", 2, 2.0, "r", None)]
    pages = spark.createDataFrame([("d", p) for p in range(3)], "document_id string, page int")
    assert index.within_pages(pages).first().pages == 3
    with pytest.raises(Exception, match="too many pages"):
        index.within_pages(pages, 2).collect()
    assert index.highlights(spark.createDataFrame([("d", 1, "c", [], "x")], "document_id string, page int, chunk_id string, boxes array<int>, text string")).columns == ["document_id", "page", "chunk_id", "boxes"]


def test_addresses():
    assert settings.check_local("http://localhost:11434/", "m") == "http://localhost:11434"
    for url, model in (("https://localhost", "m"), ("http://example.com", "m"), ("http://u:p@localhost", "m"), ("http://localhost/x", "m"), ("http://localhost", "xcloud"), ("http://localhost", " ")):
        with pytest.raises(ValueError):
            settings.check_local(url, model)
    good = settings.Settings(url="https://h.example/v1/", model="m", key="k")
    assert settings.check_remote(good) == "https://h.example/v1/chat/completions"
    for bad in ({"url": "http://h"}, {"url": "https://u:p@h"}, {"url": "https://h?x=1"}, {"model": " "}, {"key": ""}, {"key": "a\nb"}):
        with pytest.raises(ValueError):
            settings.check_remote(settings.Settings(**({"url": "https://h", "model": "m", "key": "k"} | bad)))


def test_reading_order_needs_both_keys(spark):
    box = lambda x0, top, x1: (x0, top, x1, top + 10.0)
    rows = [("a", 1, 1, box(55.0, 10.0, 290.0)), ("a", 1, 2, box(315.0, 5.0, 500.0)), ("a", 1, 3, box(55.0, 30.0, 500.0)), ("a", 1, 4, box(315.0, 50.0, 500.0)), ("a", 1, 5, box(55.0, 52.0, 290.0)), ("b", 1, 6, box(60.0, 1.0, 500.0)), ("b", 1, 7, box(50.0, 1.0, 55.0))]
    g = spark.createDataFrame([("a", 1, 300.0)], "document_id string, page int, gutter double")
    out = layout.reading_order(spark.createDataFrame(rows, f"document_id string, page int, object_id int, box {BOX}"), g).orderBy("document_id", "position").collect()
    assert [(r.object_id, r.flow) for r in out] == [(1, "band0-left"), (2, "band0-right"), (3, "band0-wide"), (5, "band1-left"), (4, "band1-right"), (7, "single"), (6, "single")]
    assert out[0].document_id == "a" and F is not None
