import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import answering, chunking, evaluation, layout, lexical, semantic, tables
from quillon.sources import settings


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, want", [("The Straße 3.5 of", ["strasse", "3.5"]), ("eﬃcient ΣΑΣ ﬁx2", ["efficient", "fix2"]), ("图", ["图"]), ("基线方法", ["基线", "线方", "方法"]), (None, []), ("", [])])
def test_tokens(spark, text, want):
    assert _one(spark, text, T.tokens) == want


def test_numbers_equal_python(spark):
    pattern = re.compile(r"(?<![A-Za-z0-9.])[+-]?\d+(?:\.\d+)?%?(?![\d.])")
    for text in ["is 91.2.", "achieves 91.2%.", "1,000", "3-5", "ResNet50", "COVID-19", "v1.2.3", "准确率99.2%", "+7% -3"]:
        assert _one(spark, text, T.numbers) == list(dict.fromkeys(pattern.findall(text))), text


def test_markdown_pads_and_escapes(spark):
    df = spark.createDataFrame([([["a|b", None], ["c"]],)], "r array<array<string>>")
    assert df.select(T.markdown(F.col("r"))).first()[0] == "| a\\|b |  |\n| --- | --- |\n| c |  |"


def test_bm25_orders_and_limits(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "red red fox den"), (3, 2, ""), (4, 2, "blue")], "chunk_id long, document_id long, text string")
    q = spark.createDataFrame([(7, "red red den"), (8, "absent")], "query_id long, question string")
    hits = lexical.bm25(chunks, q).orderBy("rank").collect()
    assert [(h.query_id, h.chunk_id) for h in hits] == [(7, 2), (7, 1)]
    with pytest.raises(ValueError):
        lexical.bm25(chunks, q, k=21)


def _shuffles(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_counts_once_and_no_pairs(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "red red fox den")], "chunk_id long, document_id long, text string")
    q = spark.createDataFrame([(7, "red den")], "query_id long, question string")
    for scope in ("corpus", "document"):
        keyed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _shuffles(lexical.bm25(chunks, q, k=1, scope=scope)))
        assert not any("query_id" in x and "chunk_id" in x for x in keyed), keyed
    assert [x.split("#")[0] for x in keyed if "document_id" in x] == ["document_id"], keyed


def test_texts_of_hits_are_not_shuffled(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "den")], "chunk_id long, document_id long, text string")
    hits = spark.createDataFrame([(7, 1, 0.5, 1)], "query_id long, chunk_id long, score double, rank int")
    with_texts = answering.extractive(hits, chunks)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange hashpartitioning" not in _shuffles(with_texts) and "BroadcastHashJoin" in _shuffles(with_texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.chunk_id, r.text) for r in with_texts.collect()] == [(1, "red fox")]


def test_fold_replaces_only_letters_that_are_there(spark):
    plan = spark.range(1).select(F.lit("x").alias("x"))
    for text in ("Straße µ ÀÉ", "ΑΣ ﬃ ŉ ß ẞ İ µ", "基线 ß", "plain"):
        assert plan.select(T.fold(F.lit(text)).alias("f")).first().f == text.casefold()


def test_dense_takes_best_window_and_rejects_zero(spark):
    w = spark.createDataFrame([(0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.2, 0.98])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    top = semantic.dense(w, q, k=1).first()
    assert top.chunk_id == 0 and top.score == pytest.approx(1)
    with pytest.raises(Exception, match="finite"):
        semantic.dense(spark.createDataFrame([(0, [0.0, 0.0])], w.schema), q).collect()


def test_fuse(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1)], a.schema)
    assert [r.chunk_id for r in semantic.fuse(a, b).orderBy("rank").collect()] == [2, 1]


def _greedy(lengths, limit):
    out, held = [], 0
    for n in lengths:
        if out and held and held + n <= limit:
            out[-1].append(n)
        else:
            out.append([n])
            held = 0
        held = 0 if n >= limit else held + n + 1
    return out


def test_pack_is_greedy(spark):
    lengths = [40, 50, 60, 120, 10, 10, 99, 1, 98]
    rows = [(1, 1, i, "text", "single", "x" * n, "S") for i, n in enumerate(lengths)]
    blocks = spark.createDataFrame(rows, "document_id long, page int, ord int, kind string, flow string, text string, section string")
    got = [[len(t) for t in r.text.split("\n")] for r in chunking.pack(blocks, 100).orderBy("chunk_no").collect()]
    assert got == _greedy(lengths, 100)
    with pytest.raises(ValueError):
        chunking.pack(blocks, 99)


def test_cells(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [[("Method", box), ("Variant", box), ("Score", box)], [("Encoder", box), ("Small", box), ("17.4", box)], [("Encoder", box), ("Large", box), ("28.6", None)]]
    df = spark.createDataFrame([("t", rows)], "chunk_id string, rows array<array<struct<text:string,bbox:struct<x0:double,top:double,x1:double,bottom:double>>>>")
    got = {(r.row, r.column): r.claim for r in tables.cells(df).collect()}
    assert got[1, 2] == "Encoder / Variant=Small · Score：17.4"
    assert (2, 2) not in got and (2, 1) in got


def test_verdicts(spark):
    chunks = spark.createDataFrame([(1, "The method achieves 91.2% accuracy.")], "chunk_id long, text string")
    hits = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1)], "query_id long, chunk_id long")
    claims = spark.createDataFrame([(0, 1, 1, "91.2% accuracy", "achieves 91.2%  accuracy"), (1, 1, 1, "99%", "91.2%"), (2, 1, 5, "x", "x"), (3, 1, 1, "x", "99.2%")], "query_id long, claim_no int, chunk_id long, text string, quote string")
    got = {r.query_id: (r.valid, r.reason) for r in answering.validate(claims, hits, chunks).collect()}
    assert got == {0: (True, None), 1: (False, "number not in quote"), 2: (False, "unknown citation"), 3: (False, "quote not in source")}


def test_fold_equals_python(spark):
    text = "".join(map(chr, (*range(0x20, 0x600), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)))) + " x ΑΣ"
    assert _one(spark, text, T.fold) == text.casefold()


def test_several_quotes_make_one_claim(spark):
    """Numbers may come from any of a claim's quotes; a table's whole text gives none unless allowed."""
    chunks = spark.createDataFrame([(1, "It was 10 and 20.", "text"), (2, "Then 30 came.", "text"), (3, "| a | 40 |", "table")], "chunk_id long, text string, kind string")
    hits = spark.createDataFrame([(q, c) for q in range(4) for c in (1, 2, 3)], "query_id long, chunk_id long")
    claims = [(0, 1, 1, "10 and 30", "was 10"), (0, 1, 2, "10 and 30", "Then 30"), (1, 1, 1, "10 and 30", "was 10"), (2, 1, 3, "it is 40", "| a | 40 |"), (3, 1, 1, " ", "was 10")]
    df = spark.createDataFrame(claims, "query_id long, claim_no int, chunk_id long, text string, quote string")
    got = {r.query_id: r.reason for r in answering.validate(df, hits, chunks).collect()}
    assert got == {0: None, 1: "number not in quote", 2: "number from a whole table", 3: "empty claim"}
    assert {r.query_id: r.valid for r in answering.validate(df, hits, chunks, enforce_table_values=False).collect()}[2]


def test_assembled_answers(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    cells = [[("Method", box), ("Score", box)], [("Encoder", box), ("17.4", box)]]
    chunks = spark.createDataFrame([("t", "d", 2, "S", "table", "| Encoder | 17.4 |"), ("c", "d", 1, "S", "text", "It reaches 91.2% here.")], "chunk_id string, document_id string, page int, section string, kind string, text string")
    tables_ = spark.createDataFrame([("t", cells)], "chunk_id string, rows array<array<struct<text:string,bbox:struct<x0:double,top:double,x1:double,bottom:double>>>>")
    q = spark.createDataFrame([(i, f"q{i}") for i in range(7)], "query_id long, question string")
    hits = spark.createDataFrame([(i, c, r, s) for i in range(6) for c, r, s in (("c", 1, 2.123456), ("t", 2, 1.0))], "query_id long, chunk_id string, rank int, score double")
    quote = '{"text":"91.2%","evidence":[{"chunk_id":"c","quote":"reaches 91.2%"}]}'
    raw = ['{"abstain":true,"claims":[]}', f'{{"abstain":false,"claims":[{quote}]}}', f'{{"abstain":false,"claims":[{quote},{{"table_value":{{"chunk_id":"t","row":1,"column":1}}}}]}}', f'{{"abstain":false,"claims":[{quote},{{"table_value":{{"chunk_id":"t","row":0,"column":1}}}}]}}', '{"abstain":"no","claims":[]}', '{"abstain":false,"claims":[{"text":"99%","evidence":[{"chunk_id":"c","quote":"reaches"}]}]}']
    answers = spark.createDataFrame(list(enumerate(raw)), "query_id long, answer string")
    got = {r.query_id: r for r in answering.assemble(q, hits, chunks, answers, tables_).collect()}
    assert {k: (r.abstain, r.validation_failed, r.verification) for k, r in got.items()} == {
        0: (True, False, "quote-provenance-only"), 1: (False, False, "quote-provenance-only"), 2: (False, False, "source-cells-and-quotes"), 3: (True, True, None), 4: (True, True, None), 5: (True, True, None), 6: (True, False, None),
    }
    assert [c.text for c in got[2].claims] == ["91.2%", "Encoder · Score：17.4"] and got[2].claims[1].table_value.value == "17.4"
    assert all(not got[k].claims for k in (0, 3, 4, 5, 6)) and got[5].reason.endswith("number not in quote") and got[6].reason == "no evidence was found"
    assert (got[1].hits[0].score, got[1].hits[0].page, got[1].hits[1].kind) == (2.1235, 1, "table")
    plain = {r.query_id: r for r in answering.assemble(q, hits, chunks).collect()}
    assert plain[0].mode == "extractive" and [c.evidence[0].quote for c in plain[0].claims] == ["It reaches 91.2% here.", "| Encoder | 17.4 |"] and plain[6].abstain
    with pytest.raises(Exception, match="blank"):
        answering.assemble(q.withColumn("question", F.lit(" \u00a0")), hits, chunks).collect()


def test_embedders_and_generators_plug_in(spark):
    class Letters:
        """A stand-in for an embedder: a token is a letter."""

        def encode(self, text):
            return list(text)

        def decode(self, ids):
            return "".join(ids)

        def count(self, text):
            return len(text)

        def vectors(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    def refuse():
        raise AssertionError("an empty corpus loads no embedder")

    chunks = spark.createDataFrame([(1, "x" * 100), (2, "short")], "chunk_id long, text string")
    out = semantic.embed_passages(chunks, Letters, limit=39, overlap=5).orderBy("chunk_id", "window_no").collect()
    assert [(r.chunk_id, r.window_no, r.embedding[0]) for r in out] == [(1, 0, 39.0), (1, 1, 39.0), (1, 2, 39.0), (1, 3, 34.0), (2, 0, 14.0)]
    assert semantic.embed_passages(chunks.where("false"), refuse).count() == 0
    q = spark.createDataFrame([(1, "ask")], "query_id long, question string")
    assert semantic.embed_queries(q, Letters).first().embedding[0] == 10.0
    with pytest.raises(Exception, match="too many tokens"):
        semantic.embed_queries(q, Letters, limit=5).collect()
    payload = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id long, payload string")
    got = {r.query_id: (r.answer, r.fault) for r in answering.generate(payload, lambda: lambda p: '{"abstain":true,"claims":[]}' if p == "good" else 1 / 0).collect()}
    assert got[1] == ('{"abstain":true,"claims":[]}', None) and got[2][0] is None and got[2][1].startswith("ZeroDivisionError")


def test_dense_blocks_agree(spark):
    import random

    r = random.Random(3)
    v = lambda: [r.uniform(-1, 1) for _ in range(6)]
    w = spark.createDataFrame([(i // 3, v()) for i in range(120)], "chunk_id long, embedding array<float>").repartition(7)
    q = spark.createDataFrame([(i, v()) for i in range(9)], "query_id long, embedding array<float>")
    key = lambda d: sorted((x.query_id, x.rank, x.chunk_id, round(x.score, 9)) for x in d.collect())
    assert key(semantic.dense(w, q, block=2)) == key(semantic.dense(w, q)) and semantic.dense(w, q.where("false")).count() == 0
    cross = w.crossJoin(q.withColumnRenamed("embedding", "e")).select("query_id", "chunk_id", semantic.cosine(semantic.unit(F.col("embedding")), semantic.unit(F.col("e"))).alias("s")).groupBy("query_id", "chunk_id").agg(F.max("s").alias("score"))
    assert key(lexical.top(cross, 5, ["query_id"])) == key(semantic.dense(w, q))


def test_merge_intervals_touching(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 8, 9)], "page int, left int, right int")
    assert sorted((r.left, r.right) for r in layout.merge_intervals(df, "page").collect()) == [(0, 6), (8, 9)]


BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


def test_nfkc(spark):
    assert _one(spark, "ﬁ\u00a0 ２", T.normalized) == "fi 2" and _one(spark, None, T.normalized) is None


def test_table_parts(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [[("Method", box), ("Score", box)]] + [[("Group", None), ("", None)] if i == 6 else [(f"Variant-{i}", box), (str(100 + i), box)] for i in range(20)]
    ddl = f"id string, text string, caption string, rows array<array<struct<text:string,bbox:{BOX}>>>"
    df = spark.createDataFrame([("t", "X" * 1500, "Table 8. Comparison", rows), ("u", "short", None, rows[:2])], ddl)
    out = chunking.table_parts(df, 180).collect()
    assert [r.text for r in out if r.id == "u"] == ["short"]
    parts = sorted((r for r in out if r.id == "t"), key=lambda r: r.part)
    assert len(parts) > 1 and all(len(p.text) <= 180 and p.text.endswith("\nTable 8. Comparison") and p.rows[0][0].text == "Method" for p in parts)
    body = [c[0].text for p in parts for c in p.rows[1:]]
    carried = [i for i, t in enumerate(body) if t == "Group"]
    assert len(carried) > 1 and [t for i, t in enumerate(body) if i not in carried[1:]] == [r[0][0] for r in rows[1:]]


def test_gutter_needs_support(spark):
    words = [(d, 1, line, float(x), float(x + 35)) for d in ("a", "b") for line in range(12) if d == "a" or line < 5 for x in (50, 100, 150, 200, 250, 320, 370, 420, 470)]
    assert [tuple(r) for r in layout.gutters(spark.createDataFrame(words, "document_id string, page int, line int, x0 double, x1 double"), 612.0).collect()] == [("a", 1, 302.5)]


def test_grids_glyphs_and_columns(spark):
    grid = lambda rows: [[(t, None) for t in r] for r in rows]
    g = spark.createDataFrame([(1, grid([["60", "", "", ""], ["", "", "", ""], ["80", "", "", "graph"]])), (2, grid([["a", "b"], ["c", None]]))], f"id int, rows array<array<struct<text:string,bbox:{BOX}>>>")
    assert [r.id for r in layout.accepted_grids(g).collect()] == [2]
    glyphs = spark.createDataFrame([(d, 1, x, x + 2, 0.0, 2.0) for d in ("a", "b") for x in (0.0, 20.0)], "document_id string, page int, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([("a", 1, (0.0, 0.0, 10.0, 10.0))], f"document_id string, page int, box {BOX}")
    assert sorted((r.document_id, r.x0) for r in layout.outside(glyphs, boxes).collect()) == [("a", 20.0), ("b", 0.0), ("b", 20.0)]
    assert spark.range(1).select(layout.column_of(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2.0))).first()[0] == 2


def test_evidence_and_bound_cells(spark):
    chunks = spark.createDataFrame([(1, "d", 2, "The method achieves 91.2% accuracy.", [(0.0, 0.0, 100.0, 20.0)])], f"chunk_id int, document_id string, page int, text string, boxes array<{BOX}>")
    inside, away = (10.0, 5.0, 20.0, 10.0), (500.0, 500.0, 510.0, 510.0)
    rows = [(1, "d", 2, "91.2%  accuracy", inside), (2, "d", 1, "91.2%", inside), (3, "d", 2, "91.2%", away), (4, "d", 2, "99.2%", inside), (5, "other", 2, "91.2%", inside)]
    gold = spark.createDataFrame(rows, f"gold_id int, document_id string, page int, quote string, bbox {BOX}")
    assert [r.gold_id for r in evaluation.has_evidence(chunks, gold).collect()] == [1]
    cells = spark.createDataFrame([("t", "17.4", "Encoder", "Score", (0.0, 0.0, 100.0, 20.0), "Encoder Small 17.4")], f"chunk_id string, value string, row_label string, column_label string, box {BOX}, row_text string")
    want = [(1, "t", "17. 4", "Encoder", "Score", inside, None), (2, "t", "17.4", "Other", "Score", inside, None), (3, "t", "１７.4", "Encoder", "Score", inside, "Small"), (4, "t", "17.4", "Encoder", "Score", inside, "Large"), (5, "u", "17.4", "Encoder", "Score", inside, None)]
    want = spark.createDataFrame(want, f"gold_id int, chunk_id string, value string, row_label string, column_label string, bbox {BOX}, row_context string")
    assert sorted(r.gold_id for r in evaluation.bound_cells(cells, want).collect()) == [1, 3]
    by_page = evaluation.evidence_recall(spark.createDataFrame([(0, "d", 2, "９1.2%"), (0, "d", 1, "91.2%")], "query_id int, document_id string, page int, quote string"), spark.createDataFrame([(0, 1)], "query_id int, chunk_id int"), chunks, by_page=True).first()
    assert (by_page.recall, by_page.n_gold) == (0.5, 2)


def test_answers_parse(spark):
    raw = spark.createDataFrame([(1, '{"abstain":true,"claims":[]}'), (2, '{"abstain":"false","claims":[]}'), (3, '{"abstain":false,"claims":[]}'), (4, '{"abstain":false,"claims":[{"text":"x"}]}'), (5, "no json"), (6, None)], "query_id int, answer string")
    assert {r.query_id: r.reason for r in answering.parse_answers(raw).collect()} == {1: "abstained", 2: "malformed", 3: "malformed", 4: None, 5: "malformed", 6: "malformed"}


def test_retrieve_modes(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox"), (2, 1, "blue sky")], "chunk_id long, document_id long, text string")
    q, w = spark.createDataFrame([(0, "red")], "query_id long, question string"), spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    v = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, embedding array<float>")
    assert [r.chunk_id for r in semantic.retrieve(chunks, q, "hybrid", windows=w, vectors=v).orderBy("rank").collect()] == [1, 2]
    with pytest.raises(ValueError):
        semantic.retrieve(chunks, q, "dense")


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('url = "a"\nkey_variable = "K"\nthinking = true\n')
    s = settings.load_settings(str(f), {"QUILLON_URL": "b", "K": "secret"})
    assert (s.url, s.key, s.thinking) == ("b", "secret", True)
    f.write_text('thinking = "yes"')
    with pytest.raises(ValueError):
        settings.load_settings(str(f), {})


def test_gold_is_contained(spark, tmp_path):
    """Short passages, parts of lines and passages over several lines are gold; blank ones are not."""
    from quillon.plans import queries

    spark.createDataFrame([(1, "before. short one, after"), (2, "x first line\nsecond line y"), (3, "neither"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "short one"), (2, "first line\nsecond line"), (3, "absent"), (4, " "), (5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, queries._gold(spark, str(tmp_path)).collect())) == [(1, 1, "short one"), (2, 2, "first line\nsecond line")]
    recall = queries.QUERIES["evidence_recall"][0](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.n_gold) for r in recall) == [(1, 1), (2, 1)]


def test_headings_keep_every_line(spark, tmp_path):
    from quillon.plans import queries

    texts = {2: "only line", 3: "\n".join(f"line {i}" for i in range(60)), 4: "\n".join(f"line {i}" for i in range(50))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {k: [] for k in texts}
    for r in queries._sections(spark, str(tmp_path)).orderBy("document_id", "ord").collect():
        rows[r.document_id].append((r.kind, r.text))
    assert {k: "\n".join(t for kind, t in v if kind == "text") for k, v in rows.items()} == texts
    assert rows[2][0] == ("heading", "Abstract") and [i for i, (kind, _) in enumerate(rows[3]) if kind == "heading"] == [24, 50]
    chunks = "\n".join(r.text for r in chunking.pack(queries._sections(spark, str(tmp_path))).collect())
    assert sorted(chunks.split("\n")) == sorted("\n".join(texts.values()).split("\n"))
