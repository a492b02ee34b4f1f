"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, html, induced, linededup, lm, minhash, mixing, pii, quality, suffixdedup, toxicity

rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(400)]


def _text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = _text(120)
EDIT = BASE.split()
EDIT[60] = "changed"
ROWS = [(1, None, "s"), (2, "", "s"), (3, BASE, "a"), (4, BASE, None), (5, " ".join(EDIT), "b"), (6, _text(60), "a"), (7, "two words", "b"), (8, "two words", "a"), (None, _text(30), "a"), (9, _text(3000), "b"), (10, BASE[:300] + "\n" + _text(200), "a"), (9, _text(50), "b"), (11, " \n\t", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", 0, "clash") for r in ROWS], "doc_id long, text string, source string, lang string, n_chars long, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, 1, 0), (9, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")


def test_minhash(docs, empty):
    out = minhash.near_duplicates(docs, k=4).collect()
    assert len(out) == len(ROWS)
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id in (3, 4, 5)} == {(3, 3), (4, 3), (5, 3)}
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id in (7, 8)} == {(7, 7), (8, 7)}
    assert all(r.n_shingles == 0 and r.kept for r in out if r.doc_id in (1, 2, 11))
    assert minhash.near_duplicates(empty, k=4).count() == 0


def test_suffix_array():
    for _ in range(200):
        t = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdefg") for _ in range(rng.randint(1, 70))) * rng.choice((1, 1, 3))
        sa, lcp = induced.suffix_array(t)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert list(sa) == want
        for i in range(1, len(t)):
            a, b = t[want[i - 1] :], t[want[i] :]
            assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeats(docs, empty):
    length, got = 40, {}
    for r in suffixdedup.remove_repeats(docs, length, 8).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.kept_sha256))
    texts = [(i, (t or "").encode()) for i, t, _ in ROWS]
    count = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    want = {}
    for i, t in texts:
        gone = set()
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone |= set(range(k, k + length))
        want.setdefault(i, []).append((len(t), len(gone), hashlib.sha256(bytes(c for k, c in enumerate(t) if k not in gone)).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_lines(spark, empty):
    rows = [(i, f"own line of number {i}\nshared words by all\nshort", f"site{i % 4}") for i in range(8)] + [(99, None, None), (None, "shared words by all", "site9")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: (r.text, r._n_removed) for r in linededup.dedup_lines(d, sites=3).collect()}
    assert out[0] == ("own line of number 0\nshared words by all\nshort", 0)
    assert out[5] == ("own line of number 5\nshort", 1) and out[99] == (None, 0) and out[None][1] == 1
    assert linededup.dedup_lines(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = {}
    for r, (_, t, s) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.size)), sorted(ROWS, key=lambda r: (r[0] is None, r[0], len((r[1] or "").split()))), strict=True):
        assert r.size == len((t or "").split()) and r.taken <= 2 * r.size
        size[s] = size.get(s, 0) + r.size
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, budget = {}, set(order), 1.5 * sum(size.values())
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * size[s]
            budget -= want[s]
        left -= over
    assert {round(r.target, 6) for r in rows} <= {round(x, 6) for x in want.values()}
    assert mixing.mix(empty).count() == 0


def test_pii(spark, empty):
    rows = [(1, "mail a@b.com@c.org, ip 1.2.3.4.5 and 300.1.1.1"), (2, None), (3, "card 4111 1111 1111 1111 and +1 (743) 555-3824"), (4, "x" * 50_000 + "1" * 50_000), (5, "ünï 😀 q@w.de")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.extract(d).collect()}
    spans = {k: [(s.start, s.kind, s.stop) for s in v.base] for k, v in out.items()}
    assert spans[1] == [(5, 0, 12), (23, 1, 30)] and spans[2] == [] and spans[4] == []
    assert spans[3] == [(5, 2, 24), (29, 3, 46)] and spans[5] == [(6, 0, 12)]
    assert pii.extract(empty).count() == 0


def test_pii_context(spark):
    """Words around a candidate come from the whole text: other candidates and long words too."""
    long = "x" * 200
    d = spark.createDataFrame([(1, "Call 020 7946\t0018 now"), (2, f"a {long} q@w.de {long}"), (3, "7"), (4, " no ")], "doc_id long, text string")
    got = {r.doc_id: [(c.value, c.far, c.near, c.next) for c in r.candidates] for r in pii.found_spans(d).collect()}
    assert got[1] == [("020", "", "call", "0000"), ("7946", "call", "000", "0000"), ("0018", "000", "0000", "now")]
    assert got[2] == [("q@w.de", "a", long, long)] and got[3] == [("7", "", "", "")] and got[4] == []


def test_leaks(spark, docs, empty):
    item = " ".join(ROWS[9][1].split()[1000:1040])
    b = spark.createDataFrame([(1, item), (2, _text(30)), (3, None), (4, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start, r.similarity) for r in decontaminate.leaks(docs, b).collect()] == [(9, 1, 1000, 1.0)]
    assert decontaminate.leaks(empty, b).count() == 0 and decontaminate.leaks(docs, b.where("false")).count() == 0


def test_toxicity(spark, docs, labels, empty):
    rows = [(i, _text(20) + (" badword stuff" if i % 3 == 0 else "")) for i in range(300)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = toxicity.toxicity(d, l).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.toxicity(docs, labels).count() == len(ROWS) and toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).where("score > 0.5").count() == 0


def test_quality(docs, labels, empty):
    out = quality.quality(docs, labels).collect()
    assert len(out) == len(ROWS) and all(r.base_failed and not r.kept for r in out if r.n_words < 10)
    assert quality.quality(empty, labels).count() == 0 and quality.quality(docs, labels.where("false")).count() == len(ROWS)


def test_lm(docs, empty):
    out = lm.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(i, (t or "").encode().lower().split() + [None]) for i, t, _ in ROWS]
    c = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = c.total(), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score <= 0 and r.train_tokens == n for r in out)
    assert lm.score_texts(empty).count() == 0


def test_lm_trains_on_all(docs, monkeypatch):
    """Every id and end of every training document is a target of the attention once."""
    seen = []

    class Held(lm.Table):
        def __init__(self, df, name):
            super().__init__(df, name)
            if name == "local":
                seen.extend(r.weight for r in self.df.collect())

    monkeypatch.setattr(lm, "Table", Held)
    lm.score_texts(docs).count()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = sum(len(lm.spell((t or "").lower().encode().split(), lm.tokenizer_path())[0]) + 1 for i, t, _ in ROWS if not held(i))
    assert sum(seen) == want


def test_lm_attention():
    """Windows and masks against attention over each text alone, and the gradient against differences."""
    rng_ = np.random.default_rng(1)
    length = np.array([1, 40, 3, 70])
    read, target = rng_.integers(0, 50, length.sum()).astype(np.int32), rng_.integers(0, lm.CLASSES, length.sum()).astype(np.int8)
    doc = np.repeat(np.arange(4, dtype=np.int32), length)
    table = rng_.normal(0, 0.5, (lm.IDS + 1, lm.DIM)).astype(np.float32)
    params = [rng_.normal(0, 0.3, p.shape).astype(np.float32) for p in lm.initial(np.zeros((lm.DIM, lm.CLASSES), np.float32), np.zeros(lm.CLASSES, np.float32))]
    model, grads = lm.Model({"table": table}), []
    logp, opens = lm._run(model, params, lm.Stream(read, target, doc), lambda e, total, inner, live: grads.append(lm.gradient(e, total, inner, live, params)))
    wq, wk, wv, place, wo, bo = params
    begin = np.cumsum(length) - length
    for j in range(len(read)):
        block, at = divmod(j, lm.STRIDE)
        back = np.arange(max((block - 1) * lm.STRIDE, begin[doc[j]], 0), j + 1)
        x = table[read]
        s = (x[j] @ wq) @ (x[back] @ wk).T / lm.DIM**0.5 + place[at, back - (block - 1) * lm.STRIDE]
        a = np.exp(s - s.max())
        z = np.concatenate([x[j], (a / a.sum()) @ (x[back] @ wv)]) @ wo + bo
        z -= np.log(np.exp(z).sum())
        assert abs(z[target[j]] - logp[j]) < 1e-4 and abs(np.log(np.exp(z[: lm.CLASSES // 2]).sum()) - opens[j]) < 1e-4
    loss = lambda: -float(lm._run(model, params, lm.Stream(read, target, doc))[0].astype(np.float64).mean())
    for p, g in zip(params, grads[0], strict=True):
        for at in zip(*(rng_.integers(0, n, 5) for n in p.shape), strict=True):
            old = p[at]
            p[at] = old + 0.05
            up = loss()
            p[at] = old - 0.05
            down = loss()
            p[at] = old
            assert abs((up - down) / 0.1 - g[at]) < 2e-3

def test_html():
    page = "<title>t</title><p>A <b>b</b><br>c<p>d<ul><li>x<li>y</ul><table><caption>Cap<tr><th>H<th>Long<tr><td>1<td>2</table><div style='display:none'>no</div><script>'</p>'</script>e &amp; f"
    assert html.render(page) == "A b\nc\n\nd\n\n- x\n- y\n\nCap\nH | Long\n1 | 2\n\ne & f"
    assert html.render("") == "" and html.render("<div>" * 20_000 + "deep") == "deep"


def test_stages_with_clashing_names(spark, docs, tmp_path):
    """Every stage takes extra columns of any name, nulls and empty tables; all but the last keep the columns."""
    import corpus_pipeline

    names = ["_id", "_keys", "_n_removed", "_row", "_hash", "_source", "source_size", "target", "times", "copies", "component_id", "kept", "score", "site", "line", "node", "b"]
    wide = docs
    for n in names:
        wide = wide.withColumn(n, F.lit("clash"))
    spark.createDataFrame([(1, " ".join(ROWS[9][1].split()[:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (wide, wide.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == wide.columns if name != "mixing" else out.columns == [*wide.columns, "copies_"], name
            assert 0 <= out.count() <= table.count()
            assert out.where("times <> 'clash'").count() == 0
