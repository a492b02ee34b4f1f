"""The methods themselves: groups, hot keys, disk paths and rows of equal or null ids, against plain Python."""

import math
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

from quillon.llm import decontaminate, induced, minhash, pii, suffixdedup, toxicity

rng = random.Random(8)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]


def _text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def _edited(text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "x" + "".join(rng.choice("klmnop") for _ in range(6))
    return " ".join(words)


def _near_rows():
    """A large group of near copies of varied distance, chains, a common line, copies and short texts."""
    base, line = _text(120), _text(25)
    rows = [_edited(base, rng.randint(0, 8)) for _ in range(160)]
    chain = [_text(100)]
    for _ in range(8):
        chain.append(_edited(chain[-1], 3))
    rows += chain + [f"{line}\n{_text(rng.randint(5, 40))}" for _ in range(60)] + [base] * 5 + ["two words", "Two  words", "", None]
    return list(enumerate(rows))


def _components(rows, k):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_copies_equal_brute_force(spark):
    rows = _near_rows()
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=4).collect()
    assert {r.doc_id: r.component_id for r in out} == _components(rows, 4)


def test_one_row_of_each_group_stays(spark):
    """Rows are judged, not ids: other texts of an id stay, of equal rows one stays, null ids come last."""
    a, b, c = _text(50), _text(50), _text(50)
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (2, a, "y"), (2, _edited(a, 1), "y"), (3, c, "p"), (3, c, "q"), (None, b, "z"), (None, None, "z"), (None, "", "z"), (4, None, "z")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _hash string")).collect()))
    assert got == sorted([(False, 1, a), (False, 1, b), (False, 3, c), (True, 0, ""), (True, 0, ""), (False, 4, "")])


@pytest.mark.parametrize("hot", [0, 1 << 13])
def test_repeats_and_passages_equal_brute_force(spark, monkeypatch, hot):
    """With every mixed anchor hot and with none, and with the sorter's queue on disk."""
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    if not hot:
        monkeypatch.setattr(induced, "MEMORY", 50)
    length, k, words = 60, 12, 12
    shared = [_text(30) for _ in range(4)]
    rows = [(i, " ".join([_text(rng.randint(0, 20)), rng.choice(shared)[rng.randint(0, 60) :], _text(rng.randint(0, 20))])) for i in range(60)]
    rows += [(60, shared[0] + " " + shared[0]), (61, None), (62, ""), (63, "é" * 80), (64, rows[0][1]), (64, rows[0][1]), (None, _text(30))]
    out = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length, k, words).collect()
    at, held = defaultdict(set), defaultdict(set)
    for n, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            at[raw[p : p + length]].add((n, p))
        w = (t or "").split()
        for p in range(len(w) - words + 1):
            held[tuple(w[p : p + words])].add((i, t))
    want = []
    for i, t in rows:
        raw, gone = (t or "").encode(), set()
        for p in range(len(raw) - length + 1):
            if len(at[raw[p : p + length]]) > 1:
                gone.update(range(p, p + length))
        w = (t or "").split()
        want.append((str(i), len(raw), len(gone), any(len(held[tuple(w[p : p + words])]) > 1 for p in range(len(w) - words + 1))))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.shares_passage) for r in out) == sorted(want)


def test_bootstrap_equals_plain_python(spark):
    edges = {(rng.randint(1, 12), rng.randint(1, 40)) for _ in range(160)}
    seeds = {i: rng.choice((0, 4)) for i in range(1, 41) if rng.random() < 0.5}
    rows = [(p, i, seeds.get(i)) for p, i in edges for _ in range(rng.randint(1, 2))]
    got = {(r.pattern, r.kind): round(r.confidence, 6) for r in pii.bootstrap(spark.createDataFrame(rows, "pattern long, instance long, seed int")).collect()}
    of = defaultdict(set)
    for p, i in edges:
        of[p].add(i)
    score = {(i, k): 1.0 for i, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        conf = {(p, k): sum(score.get((i, k), 0) for i in of[p]) / len(of[p]) for p in of for k in (0, 4) if sum(seeds.get(i) == k for i in of[p]) >= pii.MIN_SEEDS}
        new = {(i, k): 1.0 for i, k in seeds.items()}
        for (p, k), c in conf.items():
            if c >= pii.LEAST:
                for i in of[p]:
                    if seeds.get(i) != k:
                        new[i, k] = 1 - (1 - new.get((i, k), 0.0)) * (1 - min(c, 0.999))
        score = new
    want = {key: round(c, 6) for key, c in conf.items() if round(c, 9) >= pii.MIN_CONF}
    assert want and got == want and all(math.isfinite(c) for c in got.values())


def test_secrets_that_no_rule_describes(spark):
    """Seeds teach a name and a pair of words; values of another form after them are found, elsewhere not."""
    digest = lambda: "".join(rng.choice("0a1b2c3d4e5f") for _ in range(20)) + "a1b2c3d4"
    rows = [(i, f"{_text(5)} pass={digest()} and then key is {digest()} {_text(5)}") for i in range(12)]
    rows += [(100, "so pass=short7 here"), (101, "the key is plain55 now"), (102, "room 55 and page=7 only"), (103, "pass=short7"), (104, None)]
    out = pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: [rows_text[s.start : s.stop] for s in r.spans if s.kind == pii.SECRET] for r in out if (rows_text := dict(rows)[r.doc_id] or "") is not None}
    assert found[100] == ["short7"] and found[101] == ["plain55"] and found[103] == ["short7"]
    assert found[102] == [] and found[104] == [] and all(len(found[i]) == 2 for i in range(12))


def test_terms_that_tell_only_together(spark):
    rows = []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(VOCAB) for _ in range(15)] + ["insult" if a else "praise", "they" if b else "myself"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.toxicity(d.select("doc_id", "text"), d.select("doc_id", "toxic")).where("held_out").collect()
    right = sum(r.predicted == rows[r.doc_id][2] for r in out)
    assert right >= 0.95 * len(out)


def test_leaks_go_by_row(spark, tmp_path):
    item, other = _text(80), _text(30)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = _edited(item, 1)
    rows = [(1, f"{_text(20)} {item} {_text(20)}"), (1, other), (None, f"{near} {_text(9)}"), (None, other), (2, None), (3, ""), (4, f"{_edited(item, 50)}"), (5, item), (5, item)]
    out = decontaminate.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in out) == sorted([("1", other), ("None", other), ("2", ""), ("3", ""), ("4", rows[6][1])])


def test_workers_need_no_copy(tmp_path):
    """From another folder, without PYTHONPATH, only the driver can import the package."""
    repo = Path(__file__).resolve().parents[2]
    code = f"""
import sys; sys.path.insert(0, {str(repo)!r})
from pyspark.sql import SparkSession
from quillon.llm import lm, minhash, quality, suffixdedup, toxicity
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
d = s.createDataFrame([(i, "some words of text number %d" % i) for i in range(20)], "doc_id long, text string")
l = s.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
for out in (lm.score_texts(d), minhash.near_duplicates(d), quality.quality(d, l), toxicity.toxicity(d, l), suffixdedup.remove_repeats(d, 20, 5)):
    assert out.count() == 20
    assert len(out.collect()) == 20
print("whole")
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert got.stdout.strip().endswith("whole"), got.stderr[-2000:]
