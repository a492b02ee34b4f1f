"""Quality rules, HTML text and benchmark windows against plain Python."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from quillon.llm import decontaminate, html, quality

rng = random.Random(21)
VOCAB = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def _odd_text():
    """Lines of words, symbols and white space, some of them again, with windows that repeat."""
    lines = [" ".join(rng.choice([*VOCAB[:8], "#a*", "$%&", "<b>", "|"]) for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", "\t", "\r"]) for _ in range(rng.randint(1, 8))]
    return "\n".join(lines + rng.sample(lines, rng.randint(0, len(lines))))


def _base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(twice) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), failed


def test_base_counts_equal_plain_python(spark):
    rows = [(i, _odd_text()) for i in range(300)] + [(300, None), (301, ""), (302, " \n\t"), (303, "a b c d e " * 4000), (None, _text(30)), (304, _text(40)), (304, _text(40)), (305, "\n\n" + "x\n" * 30)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    out = quality.quality(d, labels).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted((str(i), *_base(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in out)


def test_viterbi_equals_all_paths():
    g = np.random.default_rng(3)
    field = quality.Field(g.normal(size=(quality.N, 2)), g.normal(size=(2, 2)), g.normal(size=2))
    length = [1, 7, 3, 9, 2]
    x, doc = g.random((sum(length), quality.N)), np.repeat(np.arange(5), length)
    got, at = field.decode(x, doc), 0
    for n in length:
        s = x[at : at + n] @ field.emission
        worth = lambda p: field.start[p[0]] + sum(s[t, c] for t, c in enumerate(p)) + sum(field.pair[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert tuple(got[at : at + n]) == max(product((0, 1), repeat=n), key=worth)
        at += n


def test_gradient_equals_differences():
    """Of sequences whose labels change, with the likelihood summed over all paths."""
    g = np.random.default_rng(4)
    length = [4, 1, 3]
    x, mask, y = g.random((3, 4, quality.N)), np.arange(4) < np.array(length)[:, None], g.integers(0, 2, (3, 4)).astype(np.int8)
    weight, params = np.array([0.5, 2.0, 1.0]), [g.normal(0, 0.5, (quality.N, 2)), g.normal(size=(2, 2)), g.normal(size=2)]

    def loss():
        emission, pair, start = params
        total = 0.0
        for i, n in enumerate(length):
            s = x[i, :n] @ emission
            worth = {p: start[p[0]] + sum(s[t, c] for t, c in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product((0, 1), repeat=n)}
            total += weight[i] / 3 * (np.log(sum(np.exp(v) for v in worth.values())) - worth[tuple(y[i, :n].tolist())])
        return total

    for p, grad in zip(params, quality._gradient(x, mask, y, weight, *params), strict=True):
        for at in [tuple(int(g.integers(0, n)) for n in p.shape) for _ in range(6)]:
            old, step = p[at], 1e-5
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6


def test_field_learns_label_changes():
    """Two states that no feature of a line tells at once: the pair weights hold them apart."""
    rows = []
    for _ in range(300):
        q = rng.randint(0, 1)
        x = np.zeros((12, quality.N), dtype=np.float32)
        x[:, quality.N - 3] = 1
        x[:, 0 if q else 1] = 1
        if q:
            x[6, quality.N - 2] = 1
        rows.append((q, x))
    assert {int(v) for q, x in rows if q for v in quality.line_labels(q, x)} == {0, 1}
    field = quality.fit(rows)
    label = [field.decode(x, np.zeros(len(x), dtype=int)).tolist() for _, x in rows]
    assert label == [[int(q and t != 6) for t in range(12)] for q, _ in rows]


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_near_windows_are_found(spark, edits):
    """Every pair that a brute force over windows of the item's length puts clearly above 0.8, and none below it."""
    items = [(i, _text(n)) for i, n in enumerate([30, 60, 61, 90])]
    rows = [(None, None), (1000, ""), (1001, items[0][1]), (1002, _text(4)), (1003, " ".join(items[1][1].split()[:-2]))]
    for i in range(40):
        words = rng.choice(items)[1].split()
        for k in rng.sample(range(len(words)), edits):
            words[k] = "zz" + rng.choice(VOCAB)
        rows.append((i // 2, f"{_text(rng.randint(0, 30))} {' '.join(words)} {_text(rng.randint(0, 30))}"))
    rows += [(2000 + i, _text(150)) for i in range(20)]

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    def best(text, item):
        w, own = WORD.findall((text or "").lower()), item.lower().split()
        sims = [0.0]
        for s in range(max(1, len(w) - len(own) + 1)) if w else ():
            a, b = bag(w[s : s + len(own)]), bag(own)
            least = (a & b).total()
            sims.append(least / (a.total() + b.total() - least))
        return max(sims)

    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string").repartition(3)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in rows:
        for k, item in items:
            if (sim := best(t, item)) >= 0.8:
                want[i, k] = max(want.get((i, k), 0.0), sim)
    assert set(got) <= set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    assert {k for k, v in want.items() if v >= 0.85} <= set(got)


def test_html_rows(spark):
    """Nulls, repeated rows, extra columns and ragged tables; a row per row."""
    ragged = "<table><tr><td>a<td>bb<td>c<tr><td>long cell<tr><td colspan=2>x<td>y</table>"
    rows = [(1, "u", ragged), (1, "u", ragged), (None, None, "<p>n"), (2, "u", None), (3, "u", ""), (4, "u", "<p>" * 5000 + "end"), (5, "u", "<table><tr><td>1"), (6, "u", "<ul><li>a<ul><li>b</ul><li>c</ul>")]
    out = html.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)).collect()
    got = sorted((str(r.page_id), str(r.url), r.text) for r in out)
    table = "a         | bb | c\nlong cell\nx         |    | y"
    assert got == sorted([("1", "u", table), ("1", "u", table), ("None", "None", "n"), ("2", "u", ""), ("3", "u", ""), ("4", "u", "end"), ("5", "u", "1"), ("6", "u", "- a\n  - b\n- c")])
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
