r"""Quality rules: lines are labelled content or boilerplate by a linear-chain conditional random field.

A line's features are bins of the shares of letters, capitals, digits and symbols, of its length in
words, of its word length and end mark, and whether it repeats an earlier line or consists of
repeated five-word windows. The field has a weight per feature and label, a weight per pair of
neighbouring labels and one per first label; it is trained in numpy by Adam on the likelihood of at
most SAMPLE labelled documents (the least hashes of doc_id). A line is boilerplate in a document of
quality 0, and in one of quality 1 if it equals an earlier line there; all others are content. So
labels change within documents, and the weights of pairs learn from it. Sequences of one label, of
the other and of both weigh alike in all. Viterbi decoding labels the lines of every document; the share of words in content lines
decides: kept from SHARE on. The base rules come first: few words, or many repeated windows.

Nulls: a null text has no words and fails the base rules. Lines without a word carry no label.
Without labels of both kinds every line is content. A null doc_id is carried; repeated rows
give repeated results. Other columns are ignored. Very long documents are decoded whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._shared import Table, read

WINDOW, SAMPLE, LINES, EPOCHS, RATE, SHRINK, SHARE = 5, 4000, 64, 60, 0.05, 1e-3, 0.5
SYMBOL, UPPER, DIGIT, LETTER = (np.zeros(256, dtype=bool) for _ in range(4))
SYMBOL[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
DIGIT[48:58] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
BINS = {"symbols": (0.001, 0.02, 0.05, 0.1), "upper": (0.1, 0.3, 0.6), "digits": (0.001, 0.1, 0.3), "letters": (0.5, 0.7, 0.85), "words": (2, 5, 10, 20, 50), "length": (3, 5, 7, 10), "repeats": (0.01, 0.2, 0.5), "marks": (0.001, 0.05, 0.15)}
N = sum(len(b) + 1 for b in BINS.values()) + 3


class Lines:
    """Counts of a block's documents, and the lines that hold a word: document, words, features."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        docs = len(offs) - 1
        starts, ends, first = _text.words(data, offs)
        h = _text.hashes(data, starts, ends)
        chars = (data & 0xC0) != 0x80  # one for each code point
        per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
        self.n_words, self.word_chars, self.n_symbols = np.diff(first), per(chars & ~_text.SPACE[data]), per(SYMBOL[data])
        twice = self._repeated(h, first)
        self.n_repeat_words = np.diff(np.concatenate([[0], np.cumsum(twice)])[first])
        # lines end at newlines and where documents end
        cut = np.unique(np.concatenate([offs[:-1], np.flatnonzero(data == 10) + 1]))
        cut = cut[cut < len(data)]
        stop = np.append(cut[1:], len(data))
        stop = np.where(data[np.maximum(stop - 1, 0)] == 10, stop - 1, stop) if len(cut) else stop[:0]
        lo, hi = np.searchsorted(starts, cut), np.searchsorted(starts, stop)
        some = hi > lo
        cut, stop, lo, hi = cut[some], stop[some], lo[some], hi[some]
        self.doc, self.words = np.searchsorted(offs, cut, side="right") - 1, hi - lo
        key = _text.hashes(data, cut, stop)
        order = np.lexsort((cut, key, self.doc))
        k, d = key[order], self.doc[order]
        dup = np.zeros(len(cut), dtype=bool)
        dup[order[1:]] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        self.n_dup_lines = np.bincount(self.doc[dup], minlength=docs)
        size = np.maximum(stop - cut, 1)
        within = lambda mask, a=cut, b=stop: (s := np.concatenate([[0], np.cumsum(mask)]))[b] - s[a]
        letters = within(LETTER[data])
        shares = {
            "symbols": within(SYMBOL[data]) / size, "upper": within(UPPER[data]) / np.maximum(letters, 1), "digits": within(DIGIT[data]) / size, "letters": letters / size,
            "words": self.words, "length": size / self.words, "repeats": (np.concatenate([[0], np.cumsum(twice)])[hi] - np.concatenate([[0], np.cumsum(twice)])[lo]) / self.words, "marks": within(data == 33) / size,
        }
        x = np.zeros((len(cut), N), dtype=np.float32)
        at = 0
        for name, bins in BINS.items():
            x[np.arange(len(cut)), at + np.searchsorted(bins, shares[name], side="right")] = 1
            at += len(bins) + 1
        x[:, at], x[:, at + 1], x[:, at + 2] = 1, dup, np.isin(data[stop - 1], list(b".!?:;")) if len(cut) else 0
        self.x = x

    @staticmethod
    def _repeated(h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which words lie in a window of five words that the document has twice or more."""
        out = np.zeros(len(h), dtype=bool)
        if len(h) < WINDOW:
            return out
        w = h[: len(h) - WINDOW + 1] * np.uint64(_text.MIX[0])
        for j in range(1, WINDOW):
            w = w + h[j : len(h) - WINDOW + 1 + j] * np.uint64(_text.MIX[j])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.flatnonzero(doc[: len(w)] == doc[WINDOW - 1 :])
        w = _text.mix(w[at])
        order = np.lexsort((w, doc[at]))
        same = (w[order][1:] == w[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        hit = np.zeros(len(at), dtype=bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        mark = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(mark, at[hit], 1)
        np.add.at(mark, at[hit] + WINDOW, -1)
        return np.cumsum(mark)[:-1] > 0


class Field:
    """A linear-chain field of two labels (1: content): emission (N, 2), pair (2, 2), start (2)."""

    def __init__(self, emission: np.ndarray, pair: np.ndarray, start: np.ndarray):
        self.emission, self.pair, self.start = emission, pair, start

    def decode(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi labels of lines in order; all documents advance a line at a time together."""
        score = x @ self.emission
        n = len(score)
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, n))
        back = np.zeros((n, 2), dtype=np.int8)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        v = self.start + score[begin]
        for t in range(1, int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, side="left"))
            via = v[:live, :, None] + self.pair
            back[begin[:live] + t] = via.argmax(axis=1)
            v[:live] = via.max(axis=1) + score[begin[:live] + t]
        label = np.zeros(n, dtype=np.int8)
        if n:
            label[begin + length - 1] = v.argmax(axis=1)
        for t in range(int(length.max(initial=0)) - 1, 0, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            at = begin[:live] + t
            label[at - 1] = back[at, label[at]]
        return label


def line_labels(quality: int, x: np.ndarray) -> np.ndarray:
    """Training labels of a document's lines: its quality, but 0 for a line that equals an earlier one."""
    return np.where(x[:, N - 2] > 0, 0, quality)


def fit(rows: list[tuple[int, np.ndarray]]) -> Field:
    """Trains on (quality, line features) of documents, at most LINES lines a sequence."""
    seqs = [(q, x[i : i + LINES]) for q, x in rows for i in range(0, len(x), LINES)]
    if len({q for q, _ in seqs}) < 2:
        bias = np.zeros((N, 2))
        bias[N - 3, 1] = 1
        return Field(bias, np.zeros((2, 2)), np.zeros(2))
    m, most = len(seqs), max(len(x) for _, x in seqs)
    x, mask, q = np.zeros((m, most, N), dtype=np.float32), np.zeros((m, most), dtype=bool), np.array([s[0] for s in seqs])
    y = np.zeros((m, most), dtype=np.int8)
    for i, (own, f) in enumerate(seqs):
        x[i, : len(f)], mask[i, : len(f)], y[i, : len(f)] = f, True, line_labels(own, f)
    params = [np.zeros((N, 2)), np.zeros((2, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    kind = np.where(q == 1, np.where((y == 1) | ~mask, 2, 1).min(axis=1), 0)  # all boilerplate, mixed, all content
    count = np.bincount(kind, minlength=3)
    balance = (m / np.count_nonzero(count) / np.maximum(count, 1))[kind]
    rng, step, batch = np.random.default_rng(5), 0, 256
    for _ in range(EPOCHS):
        order = rng.permutation(m)
        for k in range(0, m, batch):
            at = order[k : k + batch]
            grads = _gradient(x[at], mask[at], y[at], balance[at], *params)
            step += 1
            for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
                g = g + SHRINK * p
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Field(*params)


def _gradient(x, mask, y, weight, emission, pair, start):
    """Of the mean weighted negative log-likelihood of label sequences y (n, lines), by forward-backward."""
    n, most = mask.shape
    most = int(mask.sum(axis=1).max())
    x, mask, y = x[:, :most], mask[:, :most], y[:, :most]
    s = x @ emission
    a, b = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    a[:, 0] = start + s[:, 0]
    for t in range(1, most):
        step = np.logaddexp(a[:, t - 1, :1] + pair[0], a[:, t - 1, 1:] + pair[1]) + s[:, t]
        a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
    for t in range(most - 2, -1, -1):
        nxt = s[:, t + 1] + b[:, t + 1]
        step = np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:])
        b[:, t] = np.where(mask[:, t + 1, None], step, 0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    w = weight[:, None, None] / n
    post = np.exp(a + b - z[:, None, None]) * mask[..., None]
    gold = np.eye(2)[y] * mask[..., None]
    diff = (post - gold) * w
    ge = np.einsum("ntf,ntc->fc", x, diff)
    both = mask[:, 1:]
    e = np.exp(a[:, :-1, :, None] + pair + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None] * w[..., None]
    gp = e.sum(axis=(0, 1))
    np.subtract.at(gp, (y[:, :-1], y[:, 1:]), both * w[:, 0])
    return ge, gp, diff[:, 0].sum(axis=0)


def _features(batches):
    for batch in batches:
        rows = []
        for i, j, data, offs in _text.blocks(batch.column("text")):
            lines = Lines(data, offs)
            cut = np.searchsorted(lines.doc, np.arange(j - i + 1))
            rows += [np.packbits(lines.x[cut[d] : cut[d + 1]].astype(bool), axis=1).tobytes() for d in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(rows, pa.binary())], ["quality", "lines"])


def train(docs: DataFrame, labels: DataFrame) -> Field:
    known = labels.where("quality is not null").select("doc_id", "quality")
    known = Table(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE), "sample").df
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text").mapInArrow(_features, "quality int, lines binary")
    width = (N + 7) // 8
    rows = sorted((r[0], bytes(r[1])) for r in joined.collect())
    return fit([(int(y), np.unpackbits(np.frombuffer(b, dtype=np.uint8).reshape(-1, width), axis=1)[:, :N].astype(np.float32)) for y, b in rows if b])


def _judge(batches, field: Field):
    for batch in batches:
        parts = []
        for i, j, data, offs in _text.blocks(batch.column("text")):
            x = Lines(data, offs)
            good = x.words * field.decode(x.x, x.doc)
            content = np.bincount(x.doc, good, j - i)
            failed = (x.n_words < 10) | (100 * x.n_repeat_words > 20 * x.n_words)
            share = content / np.maximum(x.n_words, 1)
            parts.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, ~failed & (share >= SHARE), share))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 8
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip((c.astype(k) for c, k in zip(cols, ["i8"] * 5 + ["?"] * 2 + ["f8"], strict=True)), types, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, counts, base_failed, kept, content_share, a row per row."""
    field = train(docs, labels)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select("doc_id", "text").mapInArrow(partial(_judge, field=field), ddl)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
