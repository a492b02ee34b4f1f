"""Near-duplicate documents by HyperMinHash, banding and verification on full shingle sets.

Sketch: every shingle goes into each of 128 buckets under that bucket's own hash function; a bucket
keeps only the leading-zero count (6 bits) and the next 10 bits of its least hash, 16 bits in all.
Four consecutive registers form a band's key (32 bands), so a pair of similarity 0.8 shares no band
with probability (1 - 0.8^4)^32 = 5e-8, and accidental collisions only add candidates. A candidate
is dropped if its sizes rule the threshold out, or its collision-corrected estimate is below the
threshold by more than six standard deviations; all others are decided on the full sets.

Texts with equal shingle sets are one class and enter the search once. Within a band's bucket all
classes are compared with one of them, the hub: the class that meets the most others over all its
buckets, which in a group of near copies is the one closest to their common origin. Linked classes
merge. A bucket whose members are not all in its hub's component is mixed, and can still hide
links of its minor members, those outside the hub's component. These are found by an exact join:
over the members of mixed buckets, shingles are ordered from the rarest on, a link must have its
first common shingle within both sets' prefixes, and enough must remain of both sets after it.
Only a minor member is joined with others, and only across components. So a group of a thousand
near copies costs about a thousand comparisons, and every pair of a bucket ends in one component,
or compared, or ruled out by a bound.

Nulls: a null text is empty. An empty document has 0 shingles and links with nothing. A null
doc_id is carried along and never becomes a component_id unless all of a component are null.
Rows with the same doc_id are judged by their own texts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _text
from ._graph import components
from ._shared import Table, free, read

REGISTERS, BANDS, MANTISSA = 128, 32, 10
ROWS = REGISTERS // BANDS
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
#: Share of registers that collide by accident in equally large sets, times 2 to the mantissa bits.
COLLISION = 0.169919487159739093975315012348


def registers(h: np.ndarray) -> np.ndarray:
    """128 HyperMinHash registers of a set of 64-bit hashes (not empty)."""
    h = (h >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 256):
        np.minimum(least, ((h[i : i + 256] ^ _XOR) * _ODD).min(axis=0), out=least)
    bits = least.astype(np.float64).view(np.int64)
    zeros = np.where(least == 0, 32, 1054 - (bits >> 52))
    return (zeros << MANTISSA | bits >> (52 - MANTISSA) & ((1 << MANTISSA) - 1)).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers; n, m: set sizes."""
    ratio = np.maximum(n, m) / np.minimum(n, m)
    accident = COLLISION * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return ((a == b).mean(axis=1) - accident) / (1 - accident)


def _sets(text, k: int, lower: bool):
    """(row, sorted distinct shingle hashes) of every row."""
    for i, _, data, offs in _text.blocks(text):
        data = _text.LOWER[data] if lower else data
        starts, ends, first = _text.words(data, offs)
        h, at = _text.shingles(_text.hashes(data, starts, ends), first, k)
        for r in range(len(offs) - 1):
            s = np.sort(h[at[r] : at[r + 1]])
            yield i + r, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _key(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes(), usedforsecurity=False).digest()


def _sketch(batches, k: int, lower: bool):
    for batch in batches:
        n, key, regs = [], [], []
        for _, s in _sets(batch.column("text"), k, lower):
            n.append(len(s))
            key.append(_key(s))
            regs.append(registers(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "hash", "n_shingles", "key", "regs"])


def _full(batches, k: int, lower: bool):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sets = [s for _, s in _sets(part.column("text"), k, lower)]
            offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(offs), pa.array(values))], ["node", "shingles"])


def _likely(batches, least: float):
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(_text.utf8(b.column(c))[0], dtype=np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            ok = estimate(x, y, b.column("n_a").to_numpy(), b.column("n_b").to_numpy()) >= least
            yield b.select(["a", "b"]).filter(pa.array(ok))


def _linked(batches, num: int, den: int):
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            ok.append(den * same >= num * (len(x) + len(y) - same))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _buckets(classes: DataFrame) -> Table:
    """bucket, node, hub of every class that shares a bucket."""
    bands = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("band", "part")).select("node", F.xxhash64("band", "part").alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = Table(bands.join(sizes, "bucket"), "shared")
    meets = shared.df.groupBy("node").agg(F.sum("size").alias("meets"))
    hubs = shared.df.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node"))["node"].alias("hub"))
    out = Table(shared.df.join(hubs, "bucket").select("bucket", "node", "hub"), "buckets")
    shared.drop()
    return out


def _mixed(buckets: DataFrame, part: DataFrame) -> DataFrame:
    """node, component, minor of the members of mixed buckets."""
    hub = part.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    named = buckets.join(part, "node", "left").join(hub, "hub", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"), (F.coalesce("component", "node") != F.coalesce("main", "hub")).alias("minor"))
    mixed = named.where("minor").select("bucket").distinct()
    return named.join(mixed, "bucket", "left_semi").groupBy("node").agg(F.min("component").alias("component"), F.max("minor").alias("minor"))


def _prefix_pairs(sets: DataFrame, num: int, den: int) -> Table:
    """sets (node, component, minor, shingles) -> pairs (a, b) of different components, one of them
    minor, that a similarity of num / den does not rule out."""
    tokens = sets.select("node", "component", "minor", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("minor").alias("any")).where("df > 1").selectExpr("token", "df", "lo <> hi and any as open")
    own = Window.partitionBy("node")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1
    prefix = tokens.join(common, "token").withColumn("at", at).where(f"open and at <= n - ({num} * n + {den - 1}) div {den}")
    prefix = Table(prefix.select("token", "node", "component", "minor", "n", (F.col("n") - F.col("at")).alias("rest")), "prefix")
    x, y = prefix.df.where("minor").alias("x"), prefix.df.alias("y")
    enough = F.expr(f"least(x.rest, y.rest) >= ({num} * (x.n + y.n) + {num + den - 1}) div {num + den}")
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & F.expr("x.component <> y.component and (x.node < y.node or not y.minor)") & enough)
    out = Table(both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    prefix.drop()
    return out


def _labels(docs: DataFrame, k: int, num: int, den: int, lower: bool) -> Table:
    """doc_id, hash (of the text), n_shingles, component, least (the least doc_id of the component),
    own (of equal ids, the least hash), a row per row; component and the rest are null without shingles."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketch = Table(docs.mapInArrow(partial(_sketch, k=k, lower=lower), f"doc_id {kind}, hash long, n_shingles long, key binary, regs binary"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    classes = Table(sketch.df.where("n_shingles > 0").groupBy("key").agg(first.alias("rep"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs")).withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = _buckets(classes.df)
    need = buckets.df.select("node").distinct().join(classes.df.select("node", "rep"), "node").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.hash").alias("_hash"))
    texts = docs.join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("node", "text")
    full = Table(texts.mapInArrow(partial(_full, k=k, lower=lower), "node long, shingles array<long>").dropDuplicates(["node"]), "full")
    least = num / den - 6 * (num / den * (1 - num / den) / REGISTERS) ** 0.5
    side = lambda s: classes.df.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))

    def links(pairs: DataFrame) -> Table:
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
        likely = Table(sized.mapInArrow(partial(_likely, least=least), "a long, b long"), "likely")
        both = likely.df.join(full.df.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(full.df.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        out = Table(both.mapInArrow(partial(_linked, num=num, den=den), "a long, b long"), "links")
        likely.drop()
        return out

    found = links(buckets.df.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    part = components(found.df.select(F.col("a").alias("u"), F.col("b").alias("v")))
    mixed = Table(_mixed(buckets.df, part.df), "mixed")
    pairs = _prefix_pairs(mixed.df.join(full.df, "node"), num, den)
    more = links(pairs.df)
    for t in (buckets, mixed, pairs, full):
        t.drop()
    if not more.df.isEmpty():
        stars = part.df.select(F.col("node").alias("u"), F.col("component").alias("v"))
        after = components(stars.unionByName(more.df.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        part.drop()
        part = after
    named = classes.df.join(part.df, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("rep"))
    label = named.select("key", "component").join(lowest, "component").select("key", "component", F.col("rep.doc_id").alias("least"), F.col("rep.hash").alias("own"))
    out = Table(sketch.df.select("doc_id", "hash", "n_shingles", "key").join(label, "key", "left").drop("key"), "groups")
    for t in (sketch, classes, found, more, part):
        t.drop()
    return out


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, one row per row.

    Links documents whose sets of distinct k-word shingles have den * intersection >= num * union;
    component_id is the least doc_id that links reach, kept whether it is the row's own."""
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return _labels(docs, k, num, den, lower).df.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each group the row with the least doc_id stays (a null one only
    if all are null; of rows with that id, the text of least hash; of equal rows, one). Documents
    without words are in no group and all stay. Judged row by row: other rows of a doc_id stay."""
    groups = _labels(docs, k, num, den, True)
    rows = groups.df.where("component is not null").groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.max(F.col("least").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("hash"))).alias("stays"))
    told = Table(rows.where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "stays"), "told")
    groups.drop()
    id_, hash_, stays = (free(docs, c) for c in ("_id", "_hash", "_stays"))
    told_ = told.df.toDF(id_, hash_, stays)
    marked = docs.join(told_, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left")
    out = marked.where(F.col(stays).isNull()).select(*docs.columns)
    if told.df.where("stays").isEmpty():
        return out
    row = F.struct(*docs.columns)
    one = marked.where(stays).groupBy(id_, hash_).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return out.unionByName(one)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five words, 0.8); see one_of_each for nulls, ties and repeats."""
    return one_of_each(docs)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


#: All links by brute force on the words themselves, and their closure.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 2), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] || ' ' || a[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, w.doc_id = m.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)
"""
