r"""Personal data: fixed kinds by pattern, and more by bootstrapped contextual extraction.

Base kinds are leftmost non-overlapping matches of their regular expressions (possessive, so that
they take linear time; \G and look-behind keep the matches what the plain forms find), kept if
they pass their test (parts up to 255, Luhn, number of digits).

The method: candidates are words that hold a digit, an @ or an =, or sixteen capitals in a row. A
candidate that overlaps a base span is a seed of its kind. A candidate whose value (the word without a
leading name and = or :, and without marks around it) is a run of sixteen or more letters and digits
that change into each other four times is a seed of the kind secret, which has no base spans. An
instance is a value in lower case. Its patterns are lexical: the two words before it; the word
before and the word after it (digits folded to 0, other candidates included); the name in front of the
value; the value's first four letters with its alphabet and length; and the length of a value in
hexadecimal digits. Distinct (pattern, instance) pairs are the graph's edges.

Scores are by kind: a seed's is 1; a pattern's confidence is the sum of its instances' scores over
the number of all its instances, so that every instance that nothing supports speaks against it; an
instance's score is one minus the product of its patterns' doubts; ROUNDS rounds. Patterns with
MIN_SEEDS distinct seeds of the kind and a confidence of MIN_CONF are trusted: their candidates become
spans of the kind, unless the candidate has a base kind's form and failed its test. So an identifier
that no rule describes is found by the company it keeps. A secret seed without a trusted pattern is none.

Nulls: a null text is empty; a null doc_id is carried. Each row is judged by itself, so repeated
rows give repeated results. Copies count once in the graph. Other columns are ignored.
All stages are DataFrame expressions; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Table, read

KINDS, SECRET = ("email", "ip", "card", "phone", "secret"), 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@=]*+[0-9@=]|[^\x20\x09-\x0D0-9@=A-Z]*+[A-Z]{16})[^\x20\x09-\x0D]*+"
IS_CANDIDATE = r"^(?:[^0-9@=]*+[0-9@=]|[^0-9@=A-Z]*+[A-Z]{16})"
NAME, VALUE = r"^[^A-Za-z0-9@+=:]*+[A-Za-z_][A-Za-z0-9_.-]*+[\"']?[=:]", r"[A-Za-z0-9](?:[^\x20\x09-\x0D]*[A-Za-z0-9])?"
RANDOM = r"^[A-Za-z0-9]{16,}$", r"^[0-9]*+(?:[A-Za-z]++[0-9]++){4}"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
ROUNDS, MIN_SEEDS, MIN_CONF, LEAST, RUN = 3, 3, 0.7, 0.1, 64
SPAN = "array<struct<start:long,kind:int,stop:long>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether 14 to 19 digits pass Luhn's test."""
    d = _digits(x)
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = v * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


TESTS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, found) of all matches. Places are running sums over runs of RUN matches and
    over the runs, as an array that grows by one entry is copied every time."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.arrays_zip(found.alias("f"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("b"))
    none = F.expr("cast(array() as array<struct<start:long,stop:long,found:string>>)")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda i: F.slice(parts, i * RUN + 1, RUN))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        stop = start + F.length(x["f"])
        item = F.struct(start.alias("start"), stop.alias("stop"), x["f"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    def run(acc: Column, x: Column) -> Column:
        size = F.aggregate(x, F.lit(0).cast("long"), lambda n, y: n + F.length(y["b"]) + F.length(y["f"]))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<long>)").alias("out"))
    begins = F.aggregate(runs, empty, run)["out"]
    placed = F.zip_with(runs, begins, lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), add)["out"])
    return F.when(F.size(found) > 0, F.flatten(placed)).otherwise(none)


def _context(text: Column) -> Column:
    """Array of (far, near, next) of all candidates, in order: two words before and one after in the
    whole text, whatever they are, empty where there is none."""
    words, none = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0), F.array(F.lit(""))
    moved = F.arrays_zip(words.alias("w"), F.concat(none, none, words).alias("far"), F.concat(none, words).alias("near"), F.concat(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), none).alias("next"))
    return F.filter(moved, lambda x: F.coalesce(x["w"].rlike(IS_CANDIDATE), F.lit(False)))


def _base(text: Column) -> Column:
    def spans(no: int, kind: str) -> Column:
        ok = F.filter(_matches(text, PATTERNS[kind]), lambda m: TESTS[kind](m["found"]))
        return F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind"), m["stop"].alias("stop")))

    return F.array_sort(F.concat(*(spans(no, kind) for no, kind in enumerate(PATTERNS))))


def _count(spans: str, no: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == no)).cast("long")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def found_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> uid, doc_id, base, candidates; the table that all else starts from."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text.rlike("[0-9@=]|[A-Z]{16}").alias("any"))
    none = F.expr(f"cast(array() as {SPAN})")
    rows = rows.withColumn("base", F.when(F.col("any"), _base(F.col("text"))).otherwise(none))
    fold = lambda x: F.regexp_replace(F.lower(x), "[0-9]", "0")

    def candidate(m: Column, c: Column) -> Column:
        kind = F.expr("cast(null as int)")
        hit = F.filter(F.col("base"), lambda s: (s["start"] < m["stop"]) & (s["stop"] > m["start"]))
        name = F.regexp_extract(m["found"], NAME, 0)
        rest = F.substring(m["found"], F.length(name) + 1, F.length(m["found"]))
        value = F.regexp_extract(rest, VALUE, 0)
        secret = value.rlike(RANDOM[0]) & value.rlike(RANDOM[1])
        start = m["start"] + F.length(name) + F.greatest(F.instr(rest, value) - 1, F.lit(0))
        form = F.reduce(F.array(*(F.lit(rf"^{p}$") for p in PATTERNS.values())), F.lit(False), lambda done, p: done | F.regexp_like(m["found"], p))
        return F.struct(
            F.when(value != "", start).otherwise(m["start"]).alias("start"), F.when(value != "", start + F.length(value)).otherwise(m["stop"]).alias("stop"),
            F.when(value != "", value).otherwise(m["found"]).alias("value"), F.lower(name).alias("name"),
            fold(c["far"]).alias("far"), fold(c["near"]).alias("near"), fold(c["next"]).alias("next"),
            F.when(F.size(hit) > 0, F.element_at(hit, F.least(F.size(hit), F.lit(1)))["kind"]).when(secret, SECRET).otherwise(kind).alias("seed"),
            ((F.size(hit) == 0) & form).alias("failed"),
        )

    kind = "array<struct<start:long,stop:long,value:string,name:string,far:string,near:string,next:string,seed:int,failed:boolean>>"
    rows = rows.withColumn("candidates", F.when(F.col("any"), F.zip_with(_matches(F.col("text"), CANDIDATE), _context(F.col("text")), candidate)).otherwise(F.expr(f"cast(array() as {kind})")))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "base", "candidates")


def _mentions(spans: DataFrame) -> DataFrame:
    """One row per candidate and pattern: uid, start, stop, instance, seed, failed, pattern."""
    c = spans.select("uid", F.explode("candidates").alias("c")).select("uid", "c.*")
    long, lead = F.length("value"), F.lower(F.substring("value", 1, 4))
    alphabet = F.when(F.col("value").rlike("^[A-Z0-9]+$"), "capitals").when(F.col("value").rlike("^[a-z0-9]+$"), "small").when(F.col("value").rlike("^[A-Za-z0-9]+$"), "letters").otherwise("other")
    hexadecimal = F.col("value").rlike("^[0-9a-f]+$") & F.col("value").rlike("[a-f]") & F.col("value").rlike("[0-9]")
    patterns = F.array(
        F.when((F.col("far") != "") & (F.col("near") != ""), F.xxhash64(F.lit("two"), "far", "near")),
        F.when((F.col("near") != "") & (F.col("next") != ""), F.xxhash64(F.lit("around"), "near", "next")),
        F.when(F.col("name") != "", F.xxhash64(F.lit("name"), "name")),
        F.when((long >= 12) & lead.rlike("^[a-z]{4}$"), F.xxhash64(F.lit("form"), lead, alphabet, long)),
        F.when((long >= 12) & hexadecimal, F.xxhash64(F.lit("hexadecimal"), long)),
    )
    return c.select("uid", "start", "stop", F.xxhash64(F.lower("value")).alias("instance"), "seed", "failed", F.explode(patterns).alias("pattern")).where("pattern is not null")


def bootstrap(mentions: DataFrame) -> DataFrame:
    """Trusted patterns (pattern, kind, confidence) from the pattern-instance graph."""
    edges = Table(mentions.groupBy("pattern", "instance").agg(F.min("seed").alias("seed")), "graph")
    sizes = edges.df.groupBy("pattern").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")).where(f"seeds >= {MIN_SEEDS}")
    edges_ = Table(edges.df.join(sizes.select("pattern", "n"), "pattern"), "edges")  # a pattern of few seeds can't be trusted
    seeds = Table(edges.df.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("known", F.lit(1.0)), "seeds")
    score, patterns, old = seeds.df.select("instance", "kind", F.col("known").alias("score")), None, []
    for _ in range(ROUNDS):
        conf = edges_.df.join(score, "instance").groupBy("pattern", "kind", "n").agg(F.sum("score").alias("total"), F.count(F.when(F.col("seed") == F.col("kind"), 1)).alias("seeds"))
        patterns = Table(conf.where(f"seeds >= {MIN_SEEDS}").select("pattern", "kind", F.round(F.col("total") / F.col("n"), 9).alias("confidence")), "patterns")
        old.append(patterns)
        doubt = edges_.df.join(patterns.df.where(f"confidence >= {LEAST}"), "pattern").groupBy("instance", "kind").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("doubt"))
        both = seeds.df.join(doubt, ["instance", "kind"], "full")
        score = Table(both.select("instance", "kind", F.greatest(F.coalesce("known", F.lit(0.0)), 1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("score")), "scores")
        old.append(score)
        score = score.df
    out = Table(patterns.df.where(f"confidence >= {MIN_CONF}"), "trusted")
    for t in (edges, edges_, seeds, *old):
        t.drop()
    return out.df


def extract(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, base and spans (arrays of start, kind, stop), a row per row."""
    spans = Table(found_spans(docs.select("doc_id", "text")), "spans").df
    mentions = Table(_mentions(spans), "mentions")
    trusted = bootstrap(mentions.df)
    new = mentions.df.where(f"(seed is null or seed = {SECRET}) and not failed").join(trusted, "pattern").where("seed is null or seed = kind").groupBy("uid", "start", "stop").agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
    new = Table(new.groupBy("uid").agg(F.collect_list(F.struct("start", (-F.col("best.col2")).alias("kind"), "stop")).alias("more")), "found").df
    mentions.drop()
    more = F.coalesce("more", F.expr(f"cast(array() as {SPAN})"))
    return spans.join(new, "uid", "left").select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_secret and n_spans (all spans)."""
    out = extract(read(spark, sf_dir, "documents"))
    count = [_count("base", no).alias(f"n_{k}") for no, k in enumerate(PATTERNS)]
    return out.select("doc_id", *count, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), _count("spans", SECRET).alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))
