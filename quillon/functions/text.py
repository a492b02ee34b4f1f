"""Column expressions over text: tokens, numbers, normalisation, headings, Markdown tables."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms.
STOP_WORDS = ("a", "an", "the", "is", "are", "was", "were", "of", "to", "in", "on", "for", "and", "or", "with", "what", "which", "how", "does", "did", "this", "that", "from", "by", "as", "it", "paper", "study")
# Headings of a paper's sections, after an optional number.
HEADING = r"(?i)^(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?(?:abstract|introduction|background|related work|methods?|methodology|experiments?|results?|discussion|conclusions?|limitations?|references|摘要|引言|背景|相关工作|方法|实验|结果|讨论|结论|局限性|参考文献)\s*$"
# What a Latin term, a run of CJK letters and a number are.
TERM = r"[a-z0-9]+(?:\.[0-9]+)?"
CJK = r"[\u4e00-\u9fff]+"
NUMBER = r"(?<![A-Za-z0-9.])[+-]?\p{Nd}+(?:\.\p{Nd}+)?%?(?![\p{Nd}.])"

#: Letters that are lower case already but fold to others: to one letter, and to several.
FOLDED = {c: f for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))) if c.lower() == c and (f := c.casefold()) != c}
ONE = {c: f for c, f in FOLDED.items() if len(f) == 1}
MANY = {c: f for c, f in FOLDED.items() if len(f) > 1}


def _let(value: Column, of) -> Column:
    """of(value), with value computed once for each row."""
    return F.transform(F.array(value), of)[0]


def _class(letters) -> str:
    """A character class of the letters, by ranges: a class of many single letters is slow."""
    codes, out = sorted(map(ord, letters)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def fold(text: Column) -> Column:
    """Full case folding: lower case, then the letters that folding changes beyond that. Texts of ASCII or
    Latin-1 letters alone need few steps; of the letters that fold to several, only those held are replaced."""
    several = F.create_map(*(F.lit(x) for pair in MANY.items() for x in pair))

    def latin_1(low: Column) -> Column:
        for c in (c for c in FOLDED if c < "\u0100"):
            low = F.replace(low, F.lit(c), F.lit(FOLDED[c]))
        return low

    def beyond(low: Column) -> Column:
        held = F.array_distinct(F.regexp_extract_all(low, F.lit(_class(MANY)), F.lit(0)))
        return F.aggregate(held, low, lambda t, c: F.replace(t, c, F.element_at(several, c)))

    ascii_ = lambda low: F.octet_length(low) == F.char_length(low)
    one = lambda low: F.translate(low, "".join(ONE), "".join(ONE.values()))
    return _let(F.lower(text), lambda low: F.when(ascii_(low), low).when(~low.rlike(r"[^\x00-\xff]"), latin_1(low)).otherwise(_let(one(low), beyond)))


def tokens(text: Column) -> Column:
    """Search terms: Latin words and numbers that are no stop words, then pairs of each CJK run."""
    folded = fold(F.coalesce(text, F.lit("")))
    return _let(folded, _terms)


def _terms(folded: Column) -> Column:
    latin = F.filter(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    pairs = F.transform(F.regexp_extract_all(folded, F.lit(CJK), F.lit(0)), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, F.flatten(pairs))


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become a space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def numbers(text: Column) -> Column:
    """Distinct numbers with sign, decimals and percent, not inside words or longer numbers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), 0))


def is_heading(text: Column) -> Column:
    return text.rlike(HEADING)


def markdown(rows: Column) -> Column:
    """Markdown table of an array of arrays of strings; short rows are padded."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))), F.lit(" |"))
    lines = F.transform(clean, line)
    rule = F.concat(F.lit("| "), F.concat_ws(" | ", F.array_repeat(F.lit("---"), width)), F.lit(" |"))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.concat_ws("\n", F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))))


def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC, for which Spark has no built-in: an Arrow stage over batches."""
    return F.pandas_udf(_nfkc, "string")(text)


def normalized(text: Column) -> Column:
    return collapse(nfkc(text))


def parse_markdown(text: Column) -> Column:
    """Rows of a Markdown table (the rule row left out), unescaped; null unless there are three lines
    of equal width at least. Headers that occur twice get their column's number."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("| "))
    cells = lambda x: F.transform(F.split(x, r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    inner = lambda r: F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0)))
    rows = F.transform(lines, lambda x: inner(cells(x)))
    head = F.transform(rows[0], lambda h, i: F.when(F.size(F.filter(rows[0], lambda o: o == h)) > 1, F.concat(h, F.lit(" ("), (i + 1).cast("string"), F.lit(")"))).otherwise(h))
    ok = (F.size(rows) >= 3) & F.forall(rows, lambda r: F.size(r) == F.size(rows[0]))
    return F.when(ok, F.concat(F.array(head), F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0)))))
