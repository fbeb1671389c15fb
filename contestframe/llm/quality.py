"""Quality rules: counts within a document, and the frequency of its lines across documents.

Lines are normalised (A-Z lower-cased, digits to 0, white space runs to one space, trimmed) and hashed. A line
is boilerplate of its host if more distinct documents of the host hold it than both limits allow. Documents with the
same set of lines are one document here, so that exact copies count once. Boilerplate lines are removed; a document left
with too few of its words is rejected, as are those that fail a rule on their own counts.

One pass over the texts writes counts and line hashes to the shared folder; what follows works on those. Lines and
the table of boilerplate lines meet in a join on host and hash that Spark may broadcast or split.

Defined results: a null text has no words and is rejected by `min_words`; it stays null; a null host is a host
of its own; repeated rows get one result each; a document without a line is not depleted; columns beside id,
text and host are carried by `clean` and not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestframe.llm.texts import LOWER, UPPER, blank_words, keyed, on_key, sparing, written

_PLAIN = str.maketrans(UPPER + "0123456789", LOWER + "0000000000")
_BLANKS = re.compile("[\\x20\\x09-\\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """Thresholds. A line is boilerplate above both `max_docs` documents and `max_share` of the host's documents."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 30  # symbols to 100 words
    max_docs: int = 10
    max_share: float = 0.01
    min_left_percent: int = 30  # words that must be left


LIMITS = Limits()


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    a = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = len(numbers)
    if size < 2_000_000:
        code = (a[:-2] * size + a[1:-1]) * size + a[2:]
    else:  # the product would not fit
        pair = np.unique(a[:-1] * size + a[1:], return_inverse=True)[1]
        code = pair[:-1] * size + a[2:]
    _, where, found = np.unique(code, return_inverse=True, return_counts=True)
    twice = found[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= twice
    return int(covered.sum())


def _counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = blank_words(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _line_words(text: str | None) -> list[dict]:
    """The md5 of every normalised line with a word, and the words under it, repeats included."""
    found: dict[str, int] = {}
    for line in (text or "").split("\n"):
        plain = _BLANKS.sub(" ", line.translate(_PLAIN)).strip(" ")
        if plain:
            digest = hashlib.md5(plain.encode(), usedforsecurity=False).hexdigest()
            found[digest] = found.get(digest, 0) + plain.count(" ") + 1
    return [{"line": k, "words": n} for k, n in sorted(found.items())]


def measured(text: Column) -> Column:
    """Struct of the counts within one text and of its line hashes in order, each with its words."""
    line = pa.list_(pa.struct([("line", pa.string()), ("words", pa.int64())]))

    def run(texts: pa.Array) -> pa.Array:
        bodies = texts.to_pylist()
        columns = zip(*map(_counts, bodies), strict=True) if bodies else [[]] * len(COUNTS)
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([_line_words(t) for t in bodies], line)], [*COUNTS, "lines"])

    return F.arrow_udf(sparing(run), ", ".join(f"{c} bigint" for c in COUNTS) + ", lines array<struct<line:string,words:bigint>>")(text)


def boilerplate(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """host, line: the lines above the limits. `rows`: host and lines of every document."""
    hashes = F.transform("lines", lambda x: x["line"])
    told = rows.select("host", F.md5(F.array_join(hashes, "")).alias("told_by"), F.explode(hashes).alias("line"))
    # one row for each set of lines, then plain counts
    found = told.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limits.max_docs)
    sizes = rows.groupBy("host").agg(F.count("*").alias("docs"))
    return on_key(found, sizes, "inner", ("host",)).where(F.col("n") > F.col("docs") * limits.max_share).select("host", "line")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = LIMITS) -> DataFrame:
    """_id, _sum (hash of the text), host, counts, `base_failed`, `kept` and `bad` (boilerplate lines) of every row."""
    own = keyed(docs, doc_id, text, host)
    rows = written(own.select("_id", "_sum", "host", F.monotonically_increasing_id().alias("n"), measured(F.col("_text")).alias("m")).select("_id", "_sum", "host", "n", "m.*"))
    bad = written(boilerplate(rows, limits))
    held = rows.select("n", "host", F.explode("lines").alias("x")).select("n", "host", "x.line", "x.words")
    gone = on_key(held, bad, "left_semi", ("host", "line")).groupBy("n").agg(F.sum("words").alias("gone"), F.array_sort(F.collect_list("line")).alias("bad"))
    both = rows.drop("lines").join(gone, "n", "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    n = F.col("n_words")
    failed = (n < limits.min_words) | (F.col("n_repeat_words") * 100 > n * limits.max_repeat_percent)
    depleted = (n - F.col("gone")) * 100 < n * limits.min_left_percent
    noisy = F.col("n_symbols") * 100 > n * limits.max_symbol_percent
    return both.select("_id", "_sum", "host", *COUNTS, failed.alias("base_failed"), (~failed & ~depleted & ~noisy).alias("kept"), "bad")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = LIMITS) -> DataFrame:
    """The rows of the documents that are kept, without their boilerplate lines."""
    kept = judge(docs, doc_id, text, host, limits).where("kept").groupBy("_id", "_sum", "host").agg(F.first("bad").alias("bad"))
    packed = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("k"), F.col(text).alias("body"), F.col(host).alias("h")), "k", "body", "h", "row")
    both = on_key(packed, written(kept), "inner", ("_id", "_sum", "host"))
    plain = F.translate("_text", UPPER + "0123456789", LOWER + "0000000000")
    pairs = F.arrays_zip(F.split("_text", "\n").alias("line"), F.split(plain, "\n").alias("plain"))

    def stays(p: Column) -> Column:
        return ~F.array_contains("bad", F.md5(F.trim(F.regexp_replace(p["plain"], "[\\x20\\x09-\\x0D]+", " "))))

    left = F.array_join(F.transform(F.filter(pairs, stays), lambda p: p["line"]), "\n")
    done = both.withColumn("left_text", F.when(F.col("bad").isNull(), F.col("_text")).otherwise(left))
    return done.select(*[F.col("left_text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
