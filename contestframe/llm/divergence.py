"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Every group (language, source) and every language gives each kept term (one that at least `min_docs` documents of the
language hold) the share p = 1 + floor(BASE * (count + 2) / (N + 2 V)). Two groups differ by the sum of
floor((p - q)^2 / (p + q)) over all V kept terms of the language, though most terms occur in few sources. So the sum
starts from V times the value of two absent terms, and terms that do occur correct it:

* a term that occurs in one source of a pair corrects by what its count alone changes; equal counts of a source are
  counted first;
* a term that occurs in both corrects once more. A term's row holds its nonzero shares in the order of the sources. Rows
  with their multiplicities are sorted, which lays them out as a frequent-pattern tree: a node is a prefix that neighbouring
  rows share, with the multiplicities of these rows summed, and each combination of a node with one of its
  ancestors gives one correction. Tasks read sorted batches; a node that a batch border splits counts in two parts, with
  the same sum.

Work follows the nodes of the tree and the pairs of sources that the result lists, not terms times pairs. Numbers are whole:
products stay below 2^63 while a language has fewer than 10^9 kept terms, shares come from decimals.

Defined results: null text, language and source count as empty; every row is a document, repeated rows and equal ids
too; a group without kept terms, or a language without any, has value 0 with every other source (0 terms) or the value of
its smoothed shares; a language with one source has no pairs; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestframe.llm.texts import sparing, written

BASE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
HELD = 400_000  # terms that a task holds before it hands counts on
COMBINATIONS = 1 << 20  # of node and ancestor, worked on at once
#: Byte table: A-Z become lower case, ASCII bytes that are no letter become spaces.
LETTER_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def letter_terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(LETTER_BYTES).split() if text else []


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), summed within tasks only."""
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], F.col(text).alias("text"))

    @sparing
    def rows(found: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (group, origin), (n, docs) in found.items():
            for out, part in zip(columns, ([group] * len(n), [origin] * len(n), n.keys(), n.values(), map(docs.__getitem__, n)), strict=True):
                out.extend(part)
        terms = pa.array(columns[2], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), terms, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for k in range(batch.num_rows):
                group = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                n, docs = found.setdefault(group, (Counter(), Counter()))
                words = letter_terms(batch.column(2)[k].as_py())
                held -= len(n)
                n.update(words)
                docs.update(set(words))
                held += len(n)
                if held >= HELD:
                    yield rows(found)
                    found, held = {}, 0
        if held:
            yield rows(found)

    return own.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column) -> Column:
    """1 + floor(BASE * (count + 2) / total), exactly."""
    return F.lit(1).cast("bigint") + F.call_function("div", F.lit(BASE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def node_corrections(lang: np.ndarray, starts: np.ndarray, source: np.ndarray, p: np.ndarray, absent: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(lang, a, b, value) of the tree over sorted rows: what each node adds with its ancestors, for each pair of sources.

    Row r holds the items starts[r] to starts[r + 1] of `source` (ascending), `p` and `absent` (the share of no
    occurrence), and stands for times[r] terms.
    """
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    depth = np.arange(len(p)) - starts[row]
    # items that the row shares with the one before it
    other = np.maximum(starts[row - 1] + depth, 0)
    same = (row > 0) & (depth < size[row - 1]) & (lang[row] == lang[row - 1])
    same &= (source == source[np.minimum(other, len(p) - 1)]) & (p == p[np.minimum(other, len(p) - 1)])
    shared = np.minimum.reduceat(np.where(same, size[row], depth), starts[:-1])
    wide = int(source.max()) + 1
    keys, values = [], []

    def add(at: np.ndarray, depth: int, count: np.ndarray) -> None:
        up = (at[:, None] - depth + np.arange(depth)).ravel()
        node, m = np.repeat(at, depth), np.repeat(count, depth)
        both = _gap(p[up], p[node]) - _gap(p[up], absent[node]) - _gap(absent[up], p[node]) + _gap(absent[up], absent[node])
        key, place = np.unique((lang[row[node]] * wide + source[up]) * wide + source[node], return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place, both * m)
        keys.append(key)
        values.append(total)

    for d in range(1, int(size.max())):
        begins = np.flatnonzero(shared <= d)  # a new node or a row too short for one starts here
        count = np.add.reduceat(times, begins)
        long = size[begins] > d
        nodes, count = starts[begins[long]] + d, count[long]
        step = max(1, COMBINATIONS // d)
        for k in range(0, len(nodes), step):
            add(nodes[k : k + step], d, count[k : k + step])
    if not keys:
        return []
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, np.concatenate(values))
    return list(zip((key // wide // wide).tolist(), (key // wide % wide).tolist(), (key % wide).tolist(), total.tolist(), strict=True))


def tree_corrections(patterns: DataFrame) -> DataFrame:
    """lang, a, b, value: the corrections of all terms that occur in both sources a < b. `patterns`: lang, items, times."""

    @sparing
    def corrected(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0).dictionary_encode()
        lists = batch.column(1)
        starts = lists.offsets.to_numpy().astype(np.int64)
        items = lists.flatten()
        source, p, absent = (items.field(k).to_numpy().astype(np.int64) for k in range(3))
        found = node_corrections(names.indices.to_numpy().astype(np.int64), starts - starts[0], source, p, absent, batch.column(2).to_numpy())
        lang, a, b, value = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield corrected(batch)

    # ranges by the first items: Spark samples these keys on the driver to find the borders
    ordered = patterns.repartitionByRange("lang", F.slice("items", 1, 3)).sortWithinPartitions("lang", "items")
    return ordered.select("lang", "items", "times").mapInArrow(run, "lang string, a int, b int, value bigint")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by divergence, and the terms a source has most in excess."""
    counts = term_counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    kept = written(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total", "row"))
    each = kept.select("lang", "term", "total", F.inline("row"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    smooth = F.col("v") * 2
    known = known.withColumn("size", F.coalesce("own_n", F.lit(0)) + smooth).withColumn("lang_size", F.coalesce("lang_n", F.lit(0)) + smooth)
    absent = F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("size"))).otherwise(F.lit(1))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = written(known.select("lang", "source", place.alias("idx"), "v", "size", "lang_size", absent.alias("absent")))

    shares = each.join(known, ["lang", "source"]).select("lang", "source", "term", "total", "idx", "absent", "lang_size", share(F.col("n"), F.col("size")).alias("p"))
    items = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("idx", "p", "absent"))).alias("items"))
    patterns = written(items.groupBy("lang", "items").agg(F.count("*").alias("times")))

    left = known.select("lang", "v", F.col("idx").alias("a"), F.col("absent").alias("absent_a"))
    right = known.select("lang", F.col("idx").alias("b"), F.col("absent").alias("absent_b"))
    base = left.join(right, "lang").where("a < b").select("lang", "a", "b", (F.col("v") * gap(F.col("absent_a"), F.col("absent_b"))).alias("value"))
    alone = patterns.select("lang", "times", F.inline("items")).groupBy("lang", "idx", "p", "absent").agg(F.sum("times").alias("times"))
    change = F.col("times") * (gap(F.col("p"), F.col("absent_b")) - gap(F.col("absent"), F.col("absent_b")))
    single = alone.join(right, "lang").where("idx <> b").select("lang", F.least("idx", "b").alias("a"), F.greatest("idx", "b").alias("b"), change.alias("value"))
    pairs = base.unionByName(single).unionByName(tree_corrections(patterns)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = known.select("lang", "source", F.col("idx").alias("a"))
    other = known.select("lang", F.col("source").alias("item"), F.col("idx").alias("b"))
    pair = written(both).join(name, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    q = share(F.col("total"), F.col("lang_size"))
    excess = shares.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    top = excess.withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pair.withColumn("rank", rank).unionByName(top)
