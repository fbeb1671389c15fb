"""SimHash near-duplicates by meeting in the middle.

A fingerprint has 64 bits; fingerprints at most 3 bits apart are linked. The bits fall into four blocks of 16.
With one block left out, every fingerprint emits all values within one bit of what remains: two fingerprints
that differ in at most two of the remaining bits meet at a value in between. Of three differing bits at least one
falls into a block that can be left out, so every link meets this way unless its three bits share a block; then
both agree in all other bits, and within that block one side emits the values one bit away, the other those
two bits away.

All that meet at a value with equal left-out blocks are at most two bits apart, so each is linked to the
smallest of them; groups whose left-out blocks differ in one bit are at most three bits apart, so their smallest
are linked. That keeps every connection with no pair lists: a value has at most 49 fingerprints with equal blocks.
Links are verified on the fingerprints and joined into components.

`keep_distinct` is the form for corpora, where a copy may differ in some words. Fingerprints of three-word shingles move by
many bits then, those of single words by few, so it looks for candidates with two fingerprints of single words, each
with its own seed, and verifies the five-word similarity of all candidates on their texts.

Defined results: null and empty texts and those without a word have fingerprint 0 and are linked like any other;
repeated rows and equal ids keep one row each in `near_duplicates` and one row altogether in `keep_one`; null
ids count as largest for component ids (a component without an id has a null one); other columns are carried
by `keep_one` and not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from contestframe.llm import jaccard
from contestframe.llm.chunks import among
from contestframe.llm.components import components
from contestframe.llm.texts import arrow_map, blank_words, keyed, on_key, released, sparing, written

BLOCKS, WIDTH, RADIUS, SEED = 4, 16, 3, 42
SEEDS = (42, 7)  # of the fingerprints of single words
NEAR = 32  # of so many fingerprints that are equal outside a block, all pairs are compared
THREE = [1 << k | 1 << m | 1 << n for k in range(WIDTH) for m in range(k) for n in range(m)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def text_fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """Majority of each bit over the hashes of all word shingles, as a signed 64-bit number."""
    words = blank_words(text, lower=True)
    if not words:
        return 0
    grams = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(g), seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3, seed: int = SEED) -> Column:
    """The fingerprint of a text as a signed 64-bit number."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(t, shingle, seed) for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(sparing(run), "bigint")(text)


def _rest(block: int) -> int:
    return ((1 << 64) - 1) ^ (((1 << WIDTH) - 1) << (WIDTH * block))


def variants(prints: DataFrame) -> DataFrame:
    """block, value, fp: all values within one bit of what a fingerprint has outside the block."""
    ball = [(n, _signed(_rest(n)), _signed(flip)) for n in range(BLOCKS) for flip in [0] + [1 << k for k in range(64) if k // WIDTH != n]]
    table = F.array(*[F.struct(F.lit(n).alias("block"), F.lit(rest).cast("bigint").alias("rest"), F.lit(flip).cast("bigint").alias("flip")) for n, rest, flip in ball])
    each = prints.select("fp", F.inline(table))
    return each.select("block", F.col("fp").bitwiseAND(F.col("rest")).bitwiseXOR(F.col("flip")).alias("value"), "fp")


def _pairs(row: np.ndarray, part: np.ndarray, fp: np.ndarray, equal: np.ndarray) -> list[np.ndarray]:
    """Rows (a, b) of fingerprints that meet: `row` numbers the values, `part` is the left-out block, `equal` tells who holds the value itself."""
    order = np.lexsort((fp, part, row))
    key, fp, equal = (row << WIDTH | part)[order], fp[order], equal[order]
    keys, first, group = np.unique(key, return_index=True, return_inverse=True)
    rep = fp[first]
    out = [np.column_stack([rep[group], fp])]

    def met(keys: np.ndarray, own: np.ndarray, flip: int) -> None:
        """Those whose left-out blocks differ in the bits of `flip`, each pair once."""
        low = np.flatnonzero(keys < keys ^ flip)
        at = np.minimum(np.searchsorted(keys, keys[low] ^ flip), len(keys) - 1)
        hit = keys[at] == keys[low] ^ flip
        out.append(np.column_stack([own[low[hit]], own[at[hit]]]))

    for k in range(WIDTH):
        met(keys, rep, 1 << k)
    # all three bits in one block: what lies outside it is equal
    key, fp = key[equal], fp[equal]
    n = np.bincount(key >> WIDTH)[key >> WIDTH] if len(key) else key
    for step in range(1, NEAR):  # of a few, all pairs
        if step >= len(key) or step >= n.max():
            break
        at = np.flatnonzero(key[step:] >> WIDTH == key[:-step] >> WIDTH)
        out.append(np.column_stack([fp[at], fp[at + step]]))
    many = n > NEAR
    if many.any():
        key, fp = key[many], fp[many]
        for flip in THREE:
            met(key, fp, flip)
    return out


def links(prints: DataFrame) -> DataFrame:
    """a, b: verified links that connect whatever is at most three bits apart. `prints`: distinct `fp`.

    The fingerprints of a value are gathered where they were dealt to, and give their links there.
    """
    met = variants(prints).withColumn("n", F.count("*").over(Window.partitionBy("block", "value"))).where("n > 1")
    values = met.groupBy("block", "value").agg(F.collect_list("fp").alias("fps"))

    @sparing
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        fp = batch.column(2).flatten().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        block, value = (batch.column(k).to_numpy()[row] for k in (0, 1))
        part = fp.view(np.uint64) >> (WIDTH * block).astype(np.uint64) & np.uint64((1 << WIDTH) - 1)
        rest = np.array([_signed(_rest(n)) for n in range(BLOCKS)])
        pairs = np.concatenate(_pairs(row, part.astype(np.int64), fp, fp & rest[block] == value))
        pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & (np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= RADIUS)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            yield rows(batch)

    return arrow_map(values, run, "a bigint, b bigint").distinct()


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _sum, fp, root of every row."""
    rows = written(keyed(docs, doc_id, text).select("_id", "_sum", fingerprint(F.col("_text")).alias("fp")))
    prints = rows.select("fp").distinct()
    roots = components(links(prints))
    label = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows.join(written(label), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links."""
    rows = _labelled(docs, doc_id, text)
    least = rows.groupBy("root").agg(F.min("_id").alias("component_id"))
    return rows.join(least, "root").select(F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every component: the smallest id, of equal ids the smallest hash of the text."""
    known = docs.columns
    rows = _labelled(docs, doc_id, text)
    first = F.struct(F.col("_id").isNull().alias("none"), "_id", "_sum")
    kept = rows.groupBy("root").agg(F.min(first).alias("k")).select(F.xxhash64("k._id", "k._sum").alias("key"), F.col("k._id").alias("kept_id"), F.col("k._sum").alias("kept_sum"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in known]).alias("row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_sum"))
    packed = packed.withColumn("key", F.xxhash64("_id", "_sum"))
    both = packed.join(written(kept), "key").where(F.col("_id").eqNullSafe(F.col("kept_id")) & (F.col("_sum") == F.col("kept_sum")))
    return both.dropDuplicates(["key", "_id", "_sum"]).select(*[F.col("row")[c].alias(c) for c in known])


def candidates(docs: DataFrame, doc_id: str, text: str, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """_id, _sum of the rows that links of one of the fingerprints of single words connect with another row."""
    prints = [fingerprint(F.col("_text"), 1, seed).alias(f"fp{k}") for k, seed in enumerate(seeds)]
    rows = written(keyed(docs, doc_id, text).select("_id", "_sum", *prints))
    found = None
    for k in range(len(seeds)):
        counted = written(rows.groupBy(F.col(f"fp{k}").alias("fp")).agg(F.count("*").alias("n")))
        roots = components(links(counted.select("fp")))
        label = counted.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", F.coalesce("root", "fp").alias("root"))
        several = label.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root")
        met = written(label.join(several, "root").select("fp"))
        part = rows.join(met, rows[f"fp{k}"] == met["fp"], "left_semi").select("_id", "_sum")
        found = part if found is None else found.unionByName(part)
        released(docs.sparkSession)
    return found.distinct()


def keep_distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of every group of near copies: the smallest id, of equal ids the smallest hash of the text.

    Candidates are near copies if a chain of texts with a Jaccard similarity of `percent` over shingles connects them. Null and
    empty texts are copies of one another.
    """
    known = docs.columns
    picked = written(candidates(docs, doc_id, text))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in known]).alias("row"), F.col(text).alias("_text"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_sum"))
    close = written(on_key(among(packed.select("_id", "_sum", "_text"), picked, "_id", "_sum"), picked, "left_semi"))
    rows = written(jaccard.labelled(close, "_id", "_text", shingle, percent))
    first = F.struct(F.col("_id").isNull().alias("none"), "_id", "_sum")
    kept = written(rows.groupBy("root").agg(F.min(first).alias("k")).select("k._id", "k._sum"))
    gone = written(on_key(rows.select("_id", "_sum"), kept, "left_anti").distinct())
    again = rows.groupBy("_id", "_sum").count().where("count > 1").select("_id", "_sum")
    released(docs.sparkSession)
    return _without(packed, gone, again, known)


def _without(packed: DataFrame, gone: DataFrame, again: DataFrame, known: list[str]) -> DataFrame:
    """The rows whose key is not in `gone`, one for each key in `again`: keys that occur more than once are all there.

    Hardly a text is dealt out: rows outside the bitmap of both tables stay where they are, and of those inside it, keys alone
    tell which come back.
    """
    touched = written(gone.unionByName(again))
    back = written(on_key(among(packed.select("_id", "_sum"), touched, "_id", "_sum"), gone, "left_anti").distinct())
    whole = among(packed, touched, "_id", "_sum", how="left_anti").select("row")
    inside = among(among(packed, touched, "_id", "_sum"), back, "_sum", "_id").select("row", "_id", "_sum")
    once = on_key(inside, back, "left_semi").dropDuplicates(["_id", "_sum"]).select("row")
    return whole.unionByName(once).select(*[F.col("row")[c].alias(c) for c in known])
