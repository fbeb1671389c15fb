"""Benchmark decontamination by spaced seeds.

A seed is a window of words of which a mask keeps some positions and ignores the others, so that a substituted
word under an ignored position does not hide a match. The seeds of the benchmark items are hashed; the
documents' seeds are looked up in a bitmap of fixed size made from those hashes, and what passes is joined with
the items' seeds on the hash. Hits are gathered by document, item and diagonal (place in the document minus place in
the item). Along each diagonal the words of both texts are compared: the longest stretch in which enough words are
equal is the overlap; a part of its words may differ. An overlap that covers enough of the item makes the
document contaminated.

Only documents with a hit send their word hashes to the verification, once each. The items' seeds are a plain join
side: Spark broadcasts them if they are small and shuffles both sides by hash otherwise.

Defined results: null and empty texts and items have no seeds; an item of fewer than eight words is
compared by masks of its own length; ids may be null or repeated, and the best overlap of equal rows is one row; ties go to
the earlier place; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestframe.llm.texts import arrow_map, keyed, on_key, terms, written

#: Masks over word positions; each keeps six. One of them fits into every stretch of 8 to 15 words of which 80 % are
#: equal, wherever the others stand (a test tries all). Of a longer stretch, cut in two, one part is such a stretch.
MASKS = ("1111011", "1011111", "11101101", "110010111", "101100111", "1110100011")
SHORT = 8  # items with fewer words have masks of their own
FILTER_BITS = 27  # size of the bitmap, as a power of two; fixed, whatever the benchmark's size
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """An overlap counts if it has `min_identity` equal words and covers `min_cover` of the item and `min_words`."""

    min_identity: float = 0.8
    min_cover: float = 0.5
    min_words: int = 8


def word_hashes(text: str | None, seen: dict[bytes, int]) -> np.ndarray:
    """64-bit hash of every word; `seen` keeps those of the batch."""
    words = terms(text)
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the kept words of every window of the mask."""
    size = len(hashes) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, number + 1, np.uint64)
    for k, keep in enumerate(mask):
        if keep == "1":
            out = (out ^ hashes[k : k + size]) * MULTIPLIER
            out ^= out >> np.uint64(29)
    return out


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _all_seeds(hashes: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and places of all masks; a text shorter than the masks has one seed, the whole of it."""
    parts = [(s, np.arange(len(s))) for n, m in enumerate(masks) if len(s := seeds(hashes, m, n))]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def short_masks(size: int) -> tuple[str, ...]:
    """Masks of the length of a short item: the whole, and from five words on, where one may differ, all but one word."""
    return ("1" * size, *("1" * k + "0" + "1" * (size - k - 1) for k in range(1, size - 1) if size >= 5))


def item_seeds(items: DataFrame, item_id: str, text: str, masks: tuple[str, ...]) -> DataFrame:
    """item, words (hashes), seed, at: every seed of every item."""
    kind = pa.list_(pa.int64())

    def run(batch: pa.RecordBatch):
        seen: dict[bytes, int] = {}
        words = [word_hashes(t, seen) for t in batch.column(1).to_pylist()]
        found = [_all_seeds(h, masks if len(h) >= SHORT else short_masks(len(h))) for h in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_signed(h) for h in words], kind), pa.array([_signed(s) for s, _ in found], kind), pa.array([p for _, p in found], kind)],
            ["item", "words", "seeds", "places"])

    typed = items.schema[item_id].dataType.simpleString()
    return arrow_map(items.select(item_id, text), run, f"item {typed}, words array<bigint>, seeds array<bigint>, places array<bigint>")


def _bitmap(table: DataFrame) -> np.ndarray:
    """Bits of all item seeds, two for each, gathered as words of the bitmap: never more than the bitmap itself."""
    high, low = F.shiftrightunsigned("s", 64 - FILTER_BITS), F.col("s").bitwiseAND((1 << FILTER_BITS) - 1)
    places = table.select(F.explode("seeds").alias("s")).select(F.explode(F.array(high, low)).alias("p"))
    rows = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(63).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows["word"].to_numpy(int)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, identity: float) -> tuple[int, int, int]:
    """Start in the document, words and equal words of the longest stretch of a diagonal with this share of equal words.

    An equal word gains 1 - identity, another loses identity: the longest stretch between two equal words whose sum
    is not negative, found in one pass over the least sums to start from and the largest sums to end at.
    """
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = doc[low + diagonal : high + diagonal] == item[low:high]
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0 - identity, -identity))])
    least = np.minimum.accumulate(np.append(np.where(same, sums[:-1], np.inf), np.inf)).tolist()
    most = np.maximum.accumulate(np.append(np.where(same, sums[1:], -np.inf)[::-1], -np.inf))[::-1].tolist()
    start = begin = end = 0
    for stop in range(len(sums)):
        while start < stop and most[stop] < least[start] - 1e-9:
            start += 1
        if stop - start > end - begin:
            begin, end = start, stop
    return low + diagonal + begin, end - begin, int(same[begin:end].sum())


def find_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limits: Limits = Limits(), masks: tuple[str, ...] = MASKS) -> DataFrame:
    """_id, _sum (hash of the text), item, start, n_words, n_equal, item_words: the best overlap of each document and item."""
    table = written(item_seeds(items, item_id, item_text, masks))
    short = [int(r[0]) for r in table.select(F.size("words").alias("n")).where(f"n between 1 and {SHORT - 1}").distinct().collect()]
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(table))
    own = keyed(docs, doc_id, text).select("_id", "_sum", "_text")
    shift, mask, six, low = np.uint64(64 - FILTER_BITS), np.uint64((1 << FILTER_BITS) - 1), np.uint64(6), np.uint64(63)

    def is_set(bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return (bits[spot >> six] >> (spot & low) & np.uint64(1)).astype(bool)

    def run(batch: pa.RecordBatch):
        bits, seen = sent.value, {}
        keep, words, hits, places = [], [], [], []
        for n, body in enumerate(batch.column(2).to_pylist()):
            hashes = word_hashes(body, seen)
            found = [_all_seeds(hashes, masks), *(_all_seeds(hashes, short_masks(k)) for k in short)]
            seed, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            hit = np.flatnonzero(is_set(bits, seed >> shift))
            hit = hit[is_set(bits, seed[hit] & mask)]
            if len(hit):
                keep.append(n)
                words.append(_signed(hashes))
                hits.append(_signed(seed[hit]))
                places.append(at[hit])
        kind = pa.list_(pa.int64())
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(words, kind), pa.array(hits, kind), pa.array(places, kind)], ["_id", "_sum", "words", "hits", "places"])

    typed = own.schema["_id"].dataType.simpleString()
    hit_docs = written(arrow_map(own, run, f"_id {typed}, _sum bigint, words array<bigint>, hits array<bigint>, places array<bigint>"))
    tests = table.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_at"))
    train = hit_docs.select("_id", "_sum", F.explode(F.arrays_zip("hits", "places")).alias("s")).select("_id", "_sum", F.col("s.hits").alias("seed"), F.col("s.places").alias("at"))
    lines = train.join(written(tests), "seed").select("_id", "_sum", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    # the diagonals of a document with an item, at most the words of both, meet the words of both
    grouped = lines.groupBy("_id", "_sum", "item").agg(F.collect_list("diagonal").alias("diagonals"))
    both = on_key(grouped, hit_docs.select("_id", "_sum", "words").dropDuplicates(["_id", "_sum"]), "inner")
    both = on_key(both, table.select("item", F.col("words").alias("item_words")).distinct(), "inner", ("item",))

    def verify(words: pa.Array, item_words: pa.Array, diagonals: pa.Array) -> pa.Array:
        out = []
        for doc, item, ds in zip(words, item_words, diagonals, strict=True):
            doc, item = np.asarray(doc.values), np.asarray(item.values)
            best = max((overlap(doc, item, d, limits.min_identity) for d in ds.as_py()), key=lambda o: (o[2], -o[0]))
            out.append(dict(zip(("start", "n_words", "n_equal"), best, strict=True)))
        return pa.array(out, pa.struct([(k, pa.int64()) for k in ("start", "n_words", "n_equal")]))

    best = F.arrow_udf(verify, "start bigint, n_words bigint, n_equal bigint")("words", "item_words", "diagonals")
    size = F.size("item_words")
    done = both.select("_id", "_sum", "item", size.cast("bigint").alias("item_words"), best.alias("o")).select("_id", "_sum", "item", "item_words", "o.*")
    enough = F.greatest(F.least(F.lit(limits.min_words), F.col("item_words")), F.ceil(F.col("item_words") * limits.min_cover))
    return done.where((F.col("n_words") >= enough) & (F.col("n_equal") >= F.col("n_words") * limits.min_identity)).groupBy("_id", "_sum", "item", "item_words").agg(
        F.max(F.struct("n_equal", (-F.col("start")).alias("before"), "n_words")).alias("o")).select(
        "_id", "_sum", "item", (-F.col("o.before")).alias("start"), "o.n_words", "o.n_equal", "item_words")


def clean_rows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose text overlaps no item."""
    known = docs.columns
    bad = written(find_overlaps(docs, items, doc_id, text, **options).select("_id", "_sum").distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in known]).alias("row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_sum"))
    return on_key(packed, bad, "left_anti").select(*[F.col("row")[c].alias(c) for c in known])
