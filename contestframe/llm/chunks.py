"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes is taken at every ASCII white space; where it falls below a threshold
a chunk ends, so cuts depend on the text around them only and an insertion moves no cut behind it. Chunks are compared
by a 128-bit digest. One pass over the texts writes the chunks of every document as lists; all that follows reads these.
One half of the digests is counted, map-side first, and a bitmap of those that occur again tells tasks which runs of chunks
can be passages; only the chunks of these runs, and the documents that hold such chunks, go on to the exact comparison by
the whole digest. Of the documents with a chunk the one
with the smallest id keeps it. Runs of neighbouring chunks that others keep are repeated passages, if the
run and the chunks on both sides of it, into which the passage may reach, have `min_words` words together and
one document keeps most of the run. A chunk that a run repeats is counted once there. In the other runs, whose
chunks several documents keep, every shortest stretch of chunks that is long enough by the same measure is looked
up as a whole: it is repeated if a single document with a smaller id holds all of it in this order.

Defined results: null and empty texts have no chunk; a text without a cut is one chunk; repeats within one
document only are no finding; equal ids with different texts are different documents, equal rows are one; null
ids count as smallest; other columns are carried by `remove_repeats` and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestframe.llm.texts import arrow_map, bitmap_of, held, keyed, on_key, released, sparing, written

MEAN_WORDS = 5  # words between two cuts
MIN_WORDS = 50  # words of a passage
MIN_RUN = 8  # words of a run in whole chunks
FILTER_BITS = 26  # largest bitmap that filters rows, as a power of two
PART = 256  # texts worked on at once
STRETCH = ("seq", "n", "start", "end", "n_words", "sum_low", "sum_high", "offset", "low", "high")
#: One 16-bit number for each byte value, from its hash.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) & 0xFFFF for b in range(256)], np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the last 16 bytes' numbers, each shifted by its age."""
    out = GEAR[raw]
    for step in (1, 2, 4, 8):
        shifted = out.copy()
        shifted[step:] += out[:-step] << np.uint16(step)
        out = shifted
    return out


def cut(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """Ends of the chunks in code points, words and bytes of each chunk."""
    whole = text.encode()
    raw = np.frombuffer(whole, np.uint8)
    blank = _BLANK[raw]
    cuts = np.flatnonzero(blank & (gear_hash(raw) < 65536 // MEAN_WORDS)) + 1
    ends = cuts if len(cuts) and cuts[-1] == len(raw) else np.append(cuts, len(raw))
    begins = ~blank
    begins[1:] &= blank[:-1]
    words = np.diff(np.cumsum(begins)[ends - 1], prepend=0)
    points = np.cumsum((raw & 0xC0) != 0x80)[ends - 1]
    return points.tolist(), words.tolist(), [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def chunk_lists(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _sum and, one value per chunk, low, high (digest), end and words of every text."""
    own = keyed(docs, doc_id, text).where("_text <> ''").select("_id", "_sum", "_text")

    @sparing
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list[np.ndarray]] = [[], [], [], []]
        for body in batch.column(2):
            ends, words, parts = cut(body.as_py())
            digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)
            for out, x in zip(rows, (digest[:, 0], digest[:, 1], ends, words), strict=True):
                out.append(np.asarray(x, np.int64))
        starts = pa.array(np.cumsum([0, *map(len, rows[0])]), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in rows]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["_id", "_sum", "low", "high", "end", "words"])

    def run(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, PART):
            yield part(batch.slice(k, PART))

    typed = own.schema["_id"].dataType.simpleString()
    return arrow_map(own, run, f"_id {typed}, _sum bigint, low array<bigint>, high array<bigint>, end array<bigint>, words array<bigint>")


def keys_at(batch: pa.RecordBatch, rows: Sequence[int]) -> pa.RecordBatch:
    """The two key columns of the rows, as often as they are named. With its lists a document would be copied whole for each of its chunks."""
    return batch.select([0, 1]).take(pa.array(rows, pa.int64()))


def repeated_chunks(lists: DataFrame, wanted: Broadcast, min_words: int, min_run: int) -> DataFrame:
    """Rows of the chunks whose low half is in the bitmap: _id, _sum, seq, low, high, start, end, words, and the words of both neighbours.

    Only runs of such chunks that can be a passage, by their words and those of the chunks beside them, are taken: a repeated run
    is a part of one.
    """
    names = ["seq", "low", "high", "start", "end", "words", "before", "after"]

    @sparing
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        low, high, end, words = (batch.column(k).flatten().to_numpy() for k in range(2, 6))
        first = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        seq = np.arange(len(low)) - first[row]
        last = seq == sizes[row] - 1
        start, before = (np.where(seq == 0, 0, np.roll(x, 1)) for x in (end, words))
        after = np.where(last, 0, np.roll(words, -1))
        again = held(wanted.value, low.view(np.uint64))
        heads = again & ((seq == 0) | ~np.roll(again, 1))
        tails = again & (last | ~np.roll(again, -1))
        run = np.cumsum(heads) - 1
        total = np.bincount(run[again], words[again], minlength=heads.sum())
        long = (total >= min_run) & (total + before[heads] + after[tails] >= min_words)
        at = np.flatnonzero(again)
        at = at[long[run[at]]]
        kept = keys_at(batch, row[at])
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *(pa.array(x[at]) for x in (seq, low, high, start, end, words, before, after))], ["_id", "_sum", *names])

    def run_(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, PART):
            yield part(batch.slice(k, PART))

    typed = lists.schema["_id"].dataType.simpleString()
    return arrow_map(lists.select("_id", "_sum", "low", "high", "end", "words"), run_, f"_id {typed}, _sum bigint, " + ", ".join(f"{c} bigint" for c in names))


def holders(lists: DataFrame, wanted: Broadcast) -> DataFrame:
    """_id, _sum, low, high, n: the chunks of every document whose low half is in the bitmap, and how often it holds them."""

    @sparing
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        low, high = (batch.column(k).flatten().to_numpy() for k in (2, 3))
        at = np.flatnonzero(held(wanted.value, low.view(np.uint64)))
        found, n = np.unique(np.column_stack([np.repeat(np.arange(len(sizes)), sizes)[at], low[at], high[at]]), axis=0, return_counts=True)
        kept = keys_at(batch, found[:, 0])
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found[:, 1].copy()), pa.array(found[:, 2].copy()), pa.array(n)], ["_id", "_sum", "low", "high", "n"])

    def run(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, PART):
            yield part(batch.slice(k, PART))

    typed = lists.schema["_id"].dataType.simpleString()
    return arrow_map(lists.select("_id", "_sum", "low", "high"), run, f"_id {typed}, _sum bigint, low bigint, high bigint, n bigint")


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """_id, _sum, start, end (code points), n_words, first_id: passages that other documents keep.

    `first_id` keeps the most words of the passage; a chunk of a few common words may have another keeper.
    """
    lists = written(chunk_lists(docs, doc_id, text))
    again = written(lists.select(F.explode("low").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    sc = docs.sparkSession.sparkContext
    released(docs.sparkSession)
    seen = written(repeated_chunks(lists, sc.broadcast(bitmap_of(again)), min_words, min_run))
    in_runs = written(seen.select(F.col("low").alias("key")).distinct())
    first = F.min(F.struct("_id", "_sum"))
    owners = holders(lists, sc.broadcast(bitmap_of(in_runs))).groupBy("low", "high").agg(first.alias("first"), F.max(F.struct("_id", "_sum")).alias("last"), F.sum("n").alias("held")).where("first <> last or (first <=> last) is null")
    kept = written(owners.select("low", "high", "first", "held"))
    released(docs.sparkSession)
    others = seen.join(kept, ["low", "high"]).where(~F.struct("_id", "_sum").eqNullSafe(F.col("first")))
    # one exchange by document serves repeated rows, runs and what is summed by document
    places = others.select("_id", "_sum", "seq", "low", "high", "start", "end", "words", "before", "after", "held", F.col("first._id").alias("owner")).repartition("_id", "_sum").dropDuplicates(["_id", "_sum", "seq"])
    doc = Window.partitionBy("_id", "_sum").orderBy("seq")
    placed = written(places.withColumn("run", F.col("seq") - F.row_number().over(doc)))
    del places, others
    released(docs.sparkSession)
    once = placed.groupBy("_id", "_sum", "run", "owner", "low", "high").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.max("words").alias("fresh"),
        F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"))
    parts = once.groupBy("_id", "_sum", "run", "owner").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.sum("fresh").alias("fresh"),
        F.min_by("before", "start").alias("before"), F.max_by("after", "end").alias("after"))
    runs = parts.groupBy("_id", "_sum", "run").agg(
        F.min_by("before", "start").alias("before"), F.max_by("after", "end").alias("after"),
        F.min_by("owner", F.struct(-F.col("fresh"), "owner")).alias("first_id"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.sum("fresh").alias("fresh"), F.max("fresh").alias("most"))
    # chunks that meet by chance have a keeper each, those of a passage mostly the same one; one that repeats counts once
    whole = (F.col("most") >= min_run) & (F.col("most") * 2 > F.col("fresh"))
    long = written(runs.where((F.col("fresh") >= min_run) & (F.col("n_words") + F.col("before") + F.col("after") >= min_words)).withColumn("whole", whole))
    released(docs.sparkSession)
    names = ["_id", "_sum", "start", "end", "n_words", "first_id"]
    parted = long.where("not whole").select("_id", "_sum", "run")
    mixed = on_key(among(placed, parted, "_id", "_sum", "run"), parted, "left_semi", ("_id", "_sum", "run"))
    return long.where("whole").select(*names).unionByName(held_whole(mixed, seen, lists, min_words, min_run).select(*names))


def among(rows: DataFrame, wanted: DataFrame, *cols: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be among the wanted ones, by a bitmap sized by these, of 2^FILTER_BITS at most: spares a shuffle of the others.

    With "left_anti" as `how`, exactly the others."""
    key = F.xxhash64(*cols)
    bits = bitmap_of(wanted.select(key.alias("key")), FILTER_BITS).view(np.int64)
    table = rows.sparkSession.createDataFrame([(bits.tolist(),)], "bits array<bigint>")
    bit = key.bitwiseAND(len(bits) * 64 - 1)
    shift = F.call_function("shiftrightunsigned", F.get("bits", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int"))
    return rows.join(F.broadcast(table), shift.bitwiseAND(1) == 1, how)


def stretches(mixed: DataFrame, min_words: int, min_run: int) -> DataFrame:
    """_id, _sum, seq, n, start, end, n_words, digest, and the place and digest of the chunk with the fewest holders: from every
    chunk of the runs the shortest stretch that is long enough with the chunks beside it."""
    fields = ("seq", "low", "high", "start", "end", "words", "before", "after", "held")
    lists = mixed.groupBy("_id", "_sum", "run").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("c"))

    @sparing
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(2)
        starts, flat = column.offsets.to_numpy(), column.flatten()
        values = [flat.field(k).to_numpy() for k in range(len(fields))]
        rows, out = [], []
        for row in range(batch.num_rows):
            a, b = starts[row] - starts[0], starts[row + 1] - starts[0]
            digests = np.column_stack([values[1][a:b], values[2][a:b]])
            seq, low, high, start, end, size, before, after, held_by = (x[a:b].tolist() for x in values)
            words = n = fresh = 0
            inside: dict[tuple, int] = {}
            for at in range(b - a):
                while n < b - a and (fresh < min_run or words + before[at] + after[n - 1] < min_words):
                    key = low[n], high[n]
                    inside[key] = inside.get(key, 0) + 1
                    fresh += size[n] if inside[key] == 1 else 0
                    words += size[n]
                    n += 1
                if fresh < min_run or words + before[at] + after[n - 1] < min_words:
                    break
                rare = min(range(at, n), key=lambda k: (held_by[k], -size[k], k))
                digest = np.frombuffer(xxhash.xxh3_128_digest(digests[at:n].tobytes()), np.int64).tolist()
                rows.append(row)
                out.append((seq[at], n - at, start[at], end[n - 1], words, *digest, rare - at, low[rare], high[rare]))
                key = low[at], high[at]
                inside[key] -= 1
                fresh -= size[at] if inside[key] == 0 else 0
                words -= size[at]
        kept = keys_at(batch, rows)
        columns = list(zip(*out, strict=True)) or [()] * len(STRETCH)
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *(pa.array(x, pa.int64()) for x in columns)], ["_id", "_sum", *STRETCH])

    def run(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, PART):
            yield part(batch.slice(k, PART))

    typed = mixed.schema["_id"].dataType.simpleString()
    return arrow_map(lists.select("_id", "_sum", "c"), run, f"_id {typed}, _sum bigint, " + ", ".join(f"{c} bigint" for c in STRETCH))


def stretch_digests(lists: DataFrame, spots: DataFrame) -> DataFrame:
    """_id, _sum, sum_low, sum_high: the digests of the stretches of n chunks that begin at the chunks `at`."""
    grouped = written(spots.groupBy("_id", "_sum").agg(F.collect_set(F.struct("at", "n")).alias("spots")))
    both = on_key(among(lists, grouped, "_id", "_sum").select("_id", "_sum", "low", "high"), grouped, "inner")

    @sparing
    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = [], []
        for row in range(batch.num_rows):
            digests = np.column_stack([batch.column(k)[row].values.to_numpy() for k in (2, 3)])
            for spot in batch.column(4)[row].as_py():
                if spot["at"] + spot["n"] <= len(digests):
                    rows.append(row)
                    out.append(xxhash.xxh3_128_digest(digests[spot["at"] : spot["at"] + spot["n"]].tobytes()))
        found = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
        kept = keys_at(batch, rows)
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], ["_id", "_sum", "sum_low", "sum_high"])

    def run(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, PART):
            yield part(batch.slice(k, PART))

    typed = lists.schema["_id"].dataType.simpleString()
    return arrow_map(both.select("_id", "_sum", "low", "high", "spots"), run, f"_id {typed}, _sum bigint, sum_low bigint, sum_high bigint")


def held_whole(mixed: DataFrame, seen: DataFrame, lists: DataFrame, min_words: int, min_run: int) -> DataFrame:
    """Passages of the mixed runs of which one document with a smaller id holds every chunk, in order.

    Places with the rarest chunk of a stretch give the stretches of the same shape there; a stretch belongs to the
    smallest document that has its digest. Work grows with places and shapes, not with pairs of documents.
    """
    wanted = written(stretches(mixed, min_words, min_run))
    shapes = written(wanted.select("low", "high", "offset", "n").distinct())
    spots = among(seen, shapes, "low", "high").join(shapes, ["low", "high"]).select("_id", "_sum", (F.col("seq") - F.col("offset")).alias("at"), "n").where("at >= 0").distinct()
    sums = stretch_digests(lists, spots)
    first = sums.join(wanted.select("sum_low", "sum_high").distinct(), ["sum_low", "sum_high"], "left_semi").groupBy("sum_low", "sum_high").agg(F.min(F.struct("_id", "_sum")).alias("first"))
    found = wanted.join(written(first), ["sum_low", "sum_high"]).where(~F.struct("_id", "_sum").eqNullSafe(F.col("first")))
    # stretches that share a chunk are one passage
    doc = Window.partitionBy("_id", "_sum").orderBy("seq", "n")
    last = F.max(F.col("seq") + F.col("n") - 1).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    joined = found.withColumn("new", F.when(last >= F.col("seq"), 0).otherwise(1)).withColumn("passage", F.sum("new").over(doc))
    spans = joined.groupBy("_id", "_sum", "passage").agg(
        F.min("seq").alias("seq"), F.max(F.col("seq") + F.col("n") - 1).alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    keepers = joined.groupBy("_id", "_sum", "passage", F.col("first._id").alias("first_id")).agg(F.count("*").alias("n")).groupBy("_id", "_sum", "passage").agg(F.min_by("first_id", F.struct(-F.col("n"), "first_id")).alias("first_id"))
    spans = written(on_key(spans, keepers, "inner", ("_id", "_sum", "passage")))
    sized = on_key(spans, among(lists, spans, "_id", "_sum").select("_id", "_sum", F.col("words").alias("sizes")), "inner")
    own = F.slice("sizes", (F.col("seq") + 1).cast("int"), (F.col("last") - F.col("seq") + 1).cast("int"))
    return sized.select("_id", "_sum", "start", "end", "first_id", F.aggregate(own, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("n_words")).distinct()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without their repeated passages; the first document keeps them."""
    known = docs.columns
    found = find_repeats(docs, doc_id, text, **options).groupBy("_id", "_sum").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in known]).alias("row"), F.col(text).alias("body"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_sum"))
    both = on_key(packed, found)
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.length("body").cast("bigint")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substr(F.col("body"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    done = both.withColumn("body", F.when(F.col("cuts").isNull(), F.col("body")).otherwise(kept))
    return done.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in known])
