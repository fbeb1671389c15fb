"""BPE encoding and decoding through a table of distinct words.

A tokenizer that splits text into words before merging gives a word the same ids wherever it stands. The
documents are cut into packs. A pack sends each of its distinct words once, those of one hash bucket in one row, to
the table of words: there every distinct word of the corpus is encoded once, and each pack gets the ids of its
words back. A document keeps its words as places in the pack's list of words, and the ids are joined back
by these places. Decoding joins ids with the vocabulary's pieces; ids are places in the vocabulary, so that join
is a positional one, and the vocabulary, of fixed size, goes to every task.

The rows that meet are packs and buckets, not occurrences: a frequent word is one entry of each pack.

The tokenizer is a file of the tokenizers library with a BPE model behind a splitting pattern; its path is a
parameter, the driver reads it. Its special tokens are found in the raw text first.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows and equal ids keep a row
each; other columns are not read. The rows must be the same each time they are read (a table, a checkpoint):
each pack carries a digest of its words, and a difference raises an error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestframe.llm.texts import sparing

PACK_CHARS = 12_000_000  # characters of the documents of a pack
SLICE_WORDS = 500_000  # words of a pack whose ids are put together at once
#: Up to here NFC changes nothing and the splitting pattern means the same to both regex libraries.
PLAIN = regex.compile("[\x00-ɏ]*")


def _plain_pattern(pattern: str) -> re.Pattern:
    """The splitting pattern for plain texts, with the classes inside its brackets spelled out, which is faster."""
    letters = sorted({c for k in range(0x250) for c in chr(k) + chr(k).lower()})  # lower case leads beyond the plain range
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        own = [c for c in letters if regex.match(kind, c)]
        pattern = pattern.replace(kind, re.escape("".join(own)))
    return re.compile(pattern)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible bytes for themselves, the others, in order, from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Words:
    """What a tokenizer file says about words: how to split a text into them, and the ids of each."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        parts, self._made = json.loads(config), {}
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        split, *rest = parts["pre_tokenizer"]["pretokenizers"]
        self.pattern = _plain_pattern(split["pattern"]["Regex"])
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        bare = parts | {"added_tokens": [], "post_processor": None}
        if [r["type"] for r in rest] != ["ByteLevel"]:
            raise ValueError("only byte-level tokenizers behind one splitting pattern are supported")
        self._parts = {"splitter": bare | {"pre_tokenizer": split}, "encoder": bare | {"normalizer": None, "pre_tokenizer": None}}

    def _tool(self, name: str):
        """A tokenizer for one of both steps, made when it is first needed."""
        from tokenizers import Tokenizer

        if name not in self._made:
            self._made[name] = Tokenizer.from_str(json.dumps(self._parts[name]))
        return self._made[name]

    def _segment(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        tool = self._tool("splitter")
        return [w for w, _ in tool.pre_tokenizer.pre_tokenize_str(tool.normalizer.normalize_str(text))]

    def split(self, text: str | None) -> list[str]:
        """The words of a text in order; special tokens are words of their own."""
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return self._segment(text)
        return [w for k, part in enumerate(self.marks.split(text)) for w in ([part] if k % 2 else self._segment(part))]

    def encode(self, words: list[str]) -> list[list[int]]:
        merge = self._tool("encoder").model.tokenize
        letters = BYTE_LETTERS.__getitem__
        return [[self.special[w]] if w in self.special else [t.id for t in merge("".join(map(letters, w.encode())))] for w in words]


def read_config(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(config: str) -> pa.Array:
    """The piece of every id in order."""
    parts = json.loads(config)
    both = parts["model"]["vocab"] | {t["content"]: t["id"] for t in parts["added_tokens"]}
    out: list[str | None] = [None] * (max(both.values()) + 1)
    for piece, k in both.items():
        out[k] = piece
    return pa.array(out, pa.large_string())


def _packs(batches: Iterator[pa.RecordBatch], tool: Words, buckets: int):
    """Packs of one partition: id, rows of ids, words in order of bucket, their buckets, places of each document's words."""
    number = 0

    def done(rows, places, seen):
        words = list(seen)
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=lambda k: (bucket[k], words[k])), np.int64)
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        return (TaskContext.get().partitionId() << 24) + number, rows, [words[k] for k in order], bucket[order], [rank[p] for p in places]

    rows, places, seen, chars = [], [], {}, 0
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        for row, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = tool.split(text)
            places.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found)))
            rows.append(row.as_py())
            chars += len(text or "")
            if chars >= PACK_CHARS:
                yield done(rows, places, seen)
                rows, places, seen, chars, number = [], [], {}, 0, number + 1
    if rows:
        yield done(rows, places, seen)


def _digest(joined: str) -> int:
    return xxhash.xxh3_64_intdigest(joined) >> 1


def encode(docs: DataFrame, config: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """The id column and `ids`, an array of token ids, of every row."""
    spark = docs.sparkSession
    own = docs.select(doc_id, text)
    kind = docs.schema[doc_id].dataType
    typed = kind.simpleString()
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(config)
    width = np.uint16 if len(pieces(config)) <= 1 << 16 else np.uint32

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, rows, listed, bucket, places in _packs(batches, Words(sent.value), n):
            flat = np.concatenate(places) if places else np.empty(0, np.int32)
            packed = pa.compress(flat.tobytes(), "zstd", asbytes=True)
            runs = _runs(bucket)
            parts = [" ".join(listed[a:b]) for a, b in runs]
            yield pa.RecordBatch.from_arrays([
                pa.array([pack], pa.int64()), pa.array([rows], pa.list_(batch_type)), pa.array([[len(p) for p in places]], pa.list_(pa.int64())),
                pa.array([packed], pa.binary()), pa.array([4 * len(flat)], pa.int64()),
                pa.array([[int(bucket[a]) for a, _ in runs]], pa.list_(pa.int32())), pa.array([parts], pa.list_(pa.string()))],
                ["pack", "rows", "lengths", "places", "size", "buckets", "words"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, used, parts in zip(*(batch.column(k).to_pylist() for k in (0, 5, 6)), strict=True):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "pack": pa.array([pack] * len(used), pa.int64()), "words": pa.array(parts, pa.string())})

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = Words(sent.value), {}
        for batch in batches:
            sizes, ids, digests = [], [], []
            for joined in batch.column(2).to_pylist():
                listed = joined.split(" ")
                new = [w for w in listed if w not in known]
                for w, got in zip(new, tool.encode(new), strict=True):
                    known[w] = np.array(got, width).tobytes()
                found = [known[w] for w in listed]
                sizes.append((np.fromiter(map(len, found), np.uint32, len(found)) // width().itemsize).tobytes())
                ids.append(b"".join(found))
                digests.append(_digest(joined))
            yield pa.RecordBatch.from_pydict({"pack": batch.column(1), "bucket": batch.column(0), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary()), "digest": pa.array(digests, pa.int64())})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in right["sizes"].to_pylist()] or [np.empty(0, np.uint32)]).astype(np.int32)
        flat = np.frombuffer(b"".join(right["ids"].to_pylist()), width)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        out_rows, out_ids = [], []
        for pack in left.select(["rows", "lengths", "places", "size", "words"]).to_pylist():
            if [_digest(w) for w in pack["words"]] != right["digest"].to_pylist():
                raise ValueError("the rows of a pack changed between two reads; write the input first")
            places = np.frombuffer(pa.decompress(pack["places"], pack["size"], "zstd", asbytes=True), np.int32)
            ends = np.cumsum([0, *pack["lengths"]])
            first = 0
            while first < len(pack["rows"]):  # whole documents of about SLICE_WORDS words
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_WORDS, "right")) - 1)
                mine = places[ends[first] : ends[last]]
                count = sizes[mine]
                upto = np.cumsum(count, dtype=np.int64)
                take = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[mine] - (upto - count), count)
                limits = np.concatenate([[0], upto])[ends[first : last + 1] - ends[first]]
                out_ids.append(pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(flat[take].astype(np.int32))))
                out_rows.append(pa.array(pack["rows"][first:last], batch_type))
                first = last
        pa.default_memory_pool().release_unused()
        return pa.table({doc_id: pa.chunked_array(out_rows, batch_type), "ids": pa.chunked_array(out_ids, pa.list_(pa.int32()))})

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    shape = f"pack bigint, rows array<{typed}>, lengths array<bigint>, places binary, size bigint, buckets array<int>, words array<string>"
    # one exchange, read for the words and for the join: `ask` takes whole rows, so that both read the same columns
    packs = own.mapInArrow(texts, shape).repartition(n, "pack")
    asked = packs.mapInArrow(ask, "bucket int, pack bigint, words string")
    found = asked.repartition(n, "bucket").mapInArrow(look_up, "pack bigint, bucket int, sizes binary, ids binary, digest bigint")
    return packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(join, f"{doc_id} {typed}, ids array<int>")


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def decode(ids: Column, config: str) -> Column:
    """The pieces of an array of ids, joined by blanks as the library does for a tokenizer without a decoder."""
    table = pieces(config)

    def run(lists: pa.Array) -> pa.Array:
        out, blank = [], pa.scalar(" ", pa.large_string())
        for at in range(0, len(lists), 256):
            part = lists.slice(at, 256)
            part = pc.fill_null(part, []) if part.null_count else part
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))])
            out.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges.astype(np.int64)), table.take(part.flatten())), blank).cast(pa.string()))
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return F.arrow_udf(sparing(run), "string")(ids)
