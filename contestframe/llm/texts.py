"""Helpers the text operators share: byte classes, row keys, Arrow batches and written tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestframe.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "[\\x20\\x09-\\x0D]+"
#: Byte table: A-Z become lower case, ASCII bytes that are neither letter nor digit become spaces.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def blank_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but ASCII white space (space, tab to carriage return), as UTF-8."""
    raw = text.encode() if text else b""
    return (raw.translate(LOWER_BYTES) if lower else raw).split()


def keyed(docs: DataFrame, doc_id: str, text: str, host: str | None = None, *carry: str) -> DataFrame:
    """Columns `_id`, `_text` and `_sum`, the text's hash; `host` where it is named, and what is carried.

    Rows equal in `_id` and `_sum` are repeated rows.
    """
    more = [F.col(host).alias("host")] if host else []
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_sum"), *more, *carry)


def on_key(left: DataFrame, right: DataFrame, how: str = "left", cols: tuple[str, ...] = ("_id", "_sum")) -> DataFrame:
    """Join on key columns that may be null; the key columns of the left side stay."""
    other = right.select(*[F.col(c).alias(f"{c}_r") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        same = left[c].eqNullSafe(other[f"{c}_r"])
        cond = same if cond is None else cond & same
    return left.join(other, cond, how).drop(*[f"{c}_r" for c in cols])


def sparing(fn: Callable) -> Callable:
    """The function, giving freed memory back to the system after each batch: idle Python workers would keep it."""

    @functools.wraps(fn)
    def run(*args):
        out = fn(*args)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
        return out

    return run


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """Runs `fn` on Arrow batches; it yields dicts of columns (lists or arrays) in the order of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_pydict(cols) if not isinstance(cols, pa.RecordBatch) else cols

    return df.mapInArrow(run, schema)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back.

    The table cuts the lineage, survives lost executors, and its size is known to the planner: Spark
    broadcasts it in a join only while it is under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; the driver's garbage collector tells it which."""
    gc.collect()
    spark._jvm.System.gc()


def bitmap_of(keys: DataFrame, most_bits: int = 28) -> np.ndarray:
    """A bitmap of the column `key` for tasks: a power of two of bits, eight to sixteen a key, at most 2^most_bits."""
    bits = min(most_bits, max(12, (8 * keys.count()).bit_length()))
    at = F.col("key").bitwiseAND((1 << bits) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    found = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold each key (unsigned 64-bit numbers)."""
    at = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def recounted(docs: DataFrame) -> DataFrame:
    """The documents with n_chars set to the length of the text, where both columns exist."""
    if not {"n_chars", "text"} <= set(docs.columns):
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))
