"""Phrase collocations by the SON partition scheme.

Documents fall into `shards` by a hash of the row. Every shard is mined completely at the support lowered in proportion,
s = ceil(support / shards): a phrase that stays under s in every shard stays under `support` altogether, since
shards * (s - 1) < support, whatever the sizes of the shards. Mining a shard goes level by level: two-word phrases are
counted first; three-word phrases only where both of their two-word parts are frequent in the shard. Shards are mined side
by side, as a part of the counted key, so a shard is as distributed as the whole. What is frequent in some shard is the
candidate set, and a last pass over all texts counts the candidates exactly, by their words.

While mining, a phrase is a 62-bit hash of its language and words; phrases that collide are counted together and at worst become
candidates in vain. Tasks see the frequent keys as a bitmap of about eight bits a key, at most 2^28 bits; a crowded bitmap
lets more candidates pass, and results stay the same. The last pass numbers the words of a slice, so that its phrases are
exact codes, and sums are grouped by the words themselves.

Defined results: a null text has no words; a null language is `und`; every row counts, repeated rows and equal ids too; an
empty table and one without candidates give no row; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestframe.llm.texts import bitmap_of, held, sparing, written

SUPPORT, SHARDS, TOP = 10, 4, 2000
SLICE_WORDS = 1_200_000  # words that a task works on at once
ROWS = 100_000  # phrases that a task hands on at once
BUCKETS = 64  # parts in which the best phrases of a language are looked for first
MOST_BITS = 28
#: Byte table: A-Z become lower case, piece ends become full stops; no other byte changes.
PIECE_BYTES = bytes(46 if b in b".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STOP = b"."


class _Numbers(dict):
    """Numbers words as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__()
        self[_STOP] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def piece_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with b"." where a piece ends."""
    words = text.encode().translate(PIECE_BYTES).replace(_STOP, b" . ").split() if text else []
    return [*words, _STOP]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and that of the last."""
    return _mixed(left * np.uint64(3) + right)


class _Slice:
    """Word numbers of several documents in a row, each with its language and shard."""

    def __init__(self):
        self.numbers, self.ids, self.lengths, self.langs, self.shards = _Numbers(), array("i"), [], [], []

    def add(self, text: str | None, lang: str, shard: int) -> None:
        words = piece_words(text)
        self.ids.extend(map(self.numbers.__getitem__, words))
        self.lengths.append(len(words))
        self.langs.append(lang)
        self.shards.append(shard)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, and a hash of word and language, of every place."""
        ids = np.frombuffer(self.ids, np.int32)
        own = np.fromiter(map(xxhash.xxh64_intdigest, self.numbers), np.uint64, len(self.numbers))
        seeds = {x: xxhash.xxh64_intdigest(x.encode(), 1) for x in set(self.langs)}
        seed = np.repeat(np.array([seeds[x] for x in self.langs], np.uint64), self.lengths)
        return ids, _mixed(own[ids] ^ seed)


@sparing
def trimmed() -> None:
    """Gives the memory of a finished slice back."""


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    part = _Slice()
    for batch in batches:
        for k in range(batch.num_rows):
            part.add(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
            if len(part.ids) >= SLICE_WORDS:
                yield part
                del part
                part = _Slice()
    if part.ids:
        yield part


def _sharded(keys: np.ndarray, part: _Slice, shards: int) -> np.ndarray:
    """The phrase hash with the shard in place of its upper bits."""
    low = np.uint64((1 << 64) - 1 >> _shard_bits(shards))
    shard = np.repeat(np.array(part.shards, np.uint64), part.lengths)[: len(keys)]
    return (keys & low) | shard << np.uint64(64 - _shard_bits(shards))


def _shard_bits(shards: int) -> int:
    return max(1, (shards - 1).bit_length())


def _own(docs: DataFrame, text: str, lang: str, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.col(text), F.lit(7)), F.lit(shards)).cast("int")
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), shard.alias("shard"))


def _mined(own: DataFrame, shards: int, least: int, level: int, pairs: Broadcast | None = None) -> DataFrame:
    """key: the phrases of `level` words that reach `least` occurrences in a shard."""

    @sparing
    def counted(part: _Slice) -> pa.RecordBatch:
        ids, word = part.arrays()
        word_like = ids > 0
        keys, valid = _joined(word[:-1], word[1:]), word_like[:-1] & word_like[1:]
        if level == 3:
            two = valid.copy()
            two[valid] = held(pairs.value, _sharded(keys, part, shards)[valid])
            keys, valid = _joined(keys[:-1], word[2:]), two[:-1] & two[1:]
        found, n = np.unique(_sharded(keys, part, shards)[valid], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield counted(part)

    return own.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """lang, words (1 to 3), phrase, f: all phrases with at least `support` occurrences, as a written table."""
    own = _own(docs, text, lang, shards)
    sc = docs.sparkSession.sparkContext
    least = -(-support // shards)
    pairs = written(_mined(own, shards, least, 2))
    pair_bits = sc.broadcast(bitmap_of(pairs, MOST_BITS))
    triples = written(_mined(own, shards, least, 3, pair_bits))
    low = (1 << 64 - _shard_bits(shards)) - 1
    wanted = [sc.broadcast(bitmap_of(x.select(F.col("key").bitwiseAND(low).alias("key")), MOST_BITS)) for x in (pairs, triples)]

    def phrases(part: _Slice) -> Iterator[pa.RecordBatch]:
        all_ids, word = part.arrays()
        names = np.array(list(part.numbers), object)
        wide = np.int64(len(names))
        ends = np.cumsum(part.lengths)
        for group in sorted(set(part.langs)):
            at = np.concatenate([np.arange(b - n, b) for b, n, x in zip(ends, part.lengths, part.langs, strict=True) if x == group])
            ids, last = all_ids[at].astype(np.int64), word[at]
            valid, key = ids > 0, last
            for level in (1, 2, 3):
                chosen = np.flatnonzero(valid)
                if level > 1:
                    key, valid = _joined(key[:-1], last[level - 1 :]), valid[:-1] & (ids[level - 1 :] > 0)
                    chosen = np.flatnonzero(valid & held(wanted[level - 2].value, key & np.uint64(low)))
                # number what stands before the last word, so that codes fit for any number of words
                heads, head = np.zeros((1, 0), np.int64), np.zeros(len(chosen), np.int64)
                for k in range(level):
                    codes, place, n = np.unique(head * wide + ids[chosen + k], return_inverse=True, return_counts=True)
                    heads, head = np.column_stack([heads[codes // wide], codes % wide]), place
                for k in range(0, len(n), ROWS):
                    some = heads[k : k + ROWS]
                    texts = names[some[:, 0]]
                    for j in range(1, level):
                        texts = texts + b" " + names[some[:, j]]
                    phrase = pa.array(texts.tolist(), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([group] * len(some), pa.string()), pa.array(np.full(len(some), level, np.int32)), phrase, pa.array(n[k : k + ROWS].astype(np.int64))], ["lang", "words", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield from phrases(part)
            trimmed()

    counts = own.mapInArrow(run, "lang string, words int, phrase string, n bigint").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    # single words stay with any count here: their sum is the number of words
    return written(counts.where((F.col("words") == 1) | (F.col("f") >= support)))


def cut_score() -> Column:
    """floor(10^6 a a / (l r)), exactly, for counts under 10^15."""
    a, left, right = (F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r"))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of each language.

    A candidate is as good as its worst cut; one of whose occurrences half or more stand in a longer candidate is dropped.
    """
    freq = frequent_phrases(docs, text, lang, support, shards)
    totals = freq.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = freq.where(F.col("f") >= support).select("lang", "phrase", "f")
    w = F.split("phrase", " ")

    def phrase(start: int, size: int) -> Column:
        return F.array_join(F.slice(w, start, size), " ")

    cand = freq.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words")
    cuts = cand.where("words = 2").select("lang", "phrase", "a", "words", F.lit(1).alias("k"), phrase(1, 1).alias("first"), phrase(2, 1).alias("rest"))
    cuts = cuts.unionByName(cand.where("words = 3").select("lang", "phrase", "a", "words", F.lit(1).alias("k"), phrase(1, 1).alias("first"), phrase(2, 2).alias("rest")))
    cuts = cuts.unionByName(cand.where("words = 3").select("lang", "phrase", "a", "words", F.lit(2).alias("k"), phrase(1, 2).alias("first"), phrase(3, 1).alias("rest")))
    halves = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    halves = halves.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])

    scored = halves.withColumn("score", cut_score())
    worst = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.explode(F.array(F.struct(phrase(1, 2).alias("part")), F.struct(phrase(2, 2).alias("part"))))
    longer = cand.where("words = 3").select("lang", "a", inner.alias("x")).groupBy("lang", F.col("x.part").alias("phrase")).agg(F.max("a").alias("inside"))
    left = worst.join(longer, ["lang", "phrase"], "left").where("inside is null or 100 * inside < 50 * a")
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = (F.desc("score"), F.desc("a"), F.col("phrase"))
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    few = rows.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
