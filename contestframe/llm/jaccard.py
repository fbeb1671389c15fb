"""Jaccard join over word n-grams through groups of equal prefixes.

A document is the set of its distinct shingles, as 64-bit hashes. Documents with equal sets are one class. Shingles have
one global order: by the count of their rarest word in all documents (words below a share of 1 / SHARE of all words count as
rarest), then by hash; of two sets that reach the threshold, one of the first n - ceil(t n) + 1 shingles, the prefix, is
common. Classes with the same prefix and size are one group, so only groups meet at the shingles of their prefixes.

All members of a group of near copies resemble each other, so pairs are never listed where a chain will do. In each round,
every member of a group is paired with one leader of it, and in every bucket (a prefix shingle and a range of sizes) every group
with one leader. Only shingles at which a first common one of a link can stand, by its place and the sizes of its holders,
make buckets. Pairs are filtered by size, by the places of their shingle and by the Hamming distance of a 512-bit parity sketch, which never exceeds the
symmetric difference, then by sketches as long as the sets, and verified on the sets; links give components; a further
round, with another leader in each bucket, takes the buckets in which some groups are linked and others are not. At last these buckets are expanded to their members, and those outside a bucket's
largest component meet all members of other components, filtered in the join and verified. So whatever can be linked is either
verified or known to be connected; no link that joins two components is lost.

The counts of frequent words go to all tasks: there are at most SHARE of them. Sets are made again, from the texts, for
classes in filtered pairs only.

Defined results: null and empty texts and those without a word have an empty set and a component of their own; texts under
n words are one shingle; every row is a document: repeated rows give repeated results, equal ids with different
texts are different documents; null ids count as largest for component ids; other columns are not read; an empty
table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestframe.llm.chunks import among
from contestframe.llm.components import components
from contestframe.llm.texts import arrow_map, blank_words, keyed, on_key, released, sparing, written

SHINGLE, PERCENT = 3, 90
SHARE = 500_000  # words rarer than 1 / SHARE are not told apart
ROUNDS = 2
HELD = 400_000  # distinct words that a task holds before it hands counts on
LANES = 8  # 64-bit parts of a sketch
PART = 256  # texts worked on at once
SKETCH = [f"s{k}" for k in range(LANES)]


def word_classes(docs: DataFrame, text: str) -> dict[bytes, int]:
    """Twice the binary logarithm of the count of every frequent word, whole; at most SHARE words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for k in range(batch.num_rows):
                found.update(blank_words(batch.column(0)[k].as_py(), lower=True))
                if len(found) >= HELD:
                    yield rows(found)
                    found = Counter()
        if found:
            yield rows(found)

    @sparing
    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counts = written(docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.col("n") > 1) & (F.col("n") * SHARE >= total)).toArrow()
    return {w: (n * n).bit_length() for w, n in zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of every shingle in order; fewer words than `size` are one."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * np.uint64(3) + own[k : len(own) - size + k + 1])
    return out


def parities(found: np.ndarray, size: int) -> np.ndarray:
    """Parity sketch of a set in 64-bit parts; `size`, a power of two, is its number of bits."""
    bits = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(np.int64)


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two parity sketches differ; the longer one is folded to the length of the other."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def needed(n: int, percent: int) -> int:
    """Length of the prefix of a set of n."""
    return n - -(-n * percent // 100) + 1


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """_id, _sum, n, digest of the set, digest of the group, prefix and sketch of every row."""
    held = docs.sparkSession.sparkContext.broadcast(word_classes(docs, text))

    def one(text: str | None) -> tuple:
        words = blank_words(text, lower=True)
        if not words:
            return 0, None, None, None, *[None] * LANES
        rank = held.value
        hashes = shingle_hashes(words, size)
        each = np.fromiter((rank.get(w, 0) for w in words), np.int64, len(words))
        least = each[: len(hashes)]
        for k in range(1, min(size, len(words))):
            least = np.minimum(least, each[k : k + len(hashes)])
        found, at = np.unique(hashes, return_index=True)
        n = len(found)
        prefix = found[np.lexsort((found, least[at]))[: needed(n, percent)]].view(np.int64)
        sketch = parities(found, 64 * LANES).tolist()
        return n, xxhash.xxh3_128_digest(found.tobytes()), xxhash.xxh3_128_digest(prefix.tobytes(), n), prefix, *sketch

    @sparing
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, group, prefix, *sketch = zip(*map(one, batch.column(2).to_pylist()), strict=True)
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * LANES)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip((n, digest, group, prefix, *sketch), kinds, strict=True))], ["_id", "_sum", "n", "digest", "group", "prefix", *SKETCH])

    def run(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, PART):
            yield rows(batch.slice(k, PART))

    own = keyed(docs, doc_id, text).select("_id", "_sum", "_text")
    typed = own.schema["_id"].dataType.simpleString()
    return arrow_map(own, run, f"_id {typed}, _sum bigint, n bigint, digest binary, group binary, prefix array<bigint>, " + ", ".join(f"{s} bigint" for s in SKETCH))


def _resembling(left: str, right: str, percent: int) -> Column:
    """Sizes and sketches of two classes leave the threshold possible."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    apart = sum((F.bit_count(a(s).bitwiseXOR(b(s))).cast("bigint") for s in SKETCH[1:]), F.bit_count(a("s0").bitwiseXOR(b("s0"))).cast("bigint"))
    sizes = (F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * percent)
    return sizes & (apart * (100 + percent) <= (a("n") + b("n")) * (100 - percent))


def _reaching(left: str, right: str, percent: int) -> Column:
    """What two sets have from the place of a common shingle on leaves the threshold possible; it holds at the first one of any link."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    return F.least(a("n") - a("at"), b("n") - b("at")) * (100 + percent) >= (a("n") + b("n")) * percent


class _Sets:
    """The sets of the classes in pairs, made from the texts when they are first asked for, and kept as written tables."""

    def __init__(self, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int):
        self.first = classes.select("digest", "first.*")
        self.docs, self.size, self.percent = keyed(docs, doc_id, text).select("_id", "_sum", "_text"), size, percent
        self.known: DataFrame | None = None

    def _add(self, pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        if self.known is not None:
            nodes = nodes.join(self.known.select("digest"), "digest", "left_anti")
        wanted = written(self.first.join(nodes, "digest", "left_semi"))
        few = among(among(self.docs, wanted, "_id", "_sum"), wanted, "_sum", "_id")  # two bitmaps, so hardly a text is dealt in vain
        texts = on_key(few, wanted, "inner", ("_id", "_sum"))

        @sparing
        def sets(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(shingle_hashes(blank_words(t.as_py(), lower=True), self_size)).view(np.int64) for t in part.column(1)]
            parity = [parities(x.view(np.uint64), max(64 * LANES, 1 << (len(x) - 1).bit_length())) for x in found]
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (found, parity)), pa.array([len(x) for x in found], pa.int64())], ["digest", "found", "parity", "n"])

        def run(batch: pa.RecordBatch):
            for k in range(0, batch.num_rows, PART):
                yield sets(batch.slice(k, PART))

        self_size = self.size
        new = written(arrow_map(texts.select("digest", "_text"), run, "digest binary, found array<bigint>, parity array<bigint>, n bigint"))
        self.known = new if self.known is None else self.known.unionByName(new)
        return self.known

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) of set digests whose sets reach the threshold, as a written table."""
        pairs = written(pairs.distinct())
        sets = self._add(pairs)

        def beside(rows: DataFrame, col: str) -> DataFrame:
            nodes = written(rows.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
            known = among(sets, nodes, "digest")
            one, two = (known.select(F.col("digest").alias(k), F.col("n").alias(f"n_{k}"), F.col(col).alias(f"x_{k}")) for k in "ab")
            return rows.join(one, "a").join(two, "b")

        # parity sketches as long as the sets first: the bits that differ are never more than the shingles that do
        most = 100 - self.percent, 100 + self.percent

        @sparing
        def near(part: pa.RecordBatch) -> pa.RecordBatch:
            sizes = part.column(2).to_numpy() + part.column(3).to_numpy()
            apart = [_apart(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(part.column(4), part.column(5), strict=True)]
            kept = pa.array(np.array(apart, np.int64) * most[1] <= sizes * most[0])
            return part.select(["a", "b"]).filter(kept)

        def run(batch: pa.RecordBatch):
            for k in range(0, batch.num_rows, PART):
                yield near(batch.slice(k, PART))

        released(self.docs.sparkSession)
        close = written(arrow_map(beside(pairs, "parity").select("a", "b", "n_a", "n_b", "x_a", "x_b"), run, "a binary, b binary"))
        released(self.docs.sparkSession)
        common = F.size(F.array_intersect("x_a", "x_b")).cast("bigint")
        linked = written(beside(close, "found").where(common * (100 + self.percent) >= (F.col("n_a") + F.col("n_b")) * self.percent).select("a", "b"))
        released(self.docs.sparkSession)
        return linked


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """digest, root of every class."""
    roots = components(links)
    return classes.select("digest").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"))


def one_of_equals(held: DataFrame, at: str = "token") -> DataFrame:
    """token: of all tokens with the same holders, the one with the smallest `at`; the others lead to the same pairs. `held`: token, digest.

    Near copies share most of their prefix, so without this each pair of them would meet at every shingle of it.
    """
    holders = held.groupBy("token").agg(F.count("*").alias("k"), F.min(at).alias("first"), *[F.bit_xor(F.xxhash64("digest", F.lit(s))).alias(f"h{s}") for s in range(2)])
    return written(holders.groupBy("k", "h0", "h1").agg(F.min_by("token", "first").alias("token")).select("token"))


def _band(n: str, percent: int) -> Column:
    """Sizes that leave the threshold possible lie in one band or in neighbouring ones; the factor covers rounding."""
    return F.floor(F.log(n) / F.log(F.lit(100 / percent)) * (1 - 1e-9))


def meetings(leaders: DataFrame, percent: int) -> DataFrame:
    """token, digest, n, at, band and same, the holders of the token in the band: the places at which a leader can meet another set.

    `leaders`: digest, n, prefix, members. Of a pair that reaches the threshold, the first common shingle stands early in the smaller
    set, as all common ones follow there: shingles that are early in no set are left out. So are those without another holder
    of a like size, but for the first of a leader with members of its own. Of shingles with the same holders, the first is taken.
    """
    postings = leaders.select("digest", "n", "members", F.posexplode("prefix").alias("at", "token"))
    early = F.max(F.col("at") * (100 + percent) <= F.col("n") * (100 - percent))
    shared = written(postings.groupBy("token").agg(F.sum("members").alias("all"), early.alias("early")).where("all > 1 and early").select("token"))
    held = written(among(postings, shared, "token").join(shared, "token").select("token", "digest", "n", "at", "members", _band("n", percent).alias("band")))
    own = held.join(one_of_equals(held, "at"), "token", "left_semi")
    bands = own.groupBy("token", "band").agg(F.count("*").alias("k")).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("bands"))
    same, *beside = (F.coalesce(F.col("bands")[F.col("band") + step], F.lit(0)) for step in (0, -1, 1))
    placed = own.join(bands, "token").withColumn("same", same).where((F.col("same") + sum(beside) > 1) | ((F.col("members") > 1) & (F.col("at") == 0)))
    return written(placed.select("token", "digest", "n", "at", "band", "same"))


def class_links(classes: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """a, b: verified links between classes that connect all that the threshold links."""
    sets = _Sets(classes, docs, doc_id, text, size, percent)
    several = written(classes.groupBy("group").agg(F.min("digest").alias("lead"), F.count("*").cast("int").alias("members")).where("members > 1"))
    crowd = written(classes.select("group", "digest", "n", *SKETCH).join(several, "group"))
    heads = crowd.where("digest = lead").select("group", F.struct("n", "digest", *SKETCH).alias("y"))
    others = crowd.where("digest <> lead").select("group", "digest", "n", *SKETCH)
    inside = others.select("group", F.struct("n", "digest", *SKETCH).alias("x")).join(heads, "group")
    inside = inside.where(_resembling("x", "y", percent)).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))

    leaders = classes.join(several, "group", "left").where("lead is null or digest = lead").withColumn("members", F.coalesce("members", F.lit(1)))
    places = meetings(leaders.select("digest", "n", "prefix", "members"), percent)
    met = written(places.join(leaders.select("digest", "group", *SKETCH), "digest"))
    released(docs.sparkSession)
    links, alike = None, met.where("same > 1")
    active = alike.withColumn("root", F.col("digest"))
    for turn in range(ROUNDS):
        order = F.struct(F.xxhash64("digest", "token" if turn else F.lit(0), F.lit(turn)).alias("h"), "digest")  # the same leader in all buckets first, then others in each
        head = F.min(F.struct(order.alias("o"), F.struct("n", "digest", "at", "root", *SKETCH).alias("y")))["y"]
        first = active.groupBy("token", "band").agg(head.alias("y"), F.count("*").alias("groups")).where("groups > 1").select("token", "band", "y")
        star = active.select("token", "band", F.struct("n", "digest", "at", "root", *SKETCH).alias("x")).join(first, ["token", "band"]).where("x.root <> y.root")
        star = star.where(_reaching("x", "y", percent) & _resembling("x", "y", percent)).select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b"))
        found = sets.verified(star.unionByName(inside) if turn == 0 else star)
        links = found if links is None else links.unionByName(found)
        roots = written(_rooted(classes, links))
        if turn + 1 < ROUNDS:  # buckets that hold linked groups and others: there a further leader may connect many
            rooted = alike.join(roots, "digest")
            sizes = rooted.groupBy("token", "band", "root").agg(F.count("*").alias("k")).groupBy("token", "band").agg(F.count("*").alias("roots"), F.max("k").alias("most"))
            active = written(rooted.join(sizes.where("roots > 1 and most > 1").select("token", "band"), ["token", "band"], "left_semi"))
    # what is left: members outside a bucket's largest component against those of the other components
    tail = met.select("group", "token", "at").join(others, "group")
    cols = ["token", "digest", "n", "at", *SKETCH]
    full = met.select(cols).unionByName(tail.select(cols)).join(roots, "digest")
    sizes = full.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root"))["root"].alias("major"), F.count("*").alias("roots")).where("roots > 1")
    full = written(full.join(sizes.select("token", "major"), "token"))
    minor = full.where("root <> major").alias("m")
    cond = (F.col("m.token") == F.col("q.token")) & (F.col("m.root") != F.col("q.root")) & ((F.col("q.root") == F.col("q.major")) | (F.col("m.digest") < F.col("q.digest"))) & _reaching("m", "q", percent) & _resembling("m", "q", percent)
    rest = minor.join(full.alias("q"), cond).select(F.col("m.digest").alias("a"), F.col("q.digest").alias("b"))
    return links.unionByName(sets.verified(rest))


def classed(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the signatures of all rows, the classes of equal sets with their first row, and digest, root of every class."""
    rows = written(signatures(docs, doc_id, text, size, percent))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_sum"))
    ids = rows.where("n > 0").groupBy("digest").agg(least.alias("first"))
    own = rows.where("n > 0").select("digest", "n", "group", "prefix", *SKETCH).dropDuplicates(["digest"])
    classes = written(own.join(ids.select("digest", F.struct("first._id", "first._sum").alias("first")), "digest"))
    released(docs.sparkSession)
    links = written(class_links(classes, docs, doc_id, text, size, percent))
    released(docs.sparkSession)
    return rows, classes, written(_rooted(classes, links))


def labelled(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """_id, _sum, root of every row; the root of rows without a word is an empty one."""
    rows, _, roots = classed(docs, doc_id, text, size, percent)
    done = rows.where("n > 0").select("_id", "_sum", "digest").join(roots, "digest").select("_id", "_sum", "root")
    return done.unionByName(rows.where("n = 0").select("_id", "_sum", F.lit(b"").alias("root")))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable over links)."""
    rows, classes, roots = classed(docs, doc_id, text, size, percent)
    named = classes.select("digest", F.col("first._id").alias("class_id")).join(roots, "digest")
    top = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    label = written(named.join(top, "root").select("digest", "class_id", "component_id"))
    done = rows.where("n > 0").select("_id", "n", "digest").join(label, "digest").select("_id", "n", "class_id", "component_id")
    alone = rows.where("n = 0").select("_id", "n", F.col("_id").alias("class_id"), F.col("_id").alias("component_id"))
    return done.unionByName(alone).select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), "class_id", "component_id")
