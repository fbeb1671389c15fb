"""SimHash: fingerprints, links and components against brute force."""

import itertools
import random

import xxhash

from contestframe.llm import queries, simhash
from contestframe.llm.components import components


def plain_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest member reachable over at most three differing bits, for a list of (id, print)."""
    label = {k: k for k, _ in prints}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for (a, p), (b, q) in itertools.combinations(prints, 2):
        if bin(p ^ q).count("1") <= 3:
            x, y = top(a), top(b)
            label[max(x, y)] = min(x, y)
    return {k: top(k) for k, _ in prints}


def test_links_keep_every_connection(spark):
    rnd = random.Random(3)
    prints = set()
    for _ in range(25):
        base = rnd.getrandbits(64)
        prints.add(base)
        for _ in range(14):
            x = base
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
        for block in range(4):  # three bits in one block, and four
            for n in (3, 4):
                x = base
                for b in rnd.sample(range(16 * block, 16 * block + 16), n):
                    x ^= 1 << b
                prints.add(x)
    prints = sorted(simhash._signed(p) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = simhash.links(df)
    got = {r.node: r.root for r in components(edges).collect()}
    want = plain_components([(p, p & (1 << 64) - 1) for p in prints])
    assert {p: got.get(p, p) for p in prints} == want
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in edges.collect())


def test_dense_ball_has_few_links(spark):
    """All fingerprints two bits from a centre: links stay near the number of meetings, not of pairs."""
    prints = [simhash._signed(1 << a | 1 << b) for a in range(64) for b in range(a)]
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    edges = simhash.links(df)
    assert len({r.root for r in components(edges).collect()}) == 1
    assert edges.count() < len(prints) * 100


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(301)}, 900: 900, 901: 900}


def test_documents(spark, docs_of):
    base = " ".join(f"w{k}" for k in range(400))
    near = base.replace("w7 ", "x7 ")
    rows = [(9, base), (4, near), (12, base.upper()), (5, None), (6, ""), (7, " \n"), (None, base), (8, "other words " * 40), (8, "other words " * 40), (3, "a"), (2, "a b")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()), key=str)
    ids = [(n, plain_print(t)) for n, (_, t) in enumerate(rows)]
    group = plain_components(ids)
    least = {}
    for n, (k, _) in enumerate(rows):
        if k is not None:
            least[group[n]] = min(k, least.get(group[n], k))
    assert got == sorted(((k, f"{plain_print(t):016x}", least[group[n]]) for n, (k, t) in enumerate(rows)), key=str)
    kept = simhash.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_empty_table(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []
    assert simhash.keep_one(docs_of([])).collect() == []


def test_query_over_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(k, plain_print(t)) for k, t in rows]
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, sf).collect()}
    assert got == {k: (f"{p:016x}", want[k]) for k, p in prints}


def test_keep_distinct(spark, docs_of):
    """Copies with some words changed go, chains of them too; what shares only a part of its text stays."""
    rnd = random.Random(12)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(3000)]
    rows, originals = [], []
    for k in range(20):
        base = rnd.choices(vocabulary, k=rnd.choice((80, 200, 400)))
        originals.append(100 * k)
        rows.append((100 * k, " ".join(base)))
        for j in range(1, 6):
            words = list(base)
            for _ in range(len(words) // 100):
                words[rnd.randrange(len(words))] = f"n{k}x{j}"
            rows.append((100 * k + j, " ".join(words)))
        rows.append((100 * k + 50, " ".join(base[: len(base) // 2] + rnd.choices(vocabulary, k=len(base) // 2))))
        originals.append(100 * k + 50)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (9000, "one row twice"), (9000, "one row twice"), (9000, "other text of the id")]
    docs = docs_of(rows)
    kept = simhash.keep_distinct(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(map(str, [*originals, 5000, 9000, 9000]))
    assert simhash.keep_distinct(docs_of([])).collect() == []


def test_links_deal_fingerprints_once(spark):
    """The fingerprints of a value are dealt out once; its links are found there, and only they are dealt again."""
    df = spark.createDataFrame([(1,), (3,)], "fp bigint")
    plan = simhash.links(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_many_fingerprints_equal_outside_a_block(spark):
    """More than are compared in pairs: even and odd words of a code with distance 3 or more, linked over three bits only."""
    rnd = random.Random(5)
    parts = []
    for x in rnd.sample(range(1 << 16), 1 << 16):
        if len(parts) < 120 and all((x ^ p).bit_count() >= 3 for p in parts):
            parts.append(x)
    prints = [simhash._signed(0xABCD << 48 | x << 16) for x in parts]
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert {p: got.get(p, p) for p in prints} == plain_components([(p, p & (1 << 64) - 1) for p in sorted(prints)])


def test_rows_that_stay_are_not_dealt_out(spark):
    """Of many rows few are dealt by their key: those that the bitmap takes for dropped ones, and repeated ones."""
    rows = [(k, k, (k, f"text {k}")) for k in [*range(4000), 7, 9, 9]] + [(None, 5, (None, "null id")), (None, 6, (None, "dropped"))]
    packed = spark.createDataFrame(rows, "_id bigint, _sum bigint, row struct<doc_id: bigint, text: string>")
    gone, again = (spark.createDataFrame(x, "_id bigint, _sum bigint") for x in ([(k, k) for k in [*range(0, 4000, 4), 9]] + [(None, 6)], [(7, 7), (9, 9)]))
    got = simhash._without(packed, gone, again, ["doc_id", "text"])
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted([*(str(k) for k in range(4000) if k % 4 and k != 9), "None"])
    whole = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in whole
