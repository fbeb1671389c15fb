"""Source divergence against plain sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from contestframe.llm import divergence


def plain(docs, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) by the definition; docs: (text, lang, source)."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)

        def share(n, total):
            return 1 + 1_000_000_000 * (n + 2) // (total + 2 * len(kept))

        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] + ["Éa", "zß", "WAA", "same"]
    rows = [(" ".join(rnd.choices(words[: rnd.choice((8, 30, 64))], k=rnd.randint(0, 40))) + " 12-x9y\tq", rnd.choice(("en", "fr", None)), rnd.choice(("s1", "s2", "s3", "ü", None))) for _ in range(n)]
    rows += [("same " * 20000 + "waa", "en", "s1")] * 3 + [(None, "en", "s9"), ("", None, "s9"), ("rare word", "de", "s1"), ("other", "de", "s2"), ("alone", "it", "s1")]
    return rows


def frame(docs_of, rows):
    return docs_of([(k % 7, t, lang, source) for k, (t, lang, source) in enumerate(rows)]).withColumnRenamed("words", "term")


def collected(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [t for _, t in df.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    return sorted(tuple(r) for r in df.collect())


def test_against_plain_sums(spark, docs_of):
    rows = corpus(1)
    assert collected(divergence.audit(frame(docs_of, rows))) == plain(rows)


def test_small_batches_and_flushes(spark, docs_of, monkeypatch):
    """Node counts that batch borders split, and counts that a task hands on early, add up to the same."""
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "COMBINATIONS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = corpus(2, 90)
        assert collected(divergence.audit(frame(docs_of, rows), min_docs=3, top_terms=4)) == plain(rows, 3, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tree_of_sorted_rows():
    """Every node meets each ancestor once, with the multiplicity of all rows under it."""
    rnd = random.Random(5)
    rows = Counter()
    for _ in range(400):
        own = sorted(rnd.sample(range(5), rnd.randint(1, 5)))
        rows[tuple((s, rnd.choice((10, 20))) for s in own)] += rnd.randint(1, 3)
    ordered = sorted(rows)
    zero = [3, 4, 5, 6, 7]
    starts = np.cumsum([0] + [len(r) for r in ordered])
    flat = [x for r in ordered for x in r]
    got = divergence.node_corrections(np.zeros(len(ordered), np.int64), starts, np.array([s for s, _ in flat]), np.array([p for _, p in flat]), np.array([zero[s] for s, _ in flat]), np.array([rows[r] for r in ordered]))

    def gap(p, q):
        return (p - q) ** 2 // (p + q)

    want = Counter()
    for r, m in rows.items():
        for k, (b, q) in enumerate(r):
            for a, p in r[:k]:
                want[a, b] += m * (gap(p, q) - gap(p, zero[b]) - gap(zero[a], q) + gap(zero[a], zero[b]))
    assert {(a, b): v for _, a, b, v in got} == dict(want)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 9_000_000_000_000, 70_000_000_000_001
    df = spark.range(1).select(divergence.share(F.lit(n), F.lit(total)).alias("p"))
    assert df.first().p == 1 + 1_000_000_000 * (n + 2) // total


def test_empty_and_termless(spark, docs_of):
    assert divergence.audit(docs_of([])).collect() == []
    rows = [("12", "en", "a"), (None, "en", "b"), ("x", "fr", "a")]
    assert collected(divergence.audit(frame(docs_of, rows))) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
