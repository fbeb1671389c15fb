"""The Jaccard join against all pairs."""

import itertools
import random

import pytest

from contestframe.llm import jaccard


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2)))


def plain(rows, percent=90):
    """(doc_id, n_shingles, class_id, component_id) of every row; rows: (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            label[max(x, y)] = min(x, y)

    def least(members):
        return min((rows[k][0] for k in members if rows[k][0] is not None), default=None)

    out = []
    for k, (doc, _) in enumerate(rows):
        same = [j for j in range(len(rows)) if sets[j] == sets[k]] if sets[k] else [k]
        linked = [j for j in range(len(rows)) if top(j) == top(k)]
        out.append((doc, len(sets[k]), least(same), least(linked)))
    return sorted(out, key=str)


def collected(df):
    assert df.columns[1:] == ["n_shingles", "class_id", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        words[at : at + 1] = rnd.choice(([f"n{rnd.random():.9f}"], [], [words[at], "again"]))
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_around_the_threshold(spark, docs_of, seed):
    """Copies with so many edits that links and chains of links stand on both sides of the threshold."""
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    texts = []
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice((5, 20, 40, 80, 200)))
        texts += [" ".join(base)] * 2 + [edited(rnd, base, rnd.randint(0, max(1, len(base) // 20))) for _ in range(12)]
    chain = [f"c{k}" for k in range(120)]
    for step in range(25):
        texts.append(" ".join(chain))
        chain[4 * step] = f"d{step}"
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = collected(jaccard.near_copies(docs_of(rows)))
    want = plain(rows)
    assert got == want
    assert len({w[3] for w in want}) < len({w[2] for w in want}) < len(rows)


def test_exactly_at_the_threshold(spark, docs_of):
    """18 of 20 shingles in common are linked, 17 of 19 are not."""
    base = [f"w{k}" for k in range(21)]  # 19 shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base[:20], "x"])), (3, " ".join(base[:20]))]
    rows += [(11, " ".join(f"u{k}" for k in range(20))), (12, " ".join([*(f"u{k}" for k in range(19)), "y"]))]
    assert collected(jaccard.near_copies(docs_of(rows))) == plain(rows)
    assert [r[3] for r in plain(rows)] == [1, 11, 12, 1, 1]


def test_one_round_leaves_the_rest_to_the_last_step(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    rows = [(k, edited(rnd, base, rnd.randint(0, 4))) for k in range(60)]
    assert collected(jaccard.near_copies(docs_of(rows))) == plain(rows)


def test_defined_results(spark, docs_of):
    long = " ".join(f"v{k}" for k in range(30000))
    rows = [(5, None), (6, ""), (7, " \n"), (9, "a"), (3, "A"), (8, "a b"), (2, "A  B"), (1, "b a"), (None, "x y z q"), (4, "X Y Z Q"), (20, long), (21, long.replace("v77 ", "u ")), (30, "r s t u"), (30, "r s t u"), (30, "other text of this id"), (None, "null id only here")]
    assert collected(jaccard.near_copies(docs_of(rows))) == plain(rows)


def test_empty_table(spark, docs_of):
    assert jaccard.near_copies(docs_of([])).collect() == []


def test_no_pairs_of_a_large_group(spark, docs_of):
    """Near copies of one text are linked by about as many pairs as there are copies."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, edited(rnd, base, 2)) for k in range(200)]
    docs = docs_of(rows)
    signed = jaccard.signatures(docs, "doc_id", "text", 3, 90)
    from pyspark.sql import functions as F

    classes = signed.groupBy("digest", "n", "group", "prefix", *jaccard.SKETCH).agg(F.min(F.struct("_id", "_sum")).alias("first"))
    assert jaccard.class_links(classes, docs, "doc_id", "text", 3, 90).count() < 200 * 12
    assert len({r[3] for r in collected(jaccard.near_copies(docs))}) == len({r[3] for r in plain(rows)})


def test_tokens_with_the_same_holders_count_once(spark):
    rows = [(7, b"a"), (7, b"b"), (5, b"a"), (5, b"b"), (9, b"a"), (9, b"c"), (2, b"a")]
    kept = jaccard.one_of_equals(spark.createDataFrame(rows, "token bigint, digest binary"))
    assert sorted(r.token for r in kept.collect()) == [2, 5, 9]


def test_sketches_of_any_length_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 1100, np.uint64))
    for cut in (0, 40, 200):
        x, y = base, base[cut:]
        for sizes in ((512, 2048), (2048, 1024), (4096, 4096)):
            assert jaccard._apart(*(jaccard.parities(z, n) for z, n in zip((x, y), sizes, strict=True))) <= cut
    assert jaccard._apart(jaccard.parities(base, 2048), jaccard.parities(base[200:], 2048)) > 150


def test_meetings_are_where_a_first_common_shingle_can_stand(spark):
    """Shingles that are late in all sets, or whose holders differ in size, make no bucket; of equal holders the first is taken."""
    sets = [(b"a", 100, [11, 12, 13, *range(20, 28)], 1), (b"b", 96, [11, 12, 13, *range(30, 37)], 1)]  # 11 to 13 have the same holders
    sets += [(b"c", 100, [*range(40, 50), 99], 1), (b"d", 100, [*range(50, 60), 99], 1)]  # 99 is late in both
    sets += [(b"e", 100, [70, *range(71, 81)], 1), (b"f", 40, [70, 82, 83, 84, 85], 1)]  # far from each other in size
    sets += [(b"g", 100, list(range(90, 99)), 3)]  # alone, but with members of its own
    got = jaccard.meetings(spark.createDataFrame(sets, "digest binary, n bigint, prefix array<bigint>, members int"), 90).collect()
    assert sorted((r.token, bytes(r.digest), r.at, r.same) for r in got) == [(11, b"a", 0, 2), (11, b"b", 0, 2), (90, b"g", 0, 1)]


def test_large_group_around_the_threshold(spark, docs_of):
    """Members that differ by about as much as the threshold lets them."""
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows = [(k, edited(rnd, base, rnd.randint(4, 7))) for k in range(150)]
    assert collected(jaccard.near_copies(docs_of(rows))) == plain(rows)
