"""Decontamination against a comparison of every document with every item along all diagonals."""

import itertools
import random

import numpy as np

from contestframe.llm import decontam, queries
from contestframe.llm.texts import terms


def words(rnd, n):
    return [f"{rnd.choice('bcdfgklm')}{rnd.choice('aeiou')}{rnd.randrange(40)}" for _ in range(n)]


def found(spark, docs, items, docs_of):
    item_df = docs_of(items, "item_id bigint, text string")
    return {(r._id, r["item"]): r for r in decontam.find_overlaps(docs_of(docs), item_df).collect()}


def test_substituted_and_cut_passages(spark, docs_of):
    rnd = random.Random(2)
    items = [(k, " ".join(words(rnd, n))) for k, n in enumerate([15, 30, 50, 20, 40])] + [(5, "tiny item"), (6, None), (7, ""), (1, " ".join(words(rnd, 25)))]
    docs = [(100 + k, " ".join(words(rnd, 200))) for k in range(40)]

    def planted(doc, item, change=0.0, part=slice(None)):
        w = items[item][1].split()[part]
        w = [x if rnd.random() >= change else "other" for x in w]
        own = words(rnd, 120)
        return doc, " ".join([*own[:60], *w, *own[60:]])

    docs += [planted(1, 0), planted(2, 1), planted(3, 2, 0.1), planted(4, 3), planted(5, 4, part=slice(0, 30)), planted(6, 2, part=slice(0, 6)), planted(6, 2)]
    docs += [(7, "AND A Tiny, item!"), (8, None), (9, ""), (None, items[0][1]), (10, items[1][1].replace(" ", " , ").upper()), (2, docs[0][1])]
    got = found(spark, docs, items, docs_of)
    assert set(got) == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 2), (7, 5), (None, 0), (10, 1)}
    assert got[(1, 0)].start == 60 and got[(5, 4)].n_words == 30 and got[(3, 2)].n_equal >= 0.8 * got[(3, 2)].n_words
    left = decontam.clean_rows(docs_of(docs), docs_of(items, "item_id bigint, text string"))
    assert left.columns == docs_of(docs).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([str(d) for d, _ in docs[:40]] + ["6", "8", "9", "2"])


def test_every_three_substitutions_leave_a_seed():
    rnd = random.Random(4)
    for _ in range(300):
        item = np.array([rnd.getrandbits(60) for _ in range(30)], np.uint64)
        doc = item.copy()
        doc[rnd.sample(range(30), 4)] = 1
        assert any((decontam.seeds(item, m, n) == decontam.seeds(doc, m, n)).any() for n, m in enumerate(decontam.MASKS))


def test_every_pattern_inside_the_limits_leaves_a_seed():
    for size in range(1, 17):
        item = np.arange(1, size + 1).astype(np.uint64)
        masks = decontam.MASKS if size >= decontam.SHORT else decontam.short_masks(size)
        for k in range(size // 5 + 1):
            for places in itertools.combinations(range(1, size - 1) if size < decontam.SHORT else range(size), k):
                doc = item.copy()
                doc[list(places)] = 99
                assert any((decontam.seeds(item, m, n) == decontam.seeds(doc, m, n)).any() for n, m in enumerate(masks)), (size, places)


def test_short_overlaps(spark, docs_of):
    rnd = random.Random(12)
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(5, 17)] + [(30, " ".join(f"long{k}" for k in range(15)))]
    docs = []
    for n, text in items:
        for places in itertools.combinations(range(1, n - 1), n // 5) if n < 30 else ():
            w = ["other" if k in places else x for k, x in enumerate(text.split())]
            docs.append((len(docs), " ".join([*words(rnd, 5), *w, *words(rnd, 5)])))
    docs.append((-1, " ".join([*words(rnd, 20), *items[-1][1].split()[3:11], *words(rnd, 20)])))
    got = found(spark, docs, items, docs_of)
    assert {d for d, _ in got} == {d for d, _ in docs} and got[(-1, 30)].n_words == 8


def test_overlap_is_the_best_stretch():
    a = np.array([9, 1, 2, 3, 0, 5, 6, 7, 8, 8, 8], np.int64)
    b = np.array([1, 2, 3, 4, 5, 6, 7], np.int64)
    assert decontam.overlap(a, b, 1, 0.8) == (1, 7, 6)
    assert decontam.overlap(b, a, -1, 0.8) == (0, 7, 6)
    assert decontam.overlap(b, a + 100, -1, 0.8)[1:] == (0, 0)
    rnd = random.Random(6)
    for _ in range(300):
        x = np.array([rnd.randrange(2) for _ in range(14)])
        found = max((n for s in range(14) for n in range(1, 15 - s) if x[s] and x[s + n - 1] and x[s : s + n].sum() >= 0.8 * n - 1e-9), default=0)
        assert decontam.overlap(x, np.ones(14, int), 0, 0.8)[1] == found
    every_fifth = np.where(np.arange(50) % 5 == 4, 0, np.arange(50) + 1)
    assert decontam.overlap(every_fifth, np.arange(50) + 1, 0, 0.8)[1] >= 44


def test_empty_tables(spark, docs_of):
    item = "item_id bigint, text string"
    assert found(spark, [], [(1, "a b c d e f g h i")], docs_of) == {} and found(spark, [(1, "a b c d e f g h i")], [], docs_of) == {}
    assert decontam.clean_rows(docs_of([(1, "a")]), docs_of([], item)).count() == 1


def test_query_over_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    numbers, plain = {}, set()
    lists = [(r.item_id, np.array([numbers.setdefault(w, len(numbers)) for w in terms(r.text)])) for r in items]
    for d in docs:
        body = np.array([numbers.setdefault(w, len(numbers)) for w in terms(d.text)], np.int64)
        for k, item in lists:
            for diagonal in range(-len(item) + 1, len(body)):
                low, high = max(0, -diagonal), min(len(item), len(body) - diagonal)
                if high - low >= 8 and (body[low + diagonal : high + diagonal] == item[low:high]).sum() >= 8:
                    _, n, equal = decontam.overlap(body, item, diagonal, 0.8)
                    if n >= max(min(8, len(item)), -(-len(item) // 2)) and equal >= 0.8 * n:
                        plain.add((d.doc_id, k))
    assert {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).collect()} == plain and plain
