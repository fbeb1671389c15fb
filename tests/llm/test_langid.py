"""Language identification: Viterbi against all paths, spans, held-out accuracy."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from contestframe.llm import langid, queries

EN = "the cat sat on the mat and the dog was there with them in the house of the king"
DE = "der hund liegt auf dem sofa und die katze schläft nicht in dem großen haus der königin"
RU = "кошка сидит на ковре и собака спит в большом доме короля"


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(5)
    for n in range(300):
        scores = rnd.normal(0, rnd.choice([1, 6, 20]), (rnd.integers(1, 7), 3))
        penalty = float(rnd.choice([0.5, 5, 12]))

        def total(path):
            return sum(scores[t, k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))

        best = max(map(total, itertools.product(range(3), repeat=len(scores))))
        assert abs(total(langid.viterbi(scores, penalty)) - best) < 1e-9, n


def test_trigrams_stay_within_words():
    words = ["ab", "c", "déf"]
    buckets, starts, _ = langid._grams(words)
    parts = np.split(buckets, starts[1:])
    assert [len(p) for p in parts] == [2, 1, 3]
    for w, p in zip(words, parts, strict=True):
        assert (langid._grams([w])[0] == p).all()


def learned(docs_of, per_lang=langid.PER_LANG):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choices(t.split(), k=20)), name) for k, (name, t) in enumerate([("de", DE), ("en", EN), ("ru", RU)] * 40)]
    return langid.fit(docs_of([*rows, (900, None, "en"), (901, "zz", None), (902, "", "de")]), per_lang=per_lang)


def test_mixed_text_and_odd_rows(spark, docs_of):
    model = learned(docs_of)
    assert model.langs == ["de", "en", "ru"]
    mixed = f"{EN} {DE} {EN}"
    rows = [(1, EN), (1, EN), (2, DE.upper()), (3, RU), (4, mixed), (5, None), (6, ""), (7, "123 !?"), (8, "中文 字"), (9, (EN + " ") * 3000), (None, DE)]
    got = langid.predict(docs_of(rows), model).collect()
    assert sorted((str(r.doc_id), r.language.lang_pred) for r in got) == sorted(
        [("1", "en"), ("1", "en"), ("2", "de"), ("3", "ru"), ("4", "en"), ("5", "und"), ("6", "und"), ("7", "und"), ("8", "de"), ("9", "en"), ("None", "de")])
    spans = next(r.language.spans for r in got if r.doc_id == 4)
    assert [s.lang for s in spans] == ["en", "de", "en"] and spans[0].start == 0 and spans[-1].end == len(mixed)
    assert abs(spans[1].start - len(EN) - 1) <= 8 and spans[1].end == spans[2].start
    assert all(0 <= r.language.score <= 1 for r in got)


def test_bounded_sample_and_nothing_to_learn(spark, docs_of):
    small = learned(docs_of, per_lang=2)
    assert small.langs == ["de", "en", "ru"]
    none = langid.fit(docs_of([(1, "text", None)]))
    assert none.langs == [] and langid.predict(docs_of([(1, "text")]), none).first().language.lang_pred == "und"
    assert langid.predict(docs_of([]), small).collect() == []


def test_held_out_accuracy(spark, sf):
    got = queries.op6_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("out"))
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count() and all(r.held_out == r.out for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 20 and sum(held) >= 0.97 * len(held)
