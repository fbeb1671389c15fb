"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from contestframe.llm import collocations


def plain(docs, support=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score); docs: (text, lang)."""
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts.update((lang, tuple(words[k : k + size])) for k in range(len(words) - size + 1))
    found = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= support}
    rows = []
    for (lang, words), a in found.items():
        longer = [n for (other, w), n in found.items() if other == lang and len(w) > len(words) and any(w[k : k + len(words)] == words for k in range(len(w)))]
        if any(100 * n >= 50 * a for n in longer):
            continue
        cuts = [(10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[5], -r[2], r[1].encode()))[:top]
        out += [(lang, n, phrase, a, left, right, totals[lang], score) for n, (_, phrase, a, left, right, score) in enumerate(best, 1)]
    return sorted(out)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "ä", "Ä", "x\x1cy", "e f", "a-b", "in", "at"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", ";", ":", "!", "?", "\n", "\r\n", "\x0b", "\x0c"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rnd.randint(0, 40)):
            text += rnd.choice(("new york city", "ha ha ha ha", "of the", rnd.choice(words), rnd.choice(words))) + rnd.choice(ends)
        rows.append((text, rnd.choice(("en", "fr", "", None))))
    return rows + [(None, "en"), ("", "de"), ("...", "de"), ("long word " * 30000, "en"), ("twice over", "it"), ("twice over", "it")]


def collected(df):
    assert dict(df.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(docs_of, rows):
    return docs_of([(k % 5, t, lang) for k, (t, lang) in enumerate(rows)])


def test_against_plain_counts(spark, docs_of):
    rows = corpus(1)
    assert collected(collocations.collocations(frame(docs_of, rows))) == plain(rows)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_any_number_of_shards(spark, docs_of, shards, monkeypatch):
    """Supports that shards lower, small slices and few hash buckets give the same phrases."""
    monkeypatch.setattr(collocations, "SLICE_WORDS", 50)
    monkeypatch.setattr(collocations, "BUCKETS", 2)
    rows = corpus(shards, 60)
    assert collected(collocations.collocations(frame(docs_of, rows), support=5, shards=shards, top=7)) == plain(rows, 5, 7)


def test_crowded_bitmap_changes_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    rows = corpus(4, 60)
    assert collected(collocations.collocations(frame(docs_of, rows))) == plain(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 9_876_543_210_987, 9_876_543_210_999, 98_765_432_109_876
    df = spark.range(1).select(*[F.lit(x).alias(n) for x, n in ((a, "a"), (left, "l"), (right, "r"))]).select(collocations.cut_score().alias("s"))
    assert df.first().s == 10**6 * a * a // (left * right)


def test_half_inside_a_longer_one(spark, docs_of):
    """A phrase goes at exactly half, and a dropped longer one still counts."""
    rows = [("p q r", "en")] * 10 + [("p q", "en")] * 10 + [("u v w", "en")] * 10 + [("u v", "en")] * 11
    got = {r[2] for r in collected(collocations.collocations(frame(docs_of, rows)))}
    assert got == {"p q r", "u v w", "u v"} and got == {r[2] for r in plain(rows)}


def test_empty(spark, docs_of):
    assert collocations.collocations(docs_of([])).collect() == []
    assert collocations.collocations(docs_of([(1, "a b", "en")])).collect() == []
