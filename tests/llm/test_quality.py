"""Quality rules on small cases; the registered query is compared with its SQL in test_oracles.py."""

from contestframe.llm import quality


def test_repeated_words():
    assert quality.repeated_words(b"a b c".split()) == 0
    assert quality.repeated_words(b"a b c a b c".split()) == 6
    assert quality.repeated_words(b"x x x x y".split()) == 4
    assert quality.repeated_words(b"a b c d a b c e f g".split()) == 6


def test_boilerplate_rejects_depleted_documents_only(spark, docs_of):
    limits = quality.Limits(min_words=5, max_docs=3, max_share=0.05)
    line = "Subscribe to our letter number {} now and read more of it every day"
    rows = [(k, f"{line.format(k)}\nshort own line {'abcdefghijkl'[k % 12]}{'mnopqr'[k // 12]}", "en", "h", 0) for k in range(30)]
    rows += [(100 + k, f"{line.format(k)}\n" + " ".join(f"{c}{'xyz'[k % 3]}{k}word" for c in "abcdefghijklmnopqrstuvwxyz"), "en", "h", 0) for k in range(9)]
    rows += [(200 + k, "One copied text of a few lines\nwhich stands in many rows\nand is no boilerplate", "en", "h", 0) for k in range(20)]
    rows += [(300, None, "en", "h", 0), (301, "", None, None, 0), (302, "a b c d e f", None, None, 0), (302, "a b c d e f", None, None, 0), (None, "a b c d e f g", "en", None, 0)]
    got = [(r._id, r.kept) for r in quality.judge(docs_of(rows), limits=limits).collect()]
    assert len(got) == len(rows)
    kept = {k for k, keep in got if keep}
    assert kept == {*range(100, 109), *range(200, 220), 302, None}
    rows_kept = quality.kept_rows(docs_of(rows), limits=limits)
    texts = [(r.doc_id, r.text) for r in rows_kept.collect()]
    assert rows_kept.columns == docs_of(rows).columns and len(texts) == 9 + 20 + 2 + 1
    assert all(t.startswith("a") and "\n" not in t for k, t in texts if k is not None and 100 <= k < 200)
    assert dict(texts)[200] == dict((r[0], r[1]) for r in rows)[200]


def test_counts(spark, docs_of):
    rows = [(1, "a b\tc\n\na b\tc\n #$%&|<>* é"), (2, None), (3, "x " * 100_000)]
    got = {r._id: tuple(r[c] for c in quality.COUNTS) for r in quality.judge(docs_of(rows)).collect()}
    assert got == {1: (8, 15, 8, 1, 6), 2: (0, 0, 0, 0, 0), 3: (100_000, 100_000, 0, 0, 100_000)}
    assert quality.judge(docs_of([])).collect() == [] and quality.kept_rows(docs_of([])).collect() == []


def test_shared_lines_of_many_documents_are_all_found(spark, docs_of):
    """300 documents of a host with 30 common lines and one line of their own: every common line counts 300."""
    for seed in range(4):
        common = [f"common line {'abcdefghijklmnopqrstuvwxyzABCD'[k]} of seed {'pqrs'[seed]}{k * 'x'}" for k in range(30)]
        rows = [(k, "\n".join([*common, "own " + "".join("abcdefghij"[int(c)] for c in f"{seed}{k}")]), "en", "h", 0) for k in range(300)]
        rows += [(1000 + k, "\n".join(common[:2]) + "\ncopied in whole", "en", "h", 0) for k in range(50)]
        m = docs_of(rows, extra=False).select(quality.measured("text").alias("m"), "source")
        bad = quality.boilerplate(m.select(m.source.alias("host"), "m.lines")).collect()
        assert len(bad) == 30
