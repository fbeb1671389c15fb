"""Substring dedup: cuts, planted passages, and results against a plain chunk table."""

import random
from collections import defaultdict

import numpy as np

from contestframe.llm import chunks, queries


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeioubdgklmnrst") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_rolling_hash_and_cuts():
    raw = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    slow = [sum(int(chunks.GEAR[raw[t - k]]) << k for k in range(min(16, t + 1))) & 0xFFFF for t in range(300)]
    assert chunks.gear_hash(raw).tolist() == slow
    text = "é " + prose(random.Random(2), 300) + "\nx"
    ends, words, parts = chunks.cut(text)
    assert b"".join(parts).decode() == text and ends[-1] == len(text) and sum(words) == len(text.split())
    moved = {p for p in chunks.cut("one more " + text)[2]}
    assert len(set(parts) - moved) <= 2  # an insertion touches the chunks beside it only


def plain(rows):
    first, cuts = {}, {}
    held = defaultdict(set)
    for k, t in rows:
        cuts[k] = chunks.cut(t) if t else ([], [], [])
        for p in cuts[k][2]:
            held[p].add(k)
    out = set()
    for k, (ends, words, parts) in cuts.items():
        keepers = [min(held[p]) for p in parts]
        run = []
        for n in range(len(parts) + 1):
            if n < len(parts) and min(held[parts[n]]) != k:
                run.append(n)
                continue
            if run:
                size = sum(words[i] for i in run)
                beside = (words[run[0] - 1] if run[0] else 0) + (words[n] if n < len(parts) else 0)
                once = {parts[i]: (keepers[i], words[i]) for i in run}
                most = max(sum(w for o, w in once.values() if o == k2) for k2, _ in once.values())
                if most >= 8 and 2 * most > sum(w for _, w in once.values()) and size + beside >= 50:
                    out.add((k, ends[run[0] - 1] if run[0] else 0, ends[run[-1]], size))
            run = []
    return out


def test_planted_passages(spark, docs_of):
    rnd = random.Random(8)
    passage, short = prose(rnd, 56), prose(rnd, 20)
    rows = [(k, prose(rnd, 150)) for k in range(60)]
    rows += [(100 + k, f"{prose(rnd, 40)} {passage} {prose(rnd, 30)}") for k in range(25)]
    rows += [(200 + k, f"{prose(rnd, 40)} {short} {prose(rnd, 30)}") for k in range(25)]
    whole = prose(rnd, 200)
    rows += [(300 + k, whole) for k in range(4)] + [(400, None), (401, ""), (402, "   "), (403, "é" * 100_000)]
    got = chunks.find_repeats(docs_of(rows)).collect()
    caught = {r._id for r in got}
    assert caught == {*range(101, 125), 301, 302, 303}
    assert {r.first_id for r in got} == {100, 300}
    assert {(r._id, r.start, r.end, r.n_words) for r in got} == plain(rows)
    cut = {r.doc_id: r.text for r in chunks.remove_repeats(docs_of(rows)).collect()}
    texts = dict(rows)
    assert cut[100] == texts[100] and cut[301] == "" and cut[400] is None and cut[200] == texts[200]
    assert len(cut[110]) < len(texts[110]) - 0.6 * len(passage) and cut[110].startswith(texts[110][:100])


def test_passages_of_several_keepers(spark, docs_of):
    rnd = random.Random(10)
    a, b, d, c = (b"".join(chunks.cut(prose(rnd, 75))[2][:-1]).decode() for _ in range(4))  # each ends where a chunk ends
    first = prose(rnd, 90).split(" ")
    second = first[:30] + prose(rnd, 30).split(" ") + first[60:]
    third = second[:60] + prose(rnd, 30).split(" ")
    chain = [" ".join(w) for w in (first, second, third)]
    rows = [(k, prose(rnd, 150)) for k in range(30)]
    rows += [(40, f"{prose(rnd, 40)} {a} {prose(rnd, 40)}"), (41, f"{c}{b} {prose(rnd, 40)}"), (42, f"{prose(rnd, 40)} {b[-40:]}{d} {prose(rnd, 40)}"), (43, f"{prose(rnd, 40)} {a}{b}{d} {prose(rnd, 40)}")]
    rows += [(50 + k, f"{prose(rnd, 40)} {chain[min(k, 2)]} {prose(rnd, 40)}") for k in range(4)]
    texts = dict(rows)
    got = {}
    for r in chunks.find_repeats(docs_of(rows)).collect():
        got.setdefault(r._id, []).append(r)
    assert 53 in got and 53 not in {r[0] for r in plain(rows)}  # no keeper has half of it
    assert max(r.n_words for r in got[53]) >= 70 and len(texts) == len(rows)
    assert sum(r.end - r.start for r in got[43]) > 0.8 * len(a + b + d)


def test_repeated_rows_null_ids_and_no_rows(spark, docs_of):
    rnd = random.Random(9)
    text, other = prose(rnd, 120), prose(rnd, 120)
    df = docs_of([(1, text), (1, text), (2, other), (2, text), (None, other)])
    got = sorted((str(r._id), r.n_words) for r in chunks.find_repeats(df).collect())
    assert got == [("2", 120), ("2", 120)]
    assert chunks.remove_repeats(df).columns == df.columns and chunks.remove_repeats(df).count() == 5
    assert chunks.find_repeats(docs_of([])).collect() == []


def test_query_over_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.start_char, r.end_char, r.n_words) for r in queries.op8_substring_dedup(spark, sf).collect()}
    assert got == plain(rows) and got


def shared_words(rows, size=50):
    """For every document its words that lie in a run of `size` words which a document with a smaller id holds too."""
    first = {}
    for k, t in sorted(rows):
        words = t.split()
        for i in range(len(words) - size + 1):
            first.setdefault(tuple(words[i : i + size]), k)
    out = {}
    for k, t in rows:
        words = t.split()
        held = {j for i in range(len(words) - size + 1) if first[tuple(words[i : i + size])] != k for j in range(i, i + size)}
        if held:
            out[k] = held
    return out


def test_recall_of_shared_windows(spark, sf):
    """Against all 50-word windows of the table: every document with a repeat is found, and nearly all repeated words."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    want = shared_words(rows)
    found = {}
    for r in queries.op8_substring_dedup(spark, sf).collect():
        found.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert set(want) <= set(found)
    hit = 0
    for k, t in rows:
        if k in want:
            places, at = [], 0
            for w in t.split():
                at = t.index(w, at)
                places.append(at)
                at += len(w)
            hit += sum(any(a <= places[j] < b for a, b in found[k]) for j in want[k])
    assert hit >= 0.95 * sum(map(len, want.values()))


def test_only_rows_of_mixed_runs_are_dealt_again(spark, docs_of, monkeypatch):
    """The rows of runs that one document keeps are filtered before the join that gathers the others."""
    asked, among = [], chunks.among
    monkeypatch.setattr(chunks, "among", lambda rows, wanted, *cols: asked.append(cols) or among(rows, wanted, *cols))
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text), (2, "own words " + text)]
    assert {r._id for r in chunks.find_repeats(docs_of(rows)).collect()} == {2}
    assert ("_id", "_sum", "run") in asked
