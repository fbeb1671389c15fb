"""License scans on small cases; the registered query is compared with its SQL in test_oracles.py."""

from contestframe.llm import licenses


def spans(spark, docs_of, rows):
    got = licenses.scan(docs_of(rows)).collect()
    return sorted((str(r.doc_id), r.n_words, [(s.start, s.label) for s in r.spans]) for r in got)


def test_phrases_at_every_place(spark, docs_of):
    rows = [(1, "MIT License, mit-license and the Mit\nLicense"), (2, "general public licenses"), (3, None), (4, ""), (None, "x GENERAL PUBLIC license"), (1, "MIT License, mit-license and the Mit\nLicense"), (5, "émit license")]
    assert spans(spark, docs_of, rows) == sorted([
        ("1", 8, [(0, "mit"), (2, "mit"), (6, "mit")]), ("1", 8, [(0, "mit"), (2, "mit"), (6, "mit")]), ("2", 3, []), ("3", 0, []), ("4", 0, []),
        ("None", 4, [(1, "gpl")]), ("5", 2, [])])


def test_notices_with_changes(spark, docs_of):
    notice = "Permission is hereby granted, free of charge, to any natural person obtaining a copy of the software and associated documentation files"
    long = "filler words " * 60_000 + notice
    rows = [(1, notice), (2, long), (3, "Permission is hereby granted to sing"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0.")]
    got = {k: [label for _, label in s] for k, _, s in spans(spark, docs_of, rows)}
    assert got == {"1": ["mit-text"], "2": ["mit-text"], "3": [], "4": ["gpl-3.0", "gpl"], "5": ["cc-by-nc-4.0"]}
    assert spans(spark, docs_of, []) == []
