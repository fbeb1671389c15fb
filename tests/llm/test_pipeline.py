"""The pipeline: stages against their operators' plain results, and its columns."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")

import public_tokenizers  # noqa: E402

from contestframe.llm.queries import table  # noqa: E402


def test_stages_in_order(spark, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(ids) == len(set(ids)) and set(ids) <= kept
        assert len(ids) < len(kept) or k == 3
        kept = set(ids)
        assert docs.where("n_chars <> length(text)").count() == 0
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and len(got) > 50


def test_documents_with_nulls_and_no_rows(spark, docs_of, sf):
    rows = [(1, None), (2, ""), (None, "word " * 3), (3, " ".join(f"w{k}" for k in range(80))), (3, " ".join(f"w{k}" for k in range(80)))]
    for given, n in ((rows, 1), ([], 0)):
        docs = docs_of(given)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == n
