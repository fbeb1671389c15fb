"""BPE against the tokenizers library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from contestframe.llm import bpe, queries  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_words_of_any_text(library):
    tool, rnd = bpe.Words(bpe.read_config(PATH)), random.Random(7)
    hard = ["<|endoftext|>", "<|startoftext|>", "it's", "'S", "Σ", "ΑΣ ", "é", "é", "İ", " ", "\x1c", "\x85", "​", "½", "中文", "한", "ﬁ", "_", "\n\n"]
    for _ in range(1500):
        text = "".join(rnd.choice([*hard, chr(rnd.randrange(1, 0x250)), chr(rnd.randrange(0x250, 0xD7FF)), chr(rnd.randrange(0xE000, 0x1FFFF))]) for _ in range(12))
        got = [k for ids in tool.encode(tool.split(text)) for k in ids]
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_encode_and_decode_rows(spark, docs_of, library):
    long = "Long words of text, 1 2 3! " * 4000
    rows = [(1, "One text."), (1, "One text."), (2, None), (3, ""), (None, "no id <|endoftext|> here"), (4, long), (5, "   \n\t"), (6, "ﬁ ΑΣ é")]
    config = bpe.read_config(PATH)
    done = bpe.encode(docs_of(rows), config, buckets=3).withColumn("decoded", bpe.decode(F.col("ids"), config)).collect()
    want = []
    for k, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((k, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in done), key=str) == sorted(want, key=str)


def test_small_packs_agree(spark, docs_of, monkeypatch):
    monkeypatch.setattr(bpe, "PACK_CHARS", 40)
    config = bpe.read_config(PATH)
    rows = [(k, f"text number {k} of many words") for k in range(30)]
    small = {r.doc_id: r.ids for r in bpe.encode(docs_of(rows), config, buckets=4).collect()}
    monkeypatch.setattr(bpe, "PACK_CHARS", 10**9)
    assert small == {r.doc_id: r.ids for r in bpe.encode(docs_of(rows), config, buckets=2).collect()}


def test_empty_table(spark, docs_of):
    assert bpe.encode(docs_of([]), bpe.read_config(PATH)).collect() == []


def test_query_over_the_table(spark, sf, library):
    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    got = {r.doc_id: r for r in queries.op3_bpe(spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids), digest(" ".join(map(str, ids))))
        assert g.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))
