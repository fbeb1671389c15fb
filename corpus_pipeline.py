"""The corpus pipeline: five stages over documents, each calling one operator of contestframe.llm.

Every stage takes the documents that its predecessor kept and, but for the last, returns documents with the
same columns: quality rules drop rejected documents and boilerplate lines, SimHash keeps one document of each group
of near-duplicates (null and empty texts are one group), decontamination drops documents that overlap a benchmark item, the secret scan replaces
secrets by a mark, and BPE turns texts into token ids. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contestframe.llm import bpe, decontam, quality, secrets, simhash
from contestframe.llm.queries import table, token_digests, tokenizer_config
from contestframe.llm.texts import recounted, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without the lines that many documents of their source hold."""
    return recounted(quality.kept_rows(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of copies: a five-word similarity of 0.8 or more, among the candidates that SimHash finds."""
    return simhash.keep_distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return recounted(secrets.redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the token ids."""
    config = tokenizer_config()
    return token_digests(bpe.encode(docs, config), config)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("BPE", encode),
]
ORACLE_SQL = None  # fingerprints and token ids are beyond SQL; a brute-force test covers the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each result is a written table before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
