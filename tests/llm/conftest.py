import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """A table of documents from (doc_id, text) or longer rows, with columns whose names clash with inner ones."""

    def make(rows, schema=DOCS, extra=True):
        full = [tuple(r) + (None,) * (5 - len(r)) if schema == DOCS else tuple(r) for r in rows]
        df = spark.createDataFrame(full, schema)
        if extra:
            for name in ("row", "body", "key", "_id", "_sum", "host", "words", "fp", "bad", "a", "b"):
                df = df.withColumn(name, df[df.columns[0]].cast("string"))
        return df

    return make
