"""Tests of the findings of round 4 on the operators for training data."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from contestframe.llm import chunks


@pytest.mark.parametrize("step", ["repeated_chunks", "holders"])
def test_a_chunk_does_not_carry_the_lists_of_its_document(spark, monkeypatch, step):
    """each repeated chunk copied all chunks of its document, the square of their number in memory."""
    n = 4000
    lists = spark.createDataFrame([], "_id bigint, _sum bigint, low array<bigint>, high array<bigint>, end array<bigint>, words array<bigint>")
    column = lambda x: pa.array([x], pa.list_(pa.int64()))
    number = np.arange(n)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([9]), *map(column, (number, number + 1, 10 * (number + 1), np.full(n, 5)))], lists.columns)
    monkeypatch.setattr(chunks, "arrow_map", lambda df, fn, schema: fn)
    wanted = SimpleNamespace(value=np.full(64, -1, np.int64).view(np.uint64))
    run = chunks.repeated_chunks(lists, wanted, 50, 8) if step == "repeated_chunks" else chunks.holders(lists, wanted)
    pool = pa.default_memory_pool()
    most = pool.max_memory()
    out = pa.Table.from_batches(run(batch if step == "repeated_chunks" else batch.select([0, 1, 2, 3])))
    assert out["low"].to_pylist() == number.tolist() and set(out["_id"].to_pylist()) == {7} and set(out["_sum"].to_pylist()) == {9}
    assert pool.max_memory() < most + 20e6
