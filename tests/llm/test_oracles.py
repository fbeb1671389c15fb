"""Every registered query of this package that has SQL, against it."""

import duckdb
import pytest

from contestframe.llm.oracle import ORACLES
from contestframe.llm.queries import QUERIES
from tools.check import TABLES, canonical


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_names():
    assert set(ORACLES) <= set(QUERIES) and [f"op{n}" for n in range(1, 14)] == [q.split("_")[0] for q in QUERIES]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = canonical(QUERIES[name](spark, sf).toPandas()), canonical(duck.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
