import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from contestframe.session import get_spark  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", "local[4]")


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *keys):
    """Collected rows as dicts, sorted by keys (or by all columns)."""
    got = [r.asDict() for r in df.collect()]
    return sorted(got, key=lambda r: tuple(str(r[k]) for k in (keys or sorted(r))))


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def assert_same(left, right, keys, cols, tol=1e-9):
    a = {tuple(r[k] for k in keys): r for r in left.select(*keys, *cols).collect()}
    b = {tuple(r[k] for k in keys): r for r in right.select(*keys, *cols).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in cols:
            assert close(a[k][c], b[k][c], tol), (k, c, a[k][c], b[k][c])
