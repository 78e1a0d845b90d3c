import os

import duckdb
import pytest

from spandrel import queries as Q
from spandrel import queries_more  # noqa: F401
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, tables, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name not in Q.ORACLES:
        assert len(got)
        return
    want = tables.sql(Q.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
