"""Every registered query of the catalog runs on the smallest tables; those with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from corpusloom import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{SF}/{file}')")
    return con


def rows(frame, columns):
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
    else:
        assert len(got) > 0
