"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from provenor.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def _rows(table):
    cols = sorted(table.column_names)
    return cols, sorted(tuple(_norm(r[c]) for c in cols) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    want = duck.sql(ORACLES[name]).to_arrow_table()
    assert _rows(got) == _rows(want)
    types = {f.name: str(f.type) for f in got.schema}
    assert types == {f.name: str(f.type) for f in want.schema}


def test_names_are_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
