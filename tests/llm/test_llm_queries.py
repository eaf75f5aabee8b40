"""The registered queries on the smallest tables; SQL where there is any, distinct rows everywhere."""

import os

import duckdb
import pytest

from tallyframe.llm.oracles import ORACLES
from tallyframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = [tuple(map(str, r)) for r in got.collect()]
    assert rows and len(rows) == len(set(rows))
    if name in ORACLES:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        want = con.sql(ORACLES[name]).select(*got.columns).fetchall()
        assert sorted(rows) == sorted(tuple(map(str, r)) for r in want)
