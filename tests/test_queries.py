"""Every query against its independent SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.plans.oracles import ORACLES
from tallyframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def value(x):
    if isinstance(x, bool):
        return int(x)
    if type(x).__name__ in ("float", "Decimal"):
        return "nan" if x != x else round(float(x), 6) + 0.0
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(value(r[i])) for i in order) for r in found])


def compare(spark, duck, name, query, sql):
    got, want = query(spark, DATA), duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert a == b and a, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLES:
        compare(spark, duck, name, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_of_problems_are_left_to_their_subpackage():
    import re

    assert not [n for n in QUERIES if re.match(r"p\d+_", n)]
