"""Every registered query against its SQL on the smallest tables; those without SQL must give rows of a stable schema."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb
import pytest

from foliant.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    assert frame.count() >= 1
    assert frame.schema == catalogue.QUERIES[name](spark, DATA).schema
