"""Each query against the same result in DuckDB, over whole small tables."""

import decimal

import duckdb
import pytest

import __spark_entry__
from quarry.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
