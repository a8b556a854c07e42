"""Every registered query of the engine against its SQL, on whole tables."""

import math

import duckdb
import pytest

from lattica.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def test_all_have_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, sql, name):
    df, want = catalogue.QUERIES[name](spark, small), sql.sql(catalogue.ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got, expected = (sorted(map(tuple, x), key=repr) for x in (df.select(order).collect(), want.select(*order).fetchall()))
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))
