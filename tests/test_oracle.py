"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from larkspire.plans import catalogue, more, stored  # noqa: F401  (these register their queries in the catalogue)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def value(x):
    if isinstance(x, float | decimal.Decimal):
        return repr(round(float(x), 5) + 0.0)
    return x.isoformat() if isinstance(x, datetime.datetime) else repr(x)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, db, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = sorted(tuple(map(value, r)) for r in df.select(*cols).collect())
    rel = db.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert found == sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
