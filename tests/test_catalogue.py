"""Every registered query of the library's own operators agrees with its SQL."""

import math

import duckdb
import pytest

from lodestream.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{float(value):.5f}" if isinstance(value, (int, float)) else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = db.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    got, wanted = rows(df.columns, df.collect()), rows(names, found.fetchall())
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) < 1e-3, (a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
