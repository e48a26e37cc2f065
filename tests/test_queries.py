"""Every query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from flowlens.plans import host_queries, queries as plans

assert host_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def compare(spark, db, query, sql):
    df = query(spark, SF)
    got = db.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(shown(dict(zip(names, r, strict=True))[c]) for c in order) for r in got.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, db, name):
    compare(spark, db, plans.QUERIES[name], plans.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
