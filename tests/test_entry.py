"""The engine's registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graticule.plans import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    df = engine.queries()[name](spark, SF)
    cursor = con.execute(engine.oracle_sql()[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0] and got[1] == want[1] and got[1]


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_other_queries_repeat(spark, name):
    run = lambda: sorted(map(repr, engine.queries()[name](spark, SF).collect()))
    first = run()
    assert first and first == run()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["actual", "predicted", "n"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())
