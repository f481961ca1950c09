"""Every query with SQL against DuckDB on the smallest tables, and the registry itself."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "manifests evidence citations hypotheses verdicts bench_raw eval_items"
).split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_other_queries_run(spark, small, name):
    df = entry.queries()[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.count()
