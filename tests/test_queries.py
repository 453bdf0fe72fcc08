"""Every query that SQL can express, against DuckDB on the same tables."""

import decimal
import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return (1, repr(round(float(v), 6) + 0.0))
    return (1, str(v))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    at = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in at) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == at
    order = [columns.index(c) for c in at]
    assert got == sorted(tuple(value(r[i]) for i in order) for r in rel.fetchall())


def test_entry_and_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["rag_evaluation"])
def test_queries_without_sql_give_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
