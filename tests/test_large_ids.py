"""Ids above five digits against the queries' SQL."""

import pytest

import __spark_entry__ as entry
from siftstone.operators import collection
from tests.test_queries import value

duckdb = pytest.importorskip("duckdb")


def differs(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    at = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(at)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(map(value, r)) for r in df.select(*at).collect()) != sorted(tuple(map(value, r)) for r in want)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("large"))
    ids = [7, 10_000, 10_001, 99_999, *range(100_000, 100_024), 1_000_003]
    rows = [(i, "text", "en" if i % 3 else "de", f"src{i % 4}", 90 + i % 7) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["delete_by_source", "file_rows", "ingest_stats", "upsert_counts", "upsert_replace", "upsert_skip", "upsert_update", "existing_vs_new"])
def test_ids_of_more_than_five_digits(spark, large, name):
    assert not differs(spark, large, name, ["documents"])


def test_incoming_rows_count_once(spark):
    stored, incoming = spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), spark.createDataFrame([("a",), ("c",)], "id string")
    assert collection.upsert_counts(stored, incoming, "update").first().asDict() == {"added": 1, "updated": 1, "skipped": 0}
