"""Contexts of all hits."""

import pytest

import __spark_entry__ as entry
from tests.test_large_ids import differs

pytest.importorskip("duckdb")


def test_every_text_is_in_a_context(spark, tmp_path):
    rows = [(i, f"Text {i % 40}", "en", "a" if i < 50 else "b", 7) for i in range(53)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert not differs(spark, str(tmp_path), "cited_context", ["documents"])
    got = entry.queries()["cited_context"](spark, str(tmp_path)).select("query", "part").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0)]
