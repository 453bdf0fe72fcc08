"""Scores that lie between two decimals, against the query's SQL and Python."""

import pytest

from siftstone.operators import evaluate
from tests.test_large_ids import differs

pytest.importorskip("duckdb")


def test_lines_of_scores_between_two_decimals(spark, tmp_path):
    chars = [1600, 320, 533, 22_222, 40_000, 66_667, 200_000, 99, 3]
    spark.createDataFrame([(i, "t", "en", "s", n) for i, n in enumerate(chars)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(chars))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert not differs(spark, str(tmp_path), "score_lines", ["documents", "labels"])
    scores = [0.0625, 0.3125, 0.0045, 0.0005, 0.0015, 1.0, 0.0, -0.0001, -0.0, 1234567.8915, 2.0005, 2.0**39 + 0.0625, 1e15, *(i / 2000 for i in range(4000)), *(i / 16 for i in range(160))]
    told = spark.createDataFrame(list(enumerate(scores)), "i long, x double").orderBy("i").select(evaluate.three_decimals("x")).collect()
    assert [r[0] for r in told] == [f"{x:.3f}" for x in scores]
