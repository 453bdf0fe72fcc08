"""The corpus pipeline: quality, near duplicates, benchmark decontamination, mixing, sharding.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; its rows are written as Parquet and read again as the next one's docs.
All but the last keep the columns of documents. SQL can't express the stages, so tests hold run() against a brute-force version.

Null, empty and very long texts, null or repeated ids, ties and repeated rows are treated as each operator's docstring says: null and empty
texts are scored like any other, are near duplicates of each other, hold nothing of the benchmark, and have no words, so that the
mix never takes them. Extra columns pass through all stages but the last; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftstone.llm import decontam, mixing, quality, sharding, simhash
from siftstone.llm.common import drop_folder, shared_dir, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between two is in the shared folder, so a lost executor costs no more than a stage; a stage's rows go once the next one's are written, and only the result's stay."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            drop_folder(spark, f"{at}/{before}")
        before = name
    return docs
