"""Places in groups of any size, against a sort on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import context, ranks
from siftstone.session import checkpoint

ROWS = "grp string, a long, b long, t string, number_of long"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables in as many partitions as large ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def made(seed, n):
    """A hot group with most rows, a null one, ties of a, nulls of a, copies, blanks and nulls of text."""
    r = random.Random(seed)
    texts = ["Same  text", "same text", "SAME\nTEXT", "", " \n", None, *(f"text {i}" for i in range(40))]
    return [(r.choice(["hot", "hot", "hot", "hot", "b", None, ""]), r.choice([None, 1, 1, 2, r.randrange(50)]), i, r.choice(texts), i) for i in range(n)]


def ordered(rows):
    """By group, then a falling with nulls last, then b."""
    out = {}
    for x in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2])):
        out.setdefault(x[0], []).append(x)
    return out


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_numbers_are_those_of_a_sort(spark, n):
    rows = made(1, n)
    got = ranks.numbered(spark.createDataFrame(rows, ROWS).repartition(7), "grp", [F.desc("a"), F.asc("b")])
    assert got.columns == ["grp", "a", "b", "t", "number_of", "number"]
    want = {(g, x[2]): k for g, xs in ordered(rows).items() for k, x in enumerate(xs, 1)}
    assert {(r.grp, r.b): r.number for r in got.collect()} == want and got.count() == n


def test_repeated_rows_are_numbered_side_by_side(spark):
    got = ranks.numbered(spark.createDataFrame([("g", 1, 1, "x", 0)] * 500 + [("g", 2, 1, "y", 0)], ROWS), "grp", [F.asc("a")])
    assert sorted((r.a, r.number) for r in got.collect()) == [*((1, k) for k in range(1, 501)), (2, 501)]


def test_no_partition_holds_a_hot_group(spark, monkeypatch):
    """The rows that a task numbers are those of one partition of the order, not of the group."""
    held = []
    monkeypatch.setattr(ranks, "checkpoint", lambda df: held.append(checkpoint(df)) or held[-1])
    got = ranks.numbered(spark.range(40_000).select(F.lit("hot").alias("grp"), F.col("id").alias("a")), "grp", [F.asc("a")])
    assert got.where("number <> a + 1").count() == 0
    most = held[0].groupBy("_place_group", "_place_part").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 20_000 and most[1] > 2


@pytest.mark.parametrize("large", [False, True])
def test_distinct_in_order_of_large_and_small_groups(spark, large):
    rows = [x for x in made(2, 2000) if x[0] is not None]
    want = {}
    for g, xs in ordered(rows).items():
        seen = set()
        for x in xs:
            key = " ".join((x[3] or "").split()).casefold()
            if key and key not in seen:
                seen.add(key)
                want[g, x[2]] = len(seen)
    df = ranks.numbered(spark.createDataFrame(rows, ROWS), "grp", [F.desc("a"), F.asc("b")], "rank")
    got = context.distinct_in_order(df, "t", "grp", "rank", large=large)
    assert {(r.grp, r.b): r.number for r in got.collect()} == want


def test_copies_are_dropped_before_the_shuffle(spark):
    df = spark.createDataFrame(made(3, 100), ROWS)
    assert "WindowGroupLimit" in context.first_of_equals(df, "t", "grp", "b")._jdf.queryExecution().executedPlan().toString()
