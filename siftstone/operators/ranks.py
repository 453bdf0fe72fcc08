"""Places in an order, for groups that no single task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "number") -> DataFrame:
    """Adds each row's place in its group, from 1, as row_number() over the group does, but no task sorts a whole group: rows are
    range-partitioned by group and order, each partition counts its rows of a group, and the counts of those before it are carried into it.

    order must tell a group's rows apart; rows that it doesn't are numbered in any order, side by side. Rows of a null group are a group; an
    empty table gives an empty table. The rows are written to the shared folder once, as the counts and the places must be of the same
    partitions, so select the columns that are needed first. Columns named _place_* are taken."""
    ranged = rows.withColumn("_place_group", F.struct(F.col(group))).repartitionByRange("_place_group", *order)
    parts = checkpoint(ranged.withColumn("_place_part", F.spark_partition_id()))
    keys = ["_place_group", "_place_part"]
    ahead = Window.partitionBy("_place_group").orderBy("_place_part").rowsBetween(Window.unboundedPreceding, -1)  # a line for each partition
    counts = parts.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_place_before"))
    place = F.col("_place_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return parts.join(counts, keys).withColumn(name, place).drop(*keys, "_place_before")
