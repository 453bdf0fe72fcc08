"""Connected components by alternating large-star and small-star steps, each a pre-aggregated shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import checkpoint, hot_values, salted_join


def least_neighbour(edges: DataFrame, rows: int) -> tuple[DataFrame, list]:
    """(u, m): the least v of each u, and the u that hold a large part of all edges, as a star's root does. rows: the edges, at most."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if rows <= common.HOT_ROWS:  # no key can be hot
        return least.select("u", "m"), []
    least = checkpoint(least)
    return least.select("u", "m"), hot_values(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links(a, b): undirected, repeats and loops allowed. Gives (node, root) for each node with a link to another; root is the smallest node of its component. Empty links give an empty table.

    A large-star step ties every larger neighbour of a node to the node's least neighbour, a small-star step every smaller one:
    the number of rounds is logarithmic in practice. No step gathers a node's neighbours: least neighbours are pre-aggregated, and edges of
    nodes with many are salted. Each round is checkpointed."""
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, sign = edges.count(), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, hot = least_neighbour(both, 2 * count)
        low = least.select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if count > common.HOT_ROWS:
            large = checkpoint(large)
        tied = salted_join(large, *least_neighbour(large, count))
        edges = checkpoint(tied.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        count, sign = now[0], now
