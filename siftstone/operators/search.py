"""Exact vector search by cosine distance, with facet filters before the top k, and measures of what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, norm
from ..session import ship

#: Queries that are broadcast; more stream past parts of the collection.
BROADCAST_QUERIES = 1_000
#: From this many queries on, rows meet them as a matrix product instead of pair by pair.
MATRIX_QUERIES = 64
#: Bytes of a part's vectors in memory, so that parts grow in number with the collection; distances that are held at once.
PART_BYTES, HELD = 64 << 20, 500_000


def search(collection: DataFrame, queries: DataFrame, k: int, where: Column | None = None, facet: str | None = None, id_col: str = "id", vector: str = "embedding", wide: str | None = None) -> DataFrame:
    """(query_id, rank from 1, id, distance, facet): the k nearest rows of each query, ties to the smaller id; k above the number of rows gives all. where filters the
    collection first; facet names a column that must be equal in query and row, but for queries where the column that wide names is true, which meet all rows. Rows whose vector is null or zero, or whose norm isn't finite, are not found, and a null facet equals none.

    The window's top k is pre-aggregated in each task (WindowGroupLimit), so only k rows a query and task are shuffled."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = collection if where is None else collection.where(where)
    keep = [facet] if facet else []
    c = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("_v"), *keep).withColumn("_n", norm("_v")).where("_n > 0 AND _n < double('infinity')")
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("_q"), *(F.col(f).alias(f"_{f}") for f in keep), F.coalesce(F.col(wide), F.lit(False)).alias("_wide") if wide else F.lit(False).alias("_wide"))
    q = q.withColumn("_m", norm("_q")).where("_m > 0 AND _m < double('infinity')")
    if facet:
        c, q = c if wide else c.where(F.col(facet).isNotNull()), q.where(F.col(f"_{facet}").isNotNull() | F.col("_wide"))
    few = queries.limit(BROADCAST_QUERIES + 1).count()
    if few > BROADCAST_QUERIES:
        return _top(by_parts(c, q, k, facet), k)
    if few >= MATRIX_QUERIES:
        return _top(by_matrix(c, q, k, facet), k)
    same = ((F.col(facet) == F.col(f"_{facet}")) | F.col("_wide")) if facet else F.lit(True)
    met = c.join(F.broadcast(q), same)
    scored = met.select("query_id", "id", *keep, *(f"_{f}" for f in keep), cosine_distance("_q", "_v", "_m", "_n").alias("distance"))
    return _top(scored, k)


def _top(scored: DataFrame, k: int) -> DataFrame:
    # Vectors of another length have no distance: they stand last and go after the top k, so that no filter computes distances twice.
    nearest = Window.partitionBy("query_id").orderBy(F.asc_nulls_last(F.round("distance", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).where("distance is not null")


class Part:
    """Rows of the collection whose vectors have one length, in order of their ids, as unit vectors."""

    def __init__(self, rows: pd.DataFrame, facet: str | None):
        rows = rows.sort_values("id", kind="stable")
        self.ids = rows["id"].to_numpy()
        self.facets = rows[facet].to_numpy(object) if facet else None
        self.codes, self.kinds = pd.factorize(self.facets) if facet else (None, ())
        self.unit = np.stack(rows["_v"].to_list()).astype(float) / rows["_n"].to_numpy(float)[:, None]

    def nearest(self, names: np.ndarray, unit: np.ndarray, facets: np.ndarray | None, k: int, wide: np.ndarray | None = None) -> Iterator[tuple]:
        """(query_id, id, facet of the row, facet of the query, distance): the k nearest rows of each query, ranked on distances rounded as the final ranking rounds them. Where
        wide is true, a query's facet doesn't count."""
        step = max(1, HELD // len(self.ids))
        if facets is not None:
            number = {kind: i for i, kind in enumerate(self.kinds)}
            own = np.array([number.get(f, -2) for f in facets])  # rows without a facet are -1
            wide = np.zeros(len(own), bool) if wide is None else wide.astype(bool)
        for at in range(0, len(unit), step):
            d = 1 - unit[at : at + step] @ self.unit.T
            order = np.round(d, 9)
            if facets is not None:
                order[(own[at : at + step, None] != self.codes[None, :]) & ~wide[at : at + step, None]] = np.inf
            i, j = _least(order, k)
            kept = np.isfinite(order[i, j])
            i, j = i[kept], j[kept]
            told = (self.facets[j], facets[at + i]) if facets is not None else (None, None)
            yield names[at + i], self.ids[j], *told, d[i, j]


def _least(order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k least of each line, of equal ones the first; a line isn't sorted for them."""
    if k >= order.shape[1]:
        i = np.repeat(np.arange(len(order)), order.shape[1])
        return i, np.tile(np.arange(order.shape[1]), len(order))
    last = np.partition(order, k - 1, axis=1)[:, k - 1 : k]
    below, same = order < last, order == last
    same &= np.cumsum(same, axis=1) <= k - below.sum(axis=1, keepdims=True)
    return np.nonzero(below | same)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _found(c: DataFrame, q: DataFrame, facet: str | None) -> tuple[str, list[str]]:
    """The schema of what nearest() gives, and the names of its columns."""
    more = f", {facet} {_kind(c, facet)}, _{facet} {_kind(q, '_' + facet)}" if facet else ""
    return f"query_id {_kind(q, 'query_id')}, id {_kind(c, 'id')}{more}, distance double", ["query_id", "id", *([facet, f"_{facet}"] if facet else []), "distance"]


def _frames(found: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    for columns in found:
        yield pd.DataFrame(dict(zip(names, (x for x in columns if x is not None), strict=True)))


def by_matrix(c: DataFrame, q: DataFrame, k: int, facet: str | None) -> DataFrame:
    """c(id, _v, _n, facet) against at most BROADCAST_QUERIES rows of q(query_id, _q, _m, _facet): the k nearest of each Arrow batch for each query."""
    ship(c.sparkSession)
    rows = q.collect()  # bounded by BROADCAST_QUERIES
    groups = []
    for size in sorted({len(r["_q"]) for r in rows}):
        own = [r for r in rows if len(r["_q"]) == size]
        facets = np.array([r[f"_{facet}"] for r in own], object) if facet else None
        groups.append((size, np.array([r["query_id"] for r in own], object), np.array([r["_q"] for r in own], float) / np.array([r["_m"] for r in own])[:, None], facets, np.array([r["_wide"] for r in own], bool)))
    ddl, names = _found(c, q, facet)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["_v"].map(len).to_numpy()
            for size, ids, unit, facets, wide in groups:
                if (lengths == size).any():
                    yield from _frames(Part(b[lengths == size], facet).nearest(ids, unit, facets, k, wide), names)

    return c.mapInPandas(run, ddl)


def by_parts(c: DataFrame, q: DataFrame, k: int, facet: str | None) -> DataFrame:
    """As by_matrix, for any number of queries: a task meets a part's rows first, then the queries, batch by batch. Rows are shuffled once, queries once for each part."""
    ship(c.sparkSession)
    n, length = c.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(1))).first()
    parts = max(1, -(-n * length * 8 // PART_BYTES), min(2 * c.sparkSession.sparkContext.defaultParallelism, n // 1000))
    keep = [facet] if facet else []
    # Rows have no query's columns, and queries none of rows; no nulls, which would make numbers of whole ones floating in pandas.
    blank = lambda df, name: F.lit(0).cast(_kind(df, name)).alias(name)
    # Rows by their ids' hash: equal vectors are spread.
    rows = c.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_part"), F.lit(False).alias("_is_query"), "id", blank(q, "query_id"), "_v", "_n", F.lit(False).alias("_wide"), *keep, *(blank(q, f"_{f}") for f in keep))
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(True).alias("_is_query"), blank(c, "id"), "query_id", F.col("_q").cast(c.schema["_v"].dataType).alias("_v"), F.col("_m").alias("_n"), "_wide", *(blank(c, f) for f in keep), *(f"_{f}" for f in keep))
    met = rows.unionByName(asked).repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_is_query")
    ddl, names = _found(c, q, facet)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now, known = None, {}
        for batch in batches:
            for (part, is_query), b in batch.groupby(["_part", "_is_query"], sort=True):
                if part != now:
                    held, now, known = [], part, {}
                if not is_query:
                    held.append(b[["id", "_v", "_n", *keep]])
                    continue
                if held:
                    whole = pd.concat(held)
                    lengths = whole["_v"].map(len)
                    known, held = {size: Part(whole[lengths == size], facet) for size in lengths.unique()}, []
                lengths = b["_v"].map(len)
                for size, own in known.items():
                    some = b[lengths == size]
                    if len(some):
                        unit = np.stack(some["_v"].to_list()).astype(float) / some["_n"].to_numpy(float)[:, None]
                        yield from _frames(own.nearest(some["query_id"].to_numpy(), unit, some[f"_{facet}"].to_numpy(object) if facet else None, k, some["_wide"].to_numpy()), names)

    return met.mapInPandas(run, ddl)


def precision(ranked: DataFrame, useful: str = "useful") -> DataFrame:
    """Context precision of each query: the mean of precision at the useful ranks; 0 without any."""
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = ranked.withColumn("_at", F.sum(F.col(useful).cast("int")).over(run) / F.col("rank"))
    return at.groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col(useful), F.col("_at"))), F.lit(0.0)).alias("context_precision"))


def f1(p: str | Column, r: str | Column) -> Column:
    """Harmonic mean; 0 if both are 0; null if either isn't finite."""
    p, r = (F.col(x) if isinstance(x, str) else x for x in (p, r))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite(p) & finite(r), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
