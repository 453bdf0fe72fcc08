"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers floor(1024 x). Rows are dealt into blocks, and each block is an index of its own: for every dimension the
rows in order of their component, cut into segments of one impact level (LEVEL units). A query takes segments in descending order
of their contribution, in rounds of ever lower ones over all dimensions: a positive query component reads a list from the top, a negative one
from the bottom. After each round the unread segments bound what any vector can still gain; a vector whose bound is below the k-th
lower bound is no member. Once a round would read more than the TAIL-th part of all postings one by one, what is left of each list is
read as one segment, kept in the order of rows, the lists with the most to add first. Reading stops only when the bounds prove that few
enough vectors are left, or nothing is unread, and all possible members are rescored exactly. A block's k best of a query are merged by a pre-aggregated, bounded top-k.

A task meets a block's rows first, builds its index once, and then the queries, batch by batch: it holds a block (BLOCK_BYTES) and a batch,
whatever the table's size. Vectors are shuffled once, queries once for each block. They come from a scan or a checkpoint: their dealing into
blocks must not change if a task is run again.

Vectors that are null, hold null or non-finite components or differ in length from a query take no part against it. A vec_id stands for one row: rows that
repeat one count once, at their best score against the best of the query's, and none of the query's own id is a candidate; a null vec_id takes no
part. Ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

K, LEVEL, SCALE = 10, 16, 1024
#: A block's components at 4 bytes each, at most (an index takes five times as much); rows of a block below which cores may rather stand idle.
BLOCK_BYTES, LEAST_ROWS = 32 << 20, 4096
#: Each round takes segments down to this part of the last one's least contribution.
SHRINK = 0.5
#: Postings read one by one, at most: this part of all; how many times reading whole lists stops to look for a proof.
TAIL, TAIL_PARTS = 16, 3
#: Rescoring starts when at most this many vectors (beside k), or this part of a block, may be members.
FEW, FEW_PART = 256, 64


def narrow(x: np.ndarray) -> np.ndarray:
    """As 32 bits if that holds all values."""
    return x.astype(np.int32) if not x.size or np.abs(x).max() < 1 << 31 else x


class Block:
    """Impact-ordered postings of integer vectors, all of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], narrow(x[order])
        self.starts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]])  # of each id's rows
        self.unique = len(self.starts) == len(ids)
        level = np.ascontiguousarray(np.floor_divide(self.x, LEVEL).T)
        self.low, self.high = level.min(1).astype(np.int64), level.max(1).astype(np.int64)
        above = narrow(level - self.low[:, None])  # of each dimension and row: levels above the least
        self.order = np.argsort(above, axis=1, kind="stable").astype(np.int32)  # of each dimension, by rising level
        self.sorted, self.above = np.take_along_axis(above, self.order, 1), above.astype(np.float64)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best of all rows whose id is not own; repeated ids once."""
        n = len(self.ids)
        others = self.ids != own
        kinds = self.ids[self.starts] != own
        if kinds.sum() <= k:
            return self.best(np.flatnonzero(others), q, k)
        up, worth = q >= 0, np.abs(q)
        depth = self.high - self.low
        step = LEVEL * worth
        spread = depth * step  # the most a dimension adds to its worst level for this query
        slack = int((worth * (LEVEL - 1)).sum())  # within levels
        # Floating point counts whole numbers exactly up to 2 ** 53, and faster.
        kind = np.float64 if float(spread.sum()) + slack < 1 << 53 else np.int64
        gained = np.zeros(n, kind)
        read = np.zeros(len(q), np.int64)  # postings read of each dimension
        unread = spread.copy()  # the most that a dimension's unread postings add
        top = float(spread.max(initial=0))

        def members() -> np.ndarray | None:
            """Rows that may be among the best, if that's proven of few enough. A vector's gain is in gained + [0, unread + slack]."""
            sure = gained if self.unique else np.maximum.reduceat(gained, self.starts)
            bar = np.partition(sure[kinds], -k)[-k]
            open_ = others & (gained + (int(unread.sum()) + slack) >= bar)
            few = np.count_nonzero(open_) <= max(FEW, n // FEW_PART) + k
            return np.flatnonzero(open_) if few or not unread.any() else None

        cut, found = top, None
        while found is None and unread.any():
            cut *= SHRINK
            need = np.floor_divide(cut, np.maximum(step, 1)).astype(np.int64) + 1  # levels above the worst whose impact exceeds cut
            due = np.flatnonzero((step > 0) & (spread > cut) & (unread > 0))
            ends = {d: n - int(np.searchsorted(self.sorted[d], need[d], "left")) if up[d] else int(np.searchsorted(self.sorted[d], depth[d] - need[d], "right")) for d in due}
            if sum(ends.values()) > n * len(q) // TAIL:
                break
            for d, end in ends.items():
                part = slice(n - end, n - read[d]) if up[d] else slice(read[d], end)
                levels = self.sorted[d, part].astype(np.int64)
                gained[self.order[d, part]] += (levels if up[d] else depth[d] - levels) * step[d]
                read[d], unread[d] = end, min(unread[d], (need[d] - 1) * step[d])
            if ends:
                found = members()
        tail = np.argsort(-unread, kind="stable")[: np.count_nonzero(unread)] if found is None else []
        for lists in np.array_split(tail, TAIL_PARTS):
            if not len(lists) or found is not None:
                continue
            for d in lists[read[lists] > 0]:  # read before, and again now
                part = slice(n - read[d], n) if up[d] else slice(0, read[d])
                before = self.sorted[d, part].astype(np.int64)
                gained[self.order[d, part]] -= (before if up[d] else depth[d] - before) * step[d]
            gained += np.where(up, step, -step)[lists].astype(kind) @ self.above[lists].astype(kind, copy=False)
            gained += int((depth * step)[lists[~up[lists]]].sum())
            unread[lists] = 0
            found = members()
        return self.best(members() if found is None else found, q, k)

    def best(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.x[rows].astype(np.int64) @ q
        best = np.lexsort((self.ids[rows], -scores))
        _, first = np.unique(self.ids[rows][best], return_index=True)
        first = np.sort(first)[:k]
        return self.ids[rows][best][first], scores[best][first]


def quantised(embeddings: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    whole = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole).select("vec_id", x.alias("x"))


def blocks_of(rows: int, length: int, cores: int, block_bytes: int = BLOCK_BYTES) -> int:
    """As few blocks as memory allows, for queries go to each; but work for all cores."""
    return max(1, -(-rows * max(1, length) * 4 // block_bytes), min(2 * cores, rows // LEAST_ROWS))


RESULT = "query_id long, vec_id long, score long"


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From rows (b, is_query, vec_id, x) in order of b and is_query: each query's k best of each block."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, components, lengths of the block's rows so far
    now, index = None, {}
    for batch in batches:
        b, is_query = batch.column("b").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (is_query[1:] != is_query[:-1])])
        for at, end in zip(cuts, [*cuts[1:], len(b)], strict=True):
            part = batch.slice(at, end - at)
            ids, x = part.column("vec_id").to_numpy(), part.column("x")
            flat, lengths = x.flatten().to_numpy(), np.diff(x.offsets.to_numpy())
            if b[at] != now:
                held, now, index = [], b[at], {}
            if not is_query[at]:
                held.append((ids, flat, lengths))
                continue
            if held:
                index, held = indexes(held), []
            out = [(np.zeros(0, np.int64),) * 3]
            for own, q in zip(ids, np.split(flat, np.cumsum(lengths)[:-1]), strict=True):
                if len(q) in index:
                    found, scores = index[len(q)].search(q.astype(np.int64), own, k)
                    out.append((np.full(len(found), own), found, scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def indexes(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, Block]:
    """An index for each length of vectors."""
    ids, flat, lengths = (np.concatenate(c) for c in zip(*held, strict=True))
    starts = np.cumsum(lengths) - lengths
    return {int(size): Block(ids[own := lengths == size], flat[(starts[own][:, None] + np.arange(size)).reshape(-1)].reshape(int(own.sum()), size)) for size in np.unique(lengths)}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vectors and queries (vec_id, x array<long>; inner products fit 64 bits): query_id, rank from 1, vec_id and score of each query's k best vectors of other ids."""
    spark = vectors.sparkSession
    ship(spark)
    n, length = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = blocks_of(n, length, spark.sparkContext.defaultParallelism, block_bytes)
    # Equal vectors are dealt over all blocks: by place, not by value.
    v = vectors.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("b"), F.lit(False).alias("is_query"), "vec_id", "x")
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("is_query"), "vec_id", "x")
    met = v.unionByName(q).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "is_query")
    found = met.mapInArrow(lambda batches: searched(batches, k), RESULT)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vector_top_k(embeddings: DataFrame, every: int = 100) -> DataFrame:
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0).distinct())


TOP_K_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x) GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
