"""Sharding by sampled splitters, under the law "bytes": contiguous key ranges whose sizes are near equal.

A record's key is (hash of its text, doc_id, row). Equal texts lie side by side: groups of up to 1 / GROUP of a shard stay whole, and
one of any size can still be cut. A size-weighted sample of keys (the smallest exponential priorities, SAMPLE for each range) gives
splitters at even quantiles of weight; records are range-partitioned by them, overfull ranges and those of more than RANGE_MOST rows are
subdivided by splitters drawn from their own records until none is left, and running sums inside the ranges place every record. A
record's weight is its size plus the mean size, so a range is bounded in bytes and in rows. Splitters and a line for each range are
all that the driver sees: a range for each RANGE_ROWS to RANGE_MOST rows.

Null texts count as empty: size 1, checksum 0; texts are measured as a whole, however long, and a text above a shard's share is one
record of one shard. Null doc_ids sort first; ties of the key are settled by the row's number; repeated rows are placed one by one; columns beside doc_id and text are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship

SHARDS = 8
#: Rows of a range aimed at; bounds on the number of ranges that the first splitters make; rows of a range above which it is subdivided.
RANGE_ROWS, RANGES, RANGE_MOST = 20_000, (64, 4096), 400_000
SAMPLE = 24
#: A range of more than this many times the mean weight is subdivided.
OVERFULL = 2.0
#: Equal texts of up to this part of a shard aren't parted, but by a range's end.
GROUP = 200
KEY = ("_k", "_id", "_row")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns that sharding needs, without the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_k"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.monotonically_increasing_id().alias("_row"))


def weighted_sample(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """count rows, drawn in proportion to their weight: the smallest exponential priorities; for each value of by, if given."""
    # 53 bits of a hash as a uniform number above 0.
    u = (F.shiftrightunsigned(F.xxhash64(*KEY, F.lit("splitters")), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = rows.select(*by, *KEY, (-F.log(u) / F.col("_w")).alias("_p"))
    if not by:
        return drawn.orderBy("_p").limit(count)
    return drawn.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_p"))).where(F.col("_n") <= count)


def range_of(splitters: np.ndarray) -> Column:
    """The number of splitters at or below the key, by binary search; ties of the first part are settled by the others."""

    first = splitters["_k"]
    tied = {int(k): np.flatnonzero(first == k) for k in np.unique(first)}
    values, starts = np.unique(first, return_index=True)

    @F.pandas_udf("int")
    def place(k: pd.Series, i: pd.Series, row: pd.Series) -> pd.Series:
        k, i, row = k.to_numpy(), i.to_numpy(), row.to_numpy()
        out = np.searchsorted(first, k, "left")
        at = np.minimum(np.searchsorted(values, k), max(0, len(values) - 1))
        for x in np.flatnonzero(values[at] == k) if len(values) else ():
            own = splitters[tied[int(k[x])]]
            out[x] += int(np.searchsorted(own[["_id", "_row"]], np.array((i[x], row[x]), own[["_id", "_row"]].dtype), "right"))
        return pd.Series(out.astype(np.int32))

    return place(*KEY)


def splitters_of(keys: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int, int]]:
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def assign_shards(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS, most: int = RANGE_MOST) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, size, text_crc32, law, shard from 0, slot (gapless from 0 in its shard, in key order)."""
    spark = docs.sparkSession
    ship(spark)
    rows = checkpoint(sized(docs))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    weighed = rows.withColumn("_w", F.col("size") + F.lit(total / max(1, count)))
    aim = int(min(max(RANGES[0], count // range_rows), RANGES[1]))
    pick = lambda found: [tuple(r[c] for c in KEY) for r in found.toLocalIterator()]  # noqa: E731  at most SAMPLE * RANGES rows
    cuts = splitters_of(pick(weighted_sample(weighed, SAMPLE * aim)), aim)
    dtype = np.dtype([(c, np.int64) for c in KEY])
    while True:
        ranged = weighed.withColumn("_range", range_of(np.array(cuts, dtype)))
        sums = {r["_range"]: r for r in ranged.groupBy("_range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum("_w").alias("w"), F.max("_w").alias("top")).toLocalIterator()}
        mean = sum(r["w"] for r in sums.values()) / max(1, len(sums))
        # A record that is most of its range can't be parted from itself.
        full = {k: int(np.ceil(max(r["w"] / mean, r["n"] / most))) for k, r in sums.items() if r["n"] > most or r["w"] > OVERFULL * mean and r["n"] > 1 and r["top"] < r["w"] / 2}
        # An overfull range's sample is salted: no task sorts a whole range for it.
        salted = ranged.where(F.col("_range").isin(list(full))).withColumn("_salt", F.pmod(F.xxhash64(*KEY), F.lit(4)))
        more: dict[int, list] = {}
        for r in weighted_sample(salted, 4 * SAMPLE, "_range", "_salt").toLocalIterator() if full else ():
            more.setdefault(r["_range"], []).append((r["_p"], tuple(r[c] for c in KEY)))
        new = {c for k, found in more.items() for c in splitters_of([key for _, key in sorted(found)[: 4 * SAMPLE]], full[k])} - {*cuts}
        if not new:
            break
        cuts = sorted({*cuts, *new})
    before, start = {}, (0, 0)  # bytes and rows ahead of each range
    for k in sorted(sums):
        before[k] = start
        start = (start[0] + sums[k]["size"], start[1] + sums[k]["n"])
    placed = _placed(ranged, before, total, shards)
    # Each shard's first row lies in the ranges around the byte where the shard begins: a small part of the rows.
    slack = group_limit(total, shards)
    order = sorted(before)
    near = set()
    for at in (total * s // shards for s in range(1, shards)):
        hit = [i for i, k in enumerate(order) if before[k][0] <= at + slack and before[k][0] + sums[k]["size"] >= at - slack]
        near.update(order[i] for i in (*hit, *(min(i + 1, len(order) - 1) for i in hit[-1:])))
    firsts = {r["shard"]: r["at"] for r in _placed(ranged.where(F.col("_range").isin(sorted(near))), before, total, shards).groupBy("shard").agg(F.min("_at").alias("at")).toLocalIterator()} if near else {}
    begin = [firsts.get(s, 0) if s else 0 for s in range(shards)]
    origin = F.element_at(F.array(*(F.lit(int(x)) for x in begin)), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - origin).cast("long").alias("slot"))


def _placed(ranged: DataFrame, before: dict[int, tuple[int, int]], total: int, shards: int) -> DataFrame:
    """With each row's place among all (_at) and its shard: the part of all bytes that its group's middle falls in, or its own if the group is large."""
    if not before:
        return ranged.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("_at"))
    # A line for each range: at most RANGES, and as many again for each round of subdividing.
    ahead = ranged.sparkSession.createDataFrame([(k, int(size), int(n)) for k, (size, n) in before.items()], "_range int, _bytes long, _rows long")
    w = Window.partitionBy("_range").orderBy(*KEY)
    run = ranged.join(F.broadcast(ahead), "_range").withColumn("_upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    # Equal texts of a range stand together: with RANGE frames a group's end and start come from the same sorted partition.
    group = Window.partitionBy("_range").orderBy("_k")
    run = run.withColumn("_end", F.sum("size").over(group.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_whole", F.sum("size").over(group.rangeBetween(0, 0)))
    small = F.col("_whole") <= group_limit(total, shards)
    middle = F.col("_bytes") + F.when(small, F.col("_end") - F.col("_whole") / 2).otherwise(F.col("_upto") - F.col("size") / 2)
    return run.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int").alias("shard"), (F.col("_rows") + F.col("_n") - 1).alias("_at"))


def group_limit(total: int, shards: int) -> int:
    """Bytes up to which equal texts stay in one shard; larger groups are cut where the shard is full."""
    return total // shards // GROUP


def shard_digest(docs: DataFrame) -> DataFrame:
    return assign_shards(docs).withColumn("grown_shard", F.lit(None).cast("int"))
