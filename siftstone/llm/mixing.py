"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets share out RATIO of all words by weight, none above CAP times its source, the excess reshared by weight. Targets become
equal blocks of BLOCK words: seats go to the highest quotients target / (2 k - 1), first to sources, then each source's seats to
its shards by their size (a shard is a hash range of a source's texts), so each shard has an integer quota that can be
filled on its own. In a shard, documents stand in seeded hash order, and the quota takes the shard's words from the start, around
again if it is larger than the shard: every document is taken whole 0, 1 or 2 times, but for one at the quota's end.

A block of the mix is BLOCK words of a source's texts in the seeded order; quotas count blocks, and a shard's blocks are its texts' words from the
first on. Whole documents (mixed) are taken or left at a quota's end by a seeded chance of the part that the quota covers, so that a source's words
come out at its target on average, however few documents a shard holds.

Only seats near the last one given are ranked; those surely won are counted, so the work is in proportion to sources and shards.
Equal rows are summed before any window: a row that is repeated often is one line with a count, and no window holds a source: shards are
doubled until they hold SHARD_ROWS rows at most on average. Windows over all sources hold one line for each.
Null texts and texts without words have size 0 and are never taken; a null source is a source, the last; doc_ids may repeat or be
null; texts are counted as a whole, however long; texts of equal hash and size share their place; columns beside doc_id, text and source pass through mixed, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, plain_name

RATIO, CAP, BLOCK, SHARDS, SEED = 1.5, 2, 16, 256, 7
#: Rows of a shard above which there are twice as many shards.
SHARD_ROWS = 200_000
WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, ratio: float = RATIO, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes(source, source_size): adds target. Sources are weighed in code point order, null last. The capped sources are the first ones by cap over weight: the level at which resharing ends follows from running sums."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    share = sizes.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    run = (
        share.withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * ratio)
    )
    level = (F.col("_all") - F.col("_before")) / F.col("_left")
    found = run.withColumn("_level", F.max(F.when(level * F.col("_w") <= F.col("_cap"), level)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return found.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def sainte_lague(parties: DataFrame, within: list[str], name: str, votes: str, seats: Column) -> DataFrame:
    """parties with _seats: seats (a column, the same for all of a within group) given to the highest quotients votes / (2 k - 1), ties to the smaller name, null last.

    With d = all votes / seats, rounding votes / d misses the number of seats by at most half the parties, so the last seat's
    quotient is near d / 2 and a party's seats are within a band around votes / d; seats below the band are won, and only those in it
    are ranked, about four for each party."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    x = parties.withColumn("_h", seats.cast("long")).withColumn("_all", F.sum(votes).over(group)).withColumn("_parties", F.count("*").over(group))
    x = x.withColumn("_fair", F.when(F.col("_all") > 0, F.col(votes) * F.col("_h") / F.col("_all")).otherwise(0.0))
    slack = F.col("_fair") * F.col("_parties") / F.greatest(F.col("_h"), F.lit(1)) + 2
    x = x.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_fair") - slack)).cast("long")).withColumn("_high", (F.ceil(F.col("_fair") + slack) + 1).cast("long"))
    x = x.withColumn("_open", F.col("_h") - F.sum("_low").over(group))
    bids = x.where(F.col(votes) > 0).select(*within, name, "_open", F.col(votes).alias("_votes"), F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("_k"))
    order = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(F.desc(F.col("_votes") / (2 * F.col("_k") - 1)), F.col(name).isNull(), name, "_k")
    won = bids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_open")).groupBy(*within, name).agg(F.count("*").alias("_won"))
    keys = [*within, name]
    renamed = won.select(*(F.col(k).alias(f"_r_{k}") for k in keys), "_won")
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return x.join(renamed, on, "left").select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("_seats"))


def slim(docs: DataFrame) -> DataFrame:
    """What mixing needs of each row; the hash stands for the row and is its place in the seeded order."""
    return docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("_hash"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("_hash"), F.lit(shards)).cast("int")


def shards_for(count: int) -> int:
    """SHARDS for each source, doubled while a source of all rows would have more than SHARD_ROWS in each."""
    shards = SHARDS
    while count > shards * SHARD_ROWS:
        shards *= 2
    return shards


def mix_plan(rows: DataFrame, block: int = BLOCK, shards: int = SHARDS, ratio: float = RATIO, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """From slim rows: the sources (source, source_size, target), and of each source's shard how often every document is taken whole (_full) and where the rest of the quota ends: documents before _cut in hash order once more, that at _cut for _part words in each copy."""
    kinds = checkpoint(rows.where("size > 0").groupBy("source", "_hash", "size").agg(F.count("*").alias("_copies")).withColumn("_shard", shard_of(shards)))
    words = F.col("size") * F.col("_copies")
    cells = checkpoint(kinds.groupBy("source", "_shard").agg(F.sum(words).alias("_cell")))
    # A source of nothing but empty texts has no cell.
    sizes = rows.select("source").distinct().join(cells.groupBy(F.col("source").alias("_s")).agg(F.sum("_cell").alias("_sum")), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("_sum", F.lit(0)).cast("long").alias("source_size"))
    sources = checkpoint(source_targets(sizes, ratio, cap, weights))
    total = sources.withColumn("_sum", F.sum("target").over(Window.partitionBy(F.lit(0))))
    quotas = sainte_lague(total, [], "source", "target", F.round(F.col("_sum") / block))
    of = cells.join(quotas.select(F.col("source").alias("_s"), F.col("_seats").alias("_quota")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shares = sainte_lague(of, ["source"], "_shard", "_cell", F.col("_quota"))
    shares = shares.withColumn("_want", F.least(F.col("_seats") * block, F.col("_cell") * cap)).withColumn("_full", F.floor(F.col("_want") / F.col("_cell"))).withColumn("_rest", F.col("_want") - F.col("_full") * F.col("_cell"))
    shares = checkpoint(shares.select("source", "_shard", "_full", "_rest"))
    run = kinds.withColumn("_upto", F.sum(words).over(Window.partitionBy("source", "_shard").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, 0)))
    s = shares.select(F.col("source").alias("_s"), F.col("_shard").alias("_c"), "_rest")
    met = run.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_c")))
    at = met.where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - words < F.col("_rest"))).select(F.col("source").alias("_s"), F.col("_shard").alias("_c"), F.col("_hash").alias("_cut"), F.floor((F.col("_rest") - F.col("_upto") + words) / F.col("_copies")).alias("_part"))
    ends = shares.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_c")), "left").select("source", "_shard", "_full", "_cut", F.coalesce("_part", F.lit(0)).alias("_part"))
    return sources, checkpoint(ends)


def taken(rows: DataFrame, sources: DataFrame, ends: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows with slim's columns: adds source_size, target and taken, the words that the mix takes."""
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS // 10 else df  # noqa: E731  a line for each shard of a source: counted, else rows meet them by a shuffle
    e = few(ends.select(F.col("source").alias("_s"), F.col("_shard").alias("_c"), "_full", "_cut", "_part"))
    t = few(sources.select(F.col("source").alias("_t"), "source_size", "target"))
    met = rows.withColumn("_shard", shard_of(shards)).join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_c")), "left").join(t, F.col("source").eqNullSafe(F.col("_t")))
    more = F.when(F.col("_hash") < F.col("_cut"), F.col("size")).when(F.col("_hash") == F.col("_cut"), F.least("size", "_part")).otherwise(0)
    return met.withColumn("taken", F.coalesce(F.col("_full") * F.col("size") + more, F.lit(0)).cast("long")).drop("_s", "_c", "_t", "_shard", "_full", "_cut", "_part")


def planned(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    shards = shards_for(rows.count())
    return *mix_plan(rows, shards=shards), shards


def mix_digest(docs: DataFrame) -> DataFrame:
    rows = checkpoint(slim(docs))  # texts are read once
    return taken(rows, *planned(rows)).select("doc_id", "size", "source_size", "target", "taken")


def chance(key: str) -> Column:
    """A number from 0 to below 1 that a row's hash gives."""
    return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture: rows of docs, all columns, each as often as the mix takes it. Texts stay whole: a document that is taken in part is there by a seeded chance of that part."""
    whole = F.struct(*map(plain_name, docs.columns)).alias("_doc")
    rows = docs.select(whole, "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text", F.lit(SEED)).alias("_hash"))
    out = taken(rows, *planned(checkpoint(slim(docs))))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance("_hash"))).otherwise(0).cast("int")
    return out.select("_doc", copies.alias("_n")).where("_n > 0").select(F.explode(F.array_repeat("_doc", F.col("_n"))).alias("_doc")).select("_doc.*")
