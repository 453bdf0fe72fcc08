"""A keyed collection's state as DataFrame algebra: Parquet has no MERGE, so each mode builds the next state of (stored, incoming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("skip", "update", "replace")


def existing_and_new(incoming: DataFrame, stored: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    ids = stored.select(key)
    return incoming.join(ids, key, "left_semi"), incoming.join(ids, key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, mode: str, key: str = "id", scope: tuple[str, str] = ("mission", "filepath")) -> DataFrame:
    """The next state. skip: stored rows stay, new ids come. update: incoming rows win. replace: as update, and stored rows of an incoming file (scope) whose ids don't come again go.
    Keys are unique on both sides; incoming replaces whole rows."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "skip":
        return stored.unionByName(incoming.join(stored.select(key), key, "left_anti").select(*stored.columns))
    kept = stored.join(incoming.select(key), key, "left_anti")
    if mode == "replace":
        kept = kept.join(incoming.select(*scope).distinct(), list(scope), "left_anti")
    return kept.select(*stored.columns).unionByName(incoming.select(*stored.columns))


def changes(stored: DataFrame, incoming: DataFrame, mode: str, key: str = "id", scope: tuple[str, str] = ("mission", "filepath")) -> DataFrame:
    """What upsert() changes: rows that come, and stored rows that go (gone). stored with these, each key's last word counting, is upsert()'s state."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    come = incoming.select(*stored.columns).withColumn("gone", F.lit(False))
    if mode == "skip":
        return come.join(stored.select(key), key, "left_anti")
    if mode == "update":
        return come
    # Of rows that go, key and scope are told, so that nothing else of them is read, travels or is written.
    own = [key, *scope]
    stale = stored.select(*own).join(incoming.select(*scope).distinct(), list(scope), "left_semi").join(incoming.select(key), key, "left_anti")
    gone = stale.select(*(F.col(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema))
    return come.unionByName(gone.withColumn("gone", F.lit(True)))


def upsert_counts(stored: DataFrame, incoming: DataFrame, mode: str, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of by: added, updated, skipped. An incoming row counts once, however many stored rows have its key."""
    seen = incoming.join(stored.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").groupBy(*by).agg(F.count_if(F.col("_seen").isNull()).alias("added"), F.count_if(F.col("_seen").isNotNull()).alias("_old"))
    none = F.lit(0).cast("long")
    return seen.select(*by, "added", (none if mode == "skip" else F.col("_old")).alias("updated"), (F.col("_old") if mode == "skip" else none).alias("skipped"))


def with_source(stored: DataFrame, part: str, source: str = "source") -> DataFrame:
    """Stored rows whose source contains part (case counts)."""
    if not part.strip():
        raise ValueError("the source to delete must not be blank")
    return stored.where(F.col(source).contains(part))


def without_source(stored: DataFrame, part: str, source: str = "source") -> DataFrame:
    """Stored rows whose source doesn't contain part (case counts). A blank part would match all and is refused."""
    if not part.strip():
        raise ValueError("the source to delete must not be blank")
    return stored.where(~F.coalesce(F.col(source).contains(part), F.lit(False)))


def facet_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n): all facets from one aggregation over grouping sets; null and empty values count as unknown."""
    named = rows.select(*(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")).alias(n) for n, c in facets.items()))
    sets = named.groupingSets([[F.col(n)] for n in facets], *(F.col(n) for n in facets)).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    bits = {n: (1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)) for i, n in enumerate(facets)}
    which = F.coalesce(*(F.when(F.col("_g") == b, F.lit(n)) for n, b in bits.items()))
    value = F.coalesce(*(F.when(F.col("_g") == b, F.col(n)) for n, b in bits.items()))
    return sets.select(which.alias("facet"), value.alias("value"), "n")
