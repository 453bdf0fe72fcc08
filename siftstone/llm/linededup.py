"""Cross-site boilerplate lines, in DataFrame operations only.

Each line's hash gathers a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation, so a line that is
everywhere costs one small sketch a task. Lines whose estimate is clearly above SITES are boilerplate, those clearly below are not,
and those within MARGIN of it, and only those, get exact distinct counts. Boilerplate lines are removed from every document.

Texts stay where they are: while at most TABLE_LINES lines are looked up, which is counted first, they travel as a hash table (an array of
buckets) that an expression beside the row reads. Beyond, lines meet them by a join on the line's hash, and documents their
removed lines by a join on the row.

Lines are the parts between line feeds; blank lines (spaces, tabs and returns only) are never removed. A null text has no lines
and stays null; a null site counts as no site, but its lines are removed too; long texts are read as a whole; repeated rows are
treated alike; an empty table gives an empty table; other columns pass through, whatever their names, but for n_lines and
n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, plain_name

#: Distinct sites from which a line is boilerplate; log2 of the sketch's buckets; the relative half width of what is counted exactly.
SITES, LG_K, MARGIN = 5, 11, 0.25
#: Lines that travel as a table: 8 bytes each and 24 for a bucket; hashes of a bucket on average.
TABLE_LINES, BUCKET = 500_000, 4
FEED = "\n"


def line_hash(line: Column) -> Column:
    """64 bits of the line, null for blank lines. Trimming reads no further than the first character that isn't blank."""
    return F.when(F.ltrim(line, F.lit(" \t\r")) != "", F.xxhash64(line))


def lines(docs: DataFrame, *keep: Column) -> DataFrame:
    """_hash and the keep columns for each line of text that is not blank."""
    parts = docs.select(*keep, F.posexplode(F.split("text", FEED)).alias("_pos", "_line"))
    return parts.withColumn("_hash", line_hash(F.col("_line"))).drop("_line").where("_hash is not null")


def hash_table(hashes: DataFrame, buckets: int) -> DataFrame:
    """One row with _table: the values of hashes(_hash), which are few, dealt into buckets, as an array of arrays."""
    filled = hashes.groupBy(F.pmod("_hash", F.lit(buckets)).alias("_b")).agg(F.collect_set("_hash").alias("_in"))
    every = hashes.sparkSession.range(buckets).select(F.col("id").alias("_i"))
    placed = every.join(filled, F.col("_i") == F.col("_b"), "left").select("_i", F.coalesce("_in", F.array().cast("array<bigint>")).alias("_in"))
    return checkpoint(placed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_in"))), lambda x: x["_in"]).alias("_table")))


def buckets_of(n: int) -> int:
    return max(1, n // BUCKET)


def held(table: Column, n: int, h: Column) -> Column:
    """Whether a table of n hashes has h; false for null."""
    return F.coalesce(F.array_contains(F.element_at(table, (F.pmod(h, F.lit(buckets_of(n))) + 1).cast("int")), h), F.lit(False))


def spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES, lg_k: int = LG_K, margin: float = MARGIN, most: int = TABLE_LINES) -> DataFrame:
    """(_hash): lines on at least that many distinct sites."""
    found = lines(docs, F.col(plain_name(site)).alias("_site")).where("_site is not null")
    sketched = found.groupBy("_hash").agg(F.count("*").alias("_n"), F.hll_sketch_agg("_site", F.lit(lg_k)).alias("_sketch"))
    # A line is on no more sites than it has occurrences.
    spread = checkpoint(sketched.where(F.col("_n") >= sites).select("_hash", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= sites * (1 - margin)))
    near = spread.where(F.col("_sites") <= sites * (1 + margin)).select("_hash")
    # Each (line, site) is one row before anything is dealt by line: a line that is everywhere on one site is no hot key.
    by_site = lambda rows: rows.groupBy("_hash", "_site").agg(F.count("*").alias("_n"))
    n = near.count()
    if not n:
        return spread.select("_hash")
    if n <= most:
        pairs = by_site(found.where(held(hash_table(near, buckets_of(n)).scalar(), n, F.col("_hash"))))
    else:
        pairs = by_site(found).join(near, "_hash", "left_semi")
    exact = pairs.groupBy("_hash").agg(F.count("*").alias("_sites"))
    return checkpoint(spread.where(F.col("_sites") > sites * (1 + margin)).select("_hash").union(exact.where(F.col("_sites") >= sites).select("_hash")))


def row_key() -> Column:
    """Tells documents apart by id and hash of the text; a document that is repeated is one."""
    return F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("text"))


def removed_lines(docs: DataFrame, spread: DataFrame) -> DataFrame:
    """(_row, _gone): for each document that holds such lines, their numbers from 0."""
    return lines(docs, row_key().alias("_row")).join(spread, "_hash", "left_semi").groupBy("_row").agg(F.collect_set("_pos").alias("_gone"))


def drop_spread_lines(docs: DataFrame, site: str = "source", sites: int = SITES, most: int = TABLE_LINES) -> DataFrame:
    """docs, all columns, with text less its boilerplate lines, and n_lines and n_removed. most: lines that travel as a table."""
    spread = spread_lines(docs, site, sites, most=most)
    parts, whole = F.split("text", FEED), F.struct(*map(plain_name, docs.columns)).alias("_d")
    n = spread.count()
    if not n:
        told = docs.select(whole, parts.alias("_kept"))
    elif n <= most:
        # A lambda can't hold a subquery as it is written; the optimizer puts this column into it.
        tabled = docs.select(whole, hash_table(spread, buckets_of(n)).scalar().alias("_table"))
        told = tabled.select("_d", F.filter(F.split("_d.text", FEED), lambda x: ~held(F.col("_table"), n, line_hash(x))).alias("_kept"))
    else:
        met = docs.select(whole, row_key().alias("_key")).join(removed_lines(docs, spread), F.col("_key") == F.col("_row"), "left")
        parts = F.split("_d.text", FEED)
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
        told = met.select("_d", F.when(F.col("_gone").isNull(), parts).otherwise(F.transform(stay, lambda i: F.element_at(parts, i + 1))).alias("_kept"))
    all_lines = F.when(F.col("_d.text").isNull(), 0).otherwise(F.size(F.split("_d.text", FEED)))
    counts = {"n_lines": all_lines, "n_removed": all_lines - F.when(F.col("_d.text").isNull(), 0).otherwise(F.size("_kept"))}
    rest = [F.col("_d")[c].alias(c) for c in docs.columns if c not in ("text", *counts)]
    return told.select(*rest, F.array_join("_kept", FEED).alias("text"), *(v.cast("long").alias(k) for k, v in counts.items()))


def line_digest(docs: DataFrame) -> DataFrame:
    out = drop_spread_lines(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


LINE_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS k, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM (SELECT DISTINCT doc_id, source, text FROM documents)),
told AS (SELECT * FROM parts WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''),
spread AS (SELECT line FROM told WHERE source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
kept AS (
  SELECT doc_id, k, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest
  FROM (SELECT DISTINCT p.doc_id, p.k, p.pos, p.line,
               (s.line IS NOT NULL AND trim(translate(p.line, chr(9) || chr(13), '  ')) <> '') AS gone
        FROM parts p LEFT JOIN spread s ON p.line = s.line)
  GROUP BY doc_id, k)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(rest, '')) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(coalesce(d.text, '')) = k.k
"""
