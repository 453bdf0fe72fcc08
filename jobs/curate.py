"""A curated corpus: documents cleaned, judged and stored by status, so that what an index takes, and why the rest was left out, can be read from the folders.

    python -m jobs.curate --documents hdfs://.../documents --output hdfs://.../curated

Output: documents/status=.../mission=... as Parquet and summary as JSON (documents and words by mission and status). A status is the first
of: no_id, blank (nothing is left after cleaning), short (fewer words than least_words), noise (no words to speak of), duplicate (a smaller id has the same text but for
case and white space), kept. Only kept rows carry their text. Rows of one id with the same cleaned text are one row, with their
number in copies. A run writes everything anew, so running it again leaves the same.

Copies are found by digest: the smallest id of each digest is an aggregation with partial sums, and rows meet it by (digest, id), so
thousands of copies of one text are spread over all tasks. Texts are shuffled once, by that key.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as X

log = logging.getLogger("jobs.curate")
#: Five words; a text that has them isn't noise, and needs no counting.
FIVE_WORDS = "(?s)(?:[A-Za-z]{2,}[^A-Za-z].*?){4}[A-Za-z]{2,}"
ROWS = "doc_id long, source string, n_words int, copies long, digest string, document string, status string, mission string"


def judged(docs: DataFrame, facet: str = "lang", least_words: int = 5) -> DataFrame:
    """docs(doc_id, text, source, facet) with the columns of ROWS."""
    mission = F.coalesce(F.nullif(F.col(facet), F.lit("")), F.lit("unknown"))
    cleaned = docs.select("doc_id", mission.alias("mission"), "source", F.coalesce(X.clean_text("text"), F.lit("")).alias("document"))
    # The key's digest as 32 bytes; it is told in hexadecimal digits.
    keyed = cleaned.withColumn("key", F.unhex(F.sha2(F.lower("document"), 256)))
    one = keyed.groupBy("key", "doc_id").agg(F.min(F.struct("mission", "source", "document")).alias("d"), F.count("*").alias("copies"))
    first = keyed.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = one.join(first, ["key", "doc_id"], "left").select("key", "doc_id", "copies", "first", "d.*")
    n = F.when(F.col("document") == "", 0).otherwise(F.size(F.split("document", " ")))
    status = (
        F.when(F.col("doc_id").isNull(), "no_id")
        .when(F.col("document") == "", "blank")
        .when(n < least_words, "short")
        .when(F.when(F.col("document").rlike(FIVE_WORDS), False).otherwise(X.low_information("document")), "noise")
        .when(F.col("first").isNull(), "duplicate")
        .otherwise("kept")
    )
    told = met.select("doc_id", "source", n.alias("n_words"), "copies", F.lower(F.hex("key")).alias("digest"), "document", status.alias("status"), "mission")
    return told.withColumn("document", F.when(F.col("status") == "kept", F.col("document")))


def curate(spark: SparkSession, documents: str, output: str, facet: str = "lang", least_words: int = 5) -> dict[str, int]:
    """Writes output/documents and output/summary; returns the number of rows of each status."""
    if least_words < 0:
        raise ValueError("least_words must not be negative")
    judged(spark.read.parquet(documents), facet, least_words).write.mode("overwrite").partitionBy("status", "mission").parquet(f"{output}/documents")
    written = spark.read.schema(ROWS).parquet(f"{output}/documents")
    summary = written.groupBy("mission", "status").agg(F.count("*").alias("documents"), F.sum("copies").alias("rows"), F.sum("n_words").alias("words"))
    summary.coalesce(1).write.mode("overwrite").json(f"{output}/summary")
    told = {r["status"]: (r["documents"], r["rows"]) for r in spark.read.json(f"{output}/summary").groupBy("status").agg(F.sum("documents").alias("documents"), F.sum("rows").alias("rows")).collect()} if not written.isEmpty() else {}
    log.info("read %d rows of %s", sum(n for _, n in told.values()), documents)
    for status, (n, _) in sorted(told.items()):
        log.info("wrote %d documents with status %s to %s/documents", n, status, output)
    return {k: n for k, (n, _) in told.items()}


def main(argv: list[str] | None = None) -> int:
    from .config import log_to_stderr, settings

    values = settings("curate", "Documents cleaned, judged and stored by status.", argv)
    log_to_stderr()
    spark = SparkSession.builder.appName("curate").getOrCreate()
    try:
        curate(spark, **values)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
