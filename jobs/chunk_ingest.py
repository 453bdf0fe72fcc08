"""Incremental ingest: documents that have come since the last run become overlapping chunks with stable ids, ready to be embedded.

    python -m jobs.chunk_ingest --documents hdfs://.../documents --output hdfs://.../chunks --checkpoint hdfs://.../mark

A file stream over a folder of Parquet files takes the files that its checkpoint doesn't know and ends. A document whose id is already
stored is skipped, so cost follows the new files, and ids stay as they were. Of rows of one id in a batch the one with the least digest counts;
rows without an id or with a blank text make no chunks. Each batch writes partitions of its own, batch=n/mission=..., which a batch that is
run again after a failure overwrites, and skips by earlier batches alone: any number of runs and restarts leave the same output.

Texts are shuffled once, by id, for the skip. Output and checkpoint belong together: with a new checkpoint take a new output.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.text import slug, stem, strip
from siftstone.operators import chunks

log = logging.getLogger("jobs.chunk_ingest")
CHUNKS = "doc_id long, id string, source string, chunk_index int, total_chunks int, token_count int, document string, batch long, mission string"


def stored(spark: SparkSession, output: str) -> DataFrame | None:
    """The chunks so far; None before the first batch. Types are given, so that no partition's value is taken for a number."""
    try:
        return spark.read.schema(CHUNKS).parquet(output)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def one_for_each_id(rows: DataFrame, facet: str) -> DataFrame:
    """(doc_id, mission, source, text): rows that can be chunked, one for each id. A task's rows of one id are one before they travel."""
    kept = rows.where(F.col("doc_id").isNotNull() & (strip("text") != ""))
    mission = F.coalesce(F.nullif(F.col(facet), F.lit("")), F.lit("unknown"))
    digest = F.sha2(F.concat_ws("\x01", mission, "source", "text"), 256)
    least = F.min(F.struct(digest.alias("digest"), mission.alias("mission"), "source", "text"))
    return kept.groupBy("doc_id").agg(least.alias("d")).select("doc_id", "d.mission", "d.source", "d.text")


def chunks_of(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks with the ids mission::source_id::chunk_0000; the document's id, its sign spelled out, is all that tells those of a source apart."""
    made = chunks.stride_chunks(rows, "text", size, overlap)
    number = F.replace(F.col("doc_id").cast("string"), F.lit("-"), F.lit("minus_"))
    name = F.concat_ws("_", slug(stem("source")), number)
    return made.select("doc_id", chunks.chunk_id("mission", name, "chunk_index").alias("id"), "source", "chunk_index", "total_chunks", "token_count", F.col("chunk").alias("document"), "mission")


def ingest(spark: SparkSession, documents: str, output: str, checkpoint: str, facet: str = "lang", size: int = chunks.SIZE, overlap: int = chunks.OVERLAP, files_per_batch: int = 1000) -> dict[str, int]:
    """Takes what is new in documents, waits for the end, and tells how many batches and rows were read, and how many documents and chunks were written."""
    chunks.check_sizes(size, overlap)
    told = {"batches": 0, "rows_read": 0, "documents": 0, "chunks": 0}

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh, held = one_for_each_id(batch, facet), stored(session, output)
        if held is not None:
            last = held.agg(F.max("batch")).first()[0]  # of partition values alone
            if last is not None and last > number:
                raise ValueError(f"{output} has batch {last}, beyond this checkpoint's {number}: they don't belong together")
            seen = held.where((F.col("batch") < number) & (F.col("chunk_index") == 0)).select("doc_id")
            fresh = fresh.join(seen, "doc_id", "left_anti")
        made = chunks_of(fresh, size, overlap).withColumn("batch", F.lit(number).cast("long"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "mission").parquet(output)
        own = session.read.schema(CHUNKS).parquet(output).where(F.col("batch") == number).agg(F.count_if(F.col("chunk_index") == 0), F.count("*")).first()
        counts = {"batches": 1, "rows_read": batch.count(), "documents": own[0], "chunks": own[1]}
        log.info("batch %d: read %d rows of %s, wrote %d chunks of %d documents to %s", number, counts["rows_read"], documents, own[1], own[0], output)
        for k, v in counts.items():
            told[k] += v

    folder, _, name = documents.rstrip("/").rpartition("/")
    if not folder:
        raise ValueError("documents must be a whole path")
    schema = spark.read.parquet(documents).schema
    # A stream takes one file by a pattern only.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{{{name}}}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%d batches, %d rows read, %d chunks of %d documents written", told["batches"], told["rows_read"], told["chunks"], told["documents"])
    return told


def main(argv: list[str] | None = None) -> int:
    from .config import log_to_stderr, settings

    values = settings("chunk_ingest", "Chunks of documents that have come since the last run.", argv)
    log_to_stderr()
    spark = SparkSession.builder.appName("chunk_ingest").getOrCreate()
    try:
        ingest(spark, **values)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
