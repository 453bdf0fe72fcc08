"""What goes through files: corpus trees, question sets and collections, written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import files, store
from .base import table

#: Each language's mission, as a folder and as rows spell it; other languages have none.
FOLDERS = {"en": "apollo11", "fr": "apollo13", "de": "challenger"}
SPELLED = {"en": "Apollo 11", "fr": "apollo_13", "de": "STS-51L"}


def _fresh(spark, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _by_language(names: dict[str, str], other: str):
    return F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in names.items()), F.lit(other))


def corpus_tree(spark, sf_dir):
    """A tree of text files, one for each language and source, scanned as whole files with what their paths tell."""
    at = _fresh(spark, "corpus")
    rows = table(spark, sf_dir, "documents").withColumn("folder", _by_language(FOLDERS, "other"))
    for folder in (*FOLDERS.values(), "other"):  # the corpus has a folder for each mission
        own = rows.where(F.col("folder") == folder).repartition("source").sortWithinPartitions("source", "doc_id")
        own.select("source", F.concat("doc_id", F.lit(" "), F.md5("text")).alias("value")).write.partitionBy("source").text(f"{at}/{folder}")
    found = files.path_metadata(files.corpus_files(spark, at))
    return found.select("mission", "path_mission", "data_type", F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), F.col("file_size").cast("long").alias("file_size"), F.md5("value").alias("value_md5"))


def question_set(spark, sf_dir):
    """The benchmark as a JSON question set, checked and read again."""
    at = _fresh(spark, "questions")
    own = F.struct(F.concat(F.lit("q"), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("id"), F.lit("all").alias("mission"), F.lit("facts").alias("category"), F.col("text").alias("user_input"), F.md5("text").alias("reference"))
    table(spark, sf_dir, "benchmark").agg(F.array_sort(F.collect_list(own)).alias("questions")).write.json(at)
    return files.questions(spark, at).select("id", F.col("position").cast("long").alias("position"), "mission", "category", F.md5("user_input").alias("input_md5"), "reference")


def _chunks(spark, sf_dir, where: str, document):
    """A chunk for each document; a source in a language is a file, and those of languages without a mission can't be stored."""
    d = table(spark, sf_dir, "documents").where(where)
    path = F.concat(F.lit("/x/"), "lang", F.lit("/"), "source", F.lit(".txt"))
    return d.select(document.alias("document"), _by_language(SPELLED, "Gemini 4").alias("mission"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"), path.alias("source_path"), F.lit("report").alias("source_type"), F.lit(0).alias("chunk_index"))


def _ingested(spark, sf_dir):
    at = _fresh(spark, "collections")
    made = store.Collection(spark, at, "docs")
    told = [store.ingest(made, _chunks(spark, sf_dir, *side), mode, lambda d: d) for side, mode in ((("doc_id % 2 = 0 OR doc_id % 3 = 0", F.col("text")), "skip"), (("doc_id % 2 = 1 OR doc_id % 5 = 0", F.concat(F.lit("new "), "text")), "replace"))]
    made.vacuum()
    assert list(store.discover(spark, at)) == ["docs"]
    return store.Collection(spark, at, "docs", create=False), told


def collection_rows(spark, sf_dir):
    """The collection after two ingests, the second in replace mode, opened again."""
    held, _ = _ingested(spark, sf_dir)
    by_file = Window.partitionBy("mission", "filepath")
    return held.rows().select("id", "mission", "source", "filepath", "source_type", F.md5("document").alias("document_md5"), F.count("*").over(by_file).alias("in_file"))


def ingest_reports(spark, sf_dir):
    """What the two ingests say of each mission, and of files that can't be stored."""
    _, told = _ingested(spark, sf_dir)
    rows = [(k, m, *(own[c] for c in ("files", "chunks", "added", "updated", "skipped")), "") for k, t in enumerate(told) for m, own in t["missions"].items()]
    rows += [(k, path, 0, 0, 0, 0, 0, why) for k, t in enumerate(told) for path, why in t["failures"]]  # a line for each mission and broken file
    return spark.createDataFrame(rows, "run long, what string, files long, chunks long, added long, updated long, skipped long, why string")


_KEY = "CASE lang WHEN 'en' THEN 'apollo11' WHEN 'fr' THEN 'apollo13' WHEN 'de' THEN 'challenger' END"
_SIDES = f"""WITH d AS (SELECT *, {_KEY} AS mission, '/x/' || lang || '/' || source || '.txt' AS filepath, {_KEY} || '::doc_' || doc_id || '::chunk_0000' AS id FROM documents),
s AS (SELECT id, mission, doc_id, filepath, text AS document FROM d WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND mission IS NOT NULL), i AS (SELECT id, mission, doc_id, filepath, 'new ' || text AS document FROM d WHERE (doc_id % 2 = 1 OR doc_id % 5 = 0) AND mission IS NOT NULL),
n AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM i) AND NOT EXISTS (SELECT 1 FROM i WHERE i.mission = s.mission AND i.filepath = s.filepath) UNION ALL SELECT * FROM i)"""

QUERIES = {
    "corpus_tree": (
        corpus_tree,
        f"""SELECT mission, replace(mission, 'apollo', 'apollo_') AS path_mission, 'document' AS data_type, source, length(v)::BIGINT AS file_size, md5(v) AS value_md5
        FROM (SELECT {_KEY} AS mission, source, string_agg(doc_id || ' ' || md5(text) || chr(10), '' ORDER BY doc_id) AS v FROM documents WHERE {_KEY} IS NOT NULL GROUP BY ALL)""",
    ),
    "question_set": (question_set, "SELECT 'q' || lpad(item_id::VARCHAR, 9, '0') AS id, row_number() OVER (ORDER BY item_id) - 1 AS position, 'all' AS mission, 'facts' AS category, md5(text) AS input_md5, md5(text) AS reference FROM benchmark"),
    "collection_rows": (
        collection_rows,
        _SIDES + " SELECT id, mission, 'Doc ' || doc_id || '.txt' AS source, filepath, 'report' AS source_type, md5(document) AS document_md5, count(*) OVER (PARTITION BY mission, filepath) AS in_file FROM n",
    ),
    "ingest_reports": (
        ingest_reports,
        _SIDES
        + """, bad AS (SELECT 0 AS run, filepath, count(*) AS n FROM d WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND mission IS NULL GROUP BY filepath UNION ALL SELECT 1, filepath, count(*) FROM d WHERE (doc_id % 2 = 1 OR doc_id % 5 = 0) AND mission IS NULL GROUP BY filepath)
        SELECT 0::BIGINT AS run, mission AS what, count(DISTINCT filepath) AS files, count(*) AS chunks, count(*) AS added, 0::BIGINT AS updated, 0::BIGINT AS skipped, '' AS why FROM s GROUP BY mission
        UNION ALL SELECT 1, mission, count(DISTINCT filepath), count(*), count(*) FILTER (WHERE id NOT IN (SELECT id FROM s)), count(*) FILTER (WHERE id IN (SELECT id FROM s)), 0, '' FROM i GROUP BY mission
        UNION ALL SELECT run, filepath, 0, 0, 0, 0, 0, 'ValueError: rows that can''t be stored: mission: ' || n || ', id: ' || n FROM bad""",
    ),
}
