"""Whole-file text scans, the corpus catalog and JSON question sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import reports, transcripts


def whole_files(spark: SparkSession, path: str | list[str], pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(path, file_name, file_size, value): one row for each UTF-8 file. Lines keep their order, as no file is split."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), "value")


def in_memory(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """The same table from texts by name; blank texts are refused."""
    blank = [n for n, t in texts.items() if not (t or "").strip()]
    if blank:
        raise ValueError(f"blank text: {blank}")
    rows = [(f"memory://{n}", n, len(t.encode()), t) for n, t in texts.items()]
    return spark.createDataFrame(rows, "path string, file_name string, file_size long, value string")


def one_source(spark: SparkSession, path: str | None = None, raw_text: str | None = None, name: str = "raw_text", pattern: str = "*.txt") -> DataFrame:
    """Either files or a text, and just one of them; blank counts as missing."""
    path, raw_text = path if (path or "").strip() else None, raw_text if (raw_text or "").strip() else None
    if (path is None) == (raw_text is None):
        raise ValueError("give either raw_text or a path, and only one of them")
    return whole_files(spark, path, pattern) if path else in_memory(spark, {name: raw_text})


def corpus_files(spark: SparkSession, base: str, missions: tuple[str, ...] = tuple(X.MISSIONS)) -> DataFrame:
    """All text files below the missions' folders but summaries, with the folder as mission. Hidden files are left out by the reader."""
    found = whole_files(spark, base, "*.txt", recursive=True)
    folder = F.regexp_extract("path", rf"/({'|'.join(missions)})/(?:[^/]*/)*[^/]*$", 1)
    return found.withColumn("mission", folder).where("mission <> ''").where(~F.lower("file_name").contains("summary"))


def path_metadata(files: DataFrame) -> DataFrame:
    """Adds mission, data_type, document_category and file stem, all told by the path."""
    low = F.lower("path")
    return files.select(
        "*",
        X.first_match(low, X.MISSION_PATHS, "unknown").alias("path_mission"),
        X.first_match(low, X.TYPE_PATHS, "document").alias("data_type"),
        X.first_match(F.regexp_extract(low, "([^/]*)$", 1), X.CATEGORY_NAMES, "general_document").alias("document_category"),
        X.stem("path").alias("file_stem"),
    )


# The corpus, one line for each source: file or pattern, kind, and how to read it.
FORM_WORDS = ("FIG", "FIGURE", "TABLE", "FORMS", "FROMS", "FORM", "LIST", "NOTES", "BURN CHART", "DATA CARD", "UPDATE PAD", "THIS PAGE INTENTIONALLY LEFT BLANK")
CATALOG = (
    ("apollo11/NASA_NTRS_Archive_19710015566_textract_full_text.txt", reports.Options(13, "REFERENCES", "Apollo 11", "apollo11", "mission_report")),
    ("apollo11/Apollo_11_Flight_Plan_HSK_textract_full_text.txt", reports.Options(20, None, "Apollo 11", "apollo11", "flight_plan", FORM_WORDS)),
    ("apollo11/19900066485_textract_full_text.txt", reports.Options(29, "DISTRIBUTION:", "Apollo 11", "apollo11", "saturn_v_flight_evaluation")),
    ("challenger/*Mission_Audio_transcript.txt", transcripts.Options("challenger", mission="STS-51L", collection="challenger")),
    ("apollo11/a11transcript_pao_textract_full_text.txt", transcripts.Options("pao", start_page=9, mission="Apollo 11", collection="apollo11")),
    ("apollo11/a11transcript_tec_textract_full_text.txt", transcripts.Options("apollo", start_page=11, mission="Apollo 11", collection="apollo11")),
    ("apollo11/a11transscript_cm_textract_full_text.txt", transcripts.Options("apollo", start_page=11, mission="Apollo 11", collection="apollo11")),
    ("apollo13/AS13_PAO_textract_full_text.txt", transcripts.Options("pao", start_page=1, mission="Apollo 13", collection="apollo13")),
    ("apollo13/AS13_TEC_textract_full_text.txt", transcripts.Options("apollo", start_page=8, mission="Apollo 13", collection="apollo13")),
    ("apollo13/AS13_CM_textract_full_text.txt", transcripts.Options("apollo", start_page=4, mission="Apollo 13", collection="apollo13")),
)


def catalog_records(spark: SparkSession, base: str, catalog=CATALOG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of the catalog's reports, transcripts, and of both (metadata fields of either kind are null in the other)."""
    by_kind: dict[type, list[DataFrame]] = {reports.Options: [], transcripts.Options: []}
    for at, options in catalog:
        folder, _, pattern = at.rpartition("/")
        files = whole_files(spark, f"{base}/{folder}", pattern)
        read = reports.report_records if isinstance(options, reports.Options) else transcripts.transcript_records
        by_kind[type(options)].append(read(files, replace(options)))
    union = lambda frames: union_records(frames)
    r, t = union(by_kind[reports.Options]), union(by_kind[transcripts.Options])
    return r, t, union([r, t])


def union_records(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name, metadata fields too; what a frame lacks is null."""
    flat = [f.select("id", "document", "metadata.*") for f in frames]
    out = flat[0]
    for f in flat[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select("id", "document", F.struct(*(c for c in out.columns if c not in ("id", "document"))).alias("metadata"))


def flattened(records: DataFrame) -> DataFrame:
    return records.select("id", "document", "metadata.*")


QUESTION_FIELDS = ("id", "mission", "category", "user_input", "reference")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object with a list of questions, each with five filled text fields; other fields are kept. Anything else is a ValueError."""
    raw = spark.read.json(path, multiLine=True)
    if "questions" not in raw.columns or not isinstance(raw.schema["questions"].dataType, T.ArrayType) or not isinstance(raw.schema["questions"].dataType.elementType, T.StructType):
        raise ValueError("the root must be an object with a list of question objects")
    rows = raw.select(F.posexplode("questions").alias("position", "q")).select("position", "q.*")
    absent = [f for f in QUESTION_FIELDS if f not in rows.columns or not isinstance(rows.schema[f].dataType, T.StringType)]
    if absent:
        raise ValueError(f"missing text fields: {absent}")
    bad = rows.agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(X.strip(f), F.lit("")) == "").alias(f) for f in QUESTION_FIELDS), F.count_distinct("id").alias("ids")).first()
    if not bad["n"] or any(bad[f] for f in QUESTION_FIELDS) or bad["ids"] != bad["n"]:
        raise ValueError(f"empty set, blank fields or repeated ids: {bad.asDict()}")
    return rows
