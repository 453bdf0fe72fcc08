"""The transcript parsers, over files that are built from conversations: every form that a time stamp, a speaker or a header takes, and furniture between them.

What SQL says of a file follows from how its turns were written, not from reading it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transcripts
from .base import collapse, table

_DIGITS = "lpad(concat('', {}), 2, '0')"
_DAY, _HOUR, _MINUTE, _SECOND = (_DIGITS.format(x) for x in ("conv_id % 100", "conv_id % 30", "turn * 7 % 64", "conv_id % 60"))
_TIME = f"concat({_DAY}, ' ', {_HOUR}, ' ', {_MINUTE}, ' ', {_SECOND})"
_PAGE = "CASE WHEN turn % 3 = 0 THEN concat('--- PAGE ', CAST((turn - turn % 3) / 3 AS INT) + 1, ' ---', chr(10)) ELSE '' END"
_FORM = "(conv_id + 3 * turn) % 8"
#: What stands before a turn's words; read by both engines.
TIMED = f"""concat({_PAGE}, CASE {_FORM}
WHEN 0 THEN concat({_TIME}, ' CDR', chr(10))
WHEN 1 THEN concat({_TIME}, chr(10), 'TMP', chr(10))
WHEN 2 THEN concat({_TIME}, 'CDR Roger ')
WHEN 3 THEN concat(replace({_TIME}, ' ', chr(10)), chr(10), 'CC', chr(10))
WHEN 4 THEN concat('0A ', {_HOUR}, ' ', {_MINUTE}, ' ', {_SECOND}, chr(10), 'CAP COM', chr(10))
WHEN 5 THEN concat('LMP', chr(10))
WHEN 6 THEN concat(chr(10), 'Tape 12/3', chr(10), {_TIME}, chr(10), 'CMP', chr(10))
ELSE concat({_TIME}, ' CDR (EAGLE)', chr(10), 'UNCLASSIFIED', chr(10)) END)"""
_KIND = "(conv_id + turn) % 6"
#: In the last form a header follows a speaker whom no line follows: the header gives the floor back, and the start stays.
TOLD = f"""CASE {_KIND}
WHEN 0 THEN chr(10)
WHEN 1 THEN concat(turn + 1, '/16/69', chr(10))
WHEN 2 THEN concat('APOLLO 11 MISSION COMMENTARY ', turn, chr(10))
WHEN 3 THEN concat('CAP COM', chr(10), 'Page 7', chr(10))
WHEN 5 THEN concat('CAP COM', chr(10), 'MC ', turn, chr(10))
ELSE concat(chr(10), 'CAPCOM: ') END"""
_KEPT = ("collection", "mission", "source", "source_type", "source_file", "source_path", "doc_id", "doc_number", "transcript_format", "utterance_index", "speaker", "speaker_label_status")


def spoken(spark, sf_dir, head: str, name: str):
    """(path, value): a file for each conversation, its turns in order, each behind its head."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.expr(head), "text").alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x.t)
    return turns.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("value")).select(F.concat(F.lit("/data/folder/"), F.col("conv_id").cast("string"), F.lit(f"-STS-51L_{name}.txt")).alias("path"), "value")


def timed(spark, sf_dir):
    m = transcripts.transcript_records(spoken(spark, sf_dir, TIMED, "loop")).select("id", "document", "metadata.*")
    return m.select("id", *_KEPT, "timestamp", "timestamp_sec", "timestamp_valid", "source_line_start", "source_line_end", "page_start", "page_end", F.md5("document").alias("document_md5"))


def commentary(spark, sf_dir):
    m = transcripts.transcript_records(spoken(spark, sf_dir, TOLD, "pao")).select("id", "document", "metadata.*")
    return m.select("id", *_KEPT, "segment_marker", "calendar_date", "source_line_start", "source_line_end", F.md5("document").alias("document_md5"))


def detected(spark, sf_dir):
    """The parser that each file would be read by, as an expression, and by its whole text."""
    files = spoken(spark, sf_dir, TIMED, "loop").unionByName(spoken(spark, sf_dir, TOLD, "a")).unionByName(spoken(spark, sf_dir, "''", "PAO_x")).unionByName(spoken(spark, sf_dir, "concat('[0:0', turn, '] spk_1: ')", "b"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    return files.select(name.alias("name"), transcripts.parser_of(F.col("value"), name).alias("parser"))


def _file(name: str) -> str:
    return f"conv_id || '-STS-51L_{name}'"


def _lines(head: str) -> str:
    """Of each turn: its head's text, the lines before it, and the lines of its head."""
    return f"""h AS (SELECT *, {head} AS head FROM conversations),
    n AS (SELECT *, len(string_split(head || text, chr(10))) AS total, len(string_split(head, chr(10))) - 1 AS own FROM h),
    b AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS i FROM n)"""


def _common(name: str, kind: str) -> str:
    key = f"{_file(name)} || '_utt_' || lpad(i::VARCHAR, 6, '0')"
    return f"""{key} AS id, 'folder' AS collection, 'STS-51L' AS mission, {key} AS source, 'transcript' AS source_type, {_file(name)} || '.txt' AS source_file, '/data/folder/' || {_file(name)} || '.txt' AS source_path, {_file(name)} AS doc_id,
    conv_id::VARCHAR AS doc_number, '{kind}' AS transcript_format, i AS utterance_index"""


_JOIN = r"regexp_replace({}, '([A-Za-z]+)-\s*\n\s*([a-z]+)', '\1\2', 'g')"
_VALID = f"{_FORM} <> 4 AND conv_id % 30 < 24 AND turn * 7 % 64 < 60"
_SECONDS = "((conv_id % 100 * 24 + conv_id % 30) * 60 + turn * 7 % 64) * 60 + conv_id % 60"

QUERIES = {
    "timed_transcripts": (
        timed,
        f"""WITH {_lines(TIMED)},
        t AS (SELECT *, CASE {_FORM} WHEN 5 THEN NULL WHEN 4 THEN '0A ' || {_HOUR} || ' ' || {_MINUTE} || ' ' || {_SECOND} ELSE {_TIME} END AS own_time, (turn % 3 = 0)::INT AS marks, CASE WHEN {_VALID} THEN {_SECONDS} ELSE -1 END AS own_sec FROM b),
        f AS (SELECT *, last_value(own_time IGNORE NULLS) OVER w AS time, last_value(CASE WHEN own_time IS NOT NULL THEN own_sec END IGNORE NULLS) OVER w AS sec FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT {_common('loop', 'apollo_block')}, ['CDR', 'TMP', 'CDR', 'CC', 'CAPCOM', 'LMP', 'CMP', 'CDR (EAGLE)'][{_FORM} + 1] AS speaker, CASE {_FORM} WHEN 1 THEN 'ocr_alias' ELSE 'recognized' END AS speaker_label_status,
        time AS timestamp, nullif(sec, -1)::BIGINT AS timestamp_sec, CASE WHEN time IS NOT NULL THEN sec <> -1 END AS timestamp_valid, (before + marks + CASE {_FORM} WHEN 6 THEN 3 ELSE 1 END)::BIGINT AS source_line_start, (before + total)::BIGINT AS source_line_end,
        (turn // 3 + 1)::BIGINT AS page_start, (turn // 3 + 1)::BIGINT AS page_end, md5({collapse(_JOIN.format(f"CASE {_FORM} WHEN 2 THEN 'Roger ' ELSE '' END || text"))}) AS document_md5 FROM f""",
    ),
    "commentary_transcripts": (
        commentary,
        f"""WITH {_lines(TOLD)},
        f AS (SELECT *, coalesce(last_value(CASE {_KIND} WHEN 2 THEN 'PAO' WHEN 3 THEN 'CAPCOM' WHEN 4 THEN 'CAPCOM' WHEN 5 THEN 'PAO' END IGNORE NULLS) OVER w, 'PAO') AS who,
        last_value(CASE {_KIND} WHEN 2 THEN 'APOLLO 11 MISSION COMMENTARY ' || turn WHEN 5 THEN 'MC ' || turn END IGNORE NULLS) OVER w AS segment, last_value(CASE {_KIND} WHEN 1 THEN (turn + 1) || '/16/69' END IGNORE NULLS) OVER w AS date
        FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT {_common('pao', 'pao_commentary')}, who AS speaker, NULL::VARCHAR AS speaker_label_status, segment AS segment_marker, date AS calendar_date, (before + CASE WHEN {_KIND} IN (3, 5) THEN 1 ELSE own + 1 END)::BIGINT AS source_line_start, (before + total)::BIGINT AS source_line_end,
        md5({collapse(_JOIN.format('text'))}) AS document_md5 FROM f""",
    ),
    "parser_detection": (
        detected,
        f"""WITH c AS (SELECT conv_id, bool_or({_KIND} = 2 AND before < 4900) AS told FROM (SELECT *, coalesce(sum(length({TOLD} || text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) GROUP BY conv_id)
        SELECT {_file('loop')} || '.txt' AS name, 'apollo' AS parser FROM c UNION ALL SELECT {_file('a')} || '.txt', CASE WHEN told THEN 'pao' ELSE 'apollo' END FROM c UNION ALL SELECT {_file('PAO_x')} || '.txt', 'pao' FROM c UNION ALL SELECT {_file('b')} || '.txt', 'challenger' FROM c""",
    ),
}
