"""Helpers for queries and for the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL text in DuckDB's dialect (RE2 patterns).


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def per(a: str, b: str) -> str:
    """a / b, 0 where b is 0."""
    return f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0.0)"


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents"

ALPHA, DIGIT, LOWER, PUNCT = r"\p{L}", r"\p{Nd}", r"\p{Ll}", r"[^\p{L}\p{N}\s]"
WORD = r"[A-Za-z][A-Za-z''-]*"


def prose(s: str) -> str:
    return f"(length({s}) >= 32 AND {n_of(s, WORD)} >= 6 AND {n_of(s, LOWER)} >= 10 AND {per(n_of(s, ALPHA), n_of(s, chr(92) + 'S'))} >= 0.5)"


def visual(s: str) -> str:
    """Of a stripped line; the tables hold no captions, but the rule does."""
    alpha, digit, punct, long = n_of(s, ALPHA), n_of(s, DIGIT), n_of(s, PUNCT), n_of(s, "[A-Za-z]{2,}")
    figure = r"(?i)^\s*(?:FIG|FIGURE)\.?\s+[A-Z0-9]+(?:[-.][A-Z0-9]+)*\b"
    tab = r"(?i)^\s*TABLE\s+[A-Z0-9]+(?:[-.][A-Z0-9]+)*\b"
    caption = rf"(CASE WHEN regexp_matches({s}, '{figure}') THEN NOT regexp_matches(regexp_replace({s}, '{figure}\s*', ''), '^,\s*[a-z]') ELSE regexp_matches({s}, '{tab}') AND NOT (regexp_matches(regexp_replace({s}, '{tab}\s*', ''), '^\p{{Ll}}') AND {prose(s)}) END)"
    dense = rf"({digit} + {punct} > greatest({alpha}, 3) OR ({n_of(s, r'\d+(?:\.\d+)?')} >= 3 AND {long} <= 4) OR ({long} <= 2 AND {digit} >= 2) OR regexp_matches({s}, '^(?:\d{{1,3}}[A-Z]|[A-Z]{{1,3}}\d{{1,3}})$'))"
    return rf"({s} <> '' AND (regexp_matches({s}, '(?i)\bGROUND\s+TIME\s+MINUS\s+VEHICLE\s+TIME\b') OR (NOT {prose(s)} AND ({caption} OR {dense}))))"
