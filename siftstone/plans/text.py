"""Cleaning rules, line predicates, names and chunks over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks
from .base import ALPHA, DIGIT, LINES, LOWER, PUNCT, WORD, collapse, n_of, per, prose, strip, table, visual


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _lines(spark, sf_dir):
    """Numbered from 1."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(X.newlines("text"), "\n")).alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), "line")


def normalize(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.md5(X.clean_text("text")).alias("clean_text"), F.md5(X.clean_block("text")).alias("clean_block"), F.length(X.newlines("text")).cast("long").alias("length"))


def line_explode(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("line_no").cast("long").alias("last_line"), F.sum(F.length("line")).alias("n_chars"))


def char_profile(spark, sf_dir):
    kinds = {"alpha": X.LETTER, "digit": X.DIGIT, "lower": X.LOWER, "upper": X.UPPER, "punct": X.PUNCT, "words": X.WORD}
    return _docs(spark, sf_dir).select("doc_id", *(X.count_of("text", p).cast("long").alias(k) for k, p in kinds.items()))


def prose_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.prose_line("line")).select("doc_id", "line_no")


def visual_ratio(spark, sf_dir):
    """For each document: its lines, the visual part of them, and whether it reads like the body of a table."""
    told, x = X.measured(_lines(spark, sf_dir), "line")
    g = told.where(x.s != "").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(X.visual_line(x)).alias("visual"), F.count_if(X.prose_line(x)).alias("prose"),
        F.count_if((F.length(x.s) <= 28) | (x.digit > x.alpha)).alias("short"), F.count_if(x.digit + x.punct > x.alpha).alias("numeric"),
    )
    body = (F.col("n") >= 8) & (F.col("prose") < 2) & ((F.col("short") / F.col("n") > 0.72) | (F.col("numeric") / F.col("n") > 0.55))
    return g.select("doc_id", "n", F.round(F.col("visual") / F.col("n"), 6).alias("visual_ratio"), body.alias("table_body"))


def low_information(spark, sf_dir):
    return _lines(spark, sf_dir).where((X.strip("line") != "") & X.low_information("line")).select("doc_id", "line_no")


def continuations(spark, sf_dir):
    """Lines that go on with the sentence of the line before."""
    from pyspark.sql import Window

    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return _lines(spark, sf_dir).withColumn("before", before).where(F.col("before").isNotNull() & X.ends_mid_sentence("before") & X.starts_like_continuation("line")).select("doc_id", "line_no")


def line_flags(spark, sf_dir):
    flags = {"numbered": X.numbered_heading("line"), "capitals": X.short_capital_title("line"), "axis": X.axis_label("line"), "caption": X.visual_caption("line")}
    return _lines(spark, sf_dir).groupBy("doc_id").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()))


#: Tags and what they hold of scripts and styles, comments, entities; in this order.
MARKUP = [(r"(?s)<!--.*?-->", " "), (r"(?si)<(script|style)\b.*?</(script|style)>", " "), (r"(?s)<[^>]*>", " "), (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&amp;", "&")]


def html_strip(spark, sf_dir):
    text = X.collapse(X.replace_all("html", MARKUP))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).alias("length"), F.md5(text).alias("text_md5"))


def path_metadata(spark, sf_dir):
    """The URL as a path: missions, types and categories by the first rule that fits, stem and slug."""
    low = F.lower("url")
    name = F.regexp_extract(low, "([^/]*)$", 1)
    types = [("/en/", "transcript"), ("/fr/", "textract_extracted"), ("/de/", "audio_transcript"), ("page", "flight_plan")]
    return table(spark, sf_dir, "pages").select(
        "page_id", X.first_match(low, [("example.com", "apollo_11"), ("example.net", "apollo_13"), ("spam", "challenger")], "unknown").alias("mission"), X.first_match(low, types, "document").alias("data_type"),
        X.first_match(name, X.CATEGORY_NAMES, "general_document").alias("category"), X.stem("url").alias("stem"), X.slug("url").alias("slug"),
    )


def missions(spark, sf_dir):
    """Each source's number picks one of the spellings that missions come in."""
    spellings = ["Apollo 11", "apollo_13", "STS-51L", "CHALLENGER", "Gemini 4", "apollo11"]
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    raw = F.element_at(F.array(*map(F.lit, spellings)), n % len(spellings) + 1)
    return _docs(spark, sf_dir).select("doc_id", raw.alias("raw"), X.mission_key(raw).alias("mission"))


def fallbacks(spark, sf_dir):
    """Title, else the first heading of the page, else its URL: the first that is filled."""
    title, h2 = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", "(?s)<h2[^>]*>(.*?)</h2>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(X.first_filled(h2, title, "url"), F.lit("Unknown source")).alias("source"))


def clocks(spark, sf_dir):
    """Event values written as clocks and read again; some are out of range on purpose."""
    v = F.floor(F.col("value")).cast("long")
    colon = F.format_string("%d:%02d:%02d", v, F.pmod(F.col("event_id"), F.lit(65)), F.pmod(F.col("user_id"), F.lit(60)))
    elapsed = F.format_string("%s%02d %02d %02d %02d", F.when(F.col("event_id") % 7 == 0, "-").otherwise(""), F.pmod(F.col("user_id"), F.lit(90)), F.pmod(F.col("event_id"), F.lit(26)), F.pmod(v, F.lit(60)), F.pmod(F.col("event_id"), F.lit(61)))
    return table(spark, sf_dir, "events").select("event_id", X.colon_seconds(colon).alias("colon_sec"), X.elapsed_seconds(elapsed).alias("elapsed_sec"))


def speakers(spark, sf_dir):
    """Speaker labels in the ways that scanning writes them."""
    raw = F.element_at(F.array(*map(F.lit, ["cap  com", "P AO", "lmi'", " cdr ", "CAPCOMM", "tmp"])), (F.pmod("conv_id", F.lit(6)) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.speaker(raw).alias("speaker"), X.speaker_status(raw).alias("status"))


def romans(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["I", "IV", "xiv", "XXVIII", "XCIX", "Q", "LX"])), (F.pmod("item_id", F.lit(7)) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.roman(raw).alias("number"))


def _stride(spark, sf_dir):
    return chunks.stride_chunks(_docs(spark, sf_dir).select("doc_id", "source", "lang", "text"))


def stride(spark, sf_dir):
    return _stride(spark, sf_dir).select("doc_id", "chunk_index", "total_chunks", "token_count", F.md5("chunk").alias("chunk_md5"))


def audit(spark, sf_dir):
    return _stride(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("files"), F.max("token_count").alias("most_tokens"))


def ids(spark, sf_dir):
    return _stride(spark, sf_dir).select("doc_id", "chunk_index", chunks.chunk_id("source", F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".v1.txt")), "chunk_index").alias("id"))


def packed(spark, sf_dir):
    """Greedy packing that keeps white space."""
    rows = _docs(spark, sf_dir).select("doc_id", "text", F.lit("report").alias("source_type"))
    out = chunks.packed_chunks(rows, size=chunks.SIZE, overlap=chunks.OVERLAP)
    return out.select("doc_id", "chunk_index", "total_chunks", "token_count", F.md5("chunk").alias("chunk_md5"))


_S = strip("line")
_TOKENS = f"""WITH t AS (SELECT doc_id, lang, source, {strip('text')} AS s FROM documents), w AS (SELECT *, string_split_regex(s, '\\s+') AS k, len(string_split_regex(s, '\\s+')) AS n FROM t WHERE s <> ''),
c AS (SELECT *, CASE WHEN n <= 500 THEN 1 ELSE ceil((n - 100) / 400.0)::INT END AS total FROM w),
x AS (SELECT *, unnest(range(total)) AS i FROM c), y AS (SELECT *, CASE WHEN total = 1 THEN s ELSE array_to_string(k[i * 400 + 1 : i * 400 + 500], ' ') END AS chunk, len(k[i * 400 + 1 : i * 400 + 500]) AS m FROM x)
"""
#: Pieces end at a space and count their words. A chunk takes pieces while it has at most 500; the next looks back over at most 100, and less if its first piece needs the room.
_PACKED = f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, {strip('text')} AS s FROM documents), w AS (SELECT *, len(regexp_extract_all(s, '\\S+')) AS n, string_split(s, ' ') AS p FROM t WHERE s <> ''),
q AS (SELECT r, list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || ' ' ELSE x END) AS p, list_transform(p, lambda x: len(regexp_extract_all(x, '\\S+'))) AS c FROM w WHERE n > 500),
u AS (SELECT r, p, c, list_transform(range(len(c) + 1), lambda i: coalesce(list_sum(c[1:i]), 0)::BIGINT) AS m FROM q),
g AS (SELECT r, 0 AS k, 0::BIGINT AS a, len(list_filter(m, lambda v: v <= 500)) - 1 AS e FROM u
  UNION ALL SELECT r, k, a, len(list_filter(m, lambda v: v <= m[a + 1] + 500)) - 1 FROM (
    SELECT g.r, g.k + 1 AS k, u.m, len(list_filter(u.m, lambda v: v < greatest(u.m[g.e + 1] - 100, u.m[g.e + 2] - 500))) AS a FROM g JOIN u USING (r) WHERE g.e < len(u.p))),
x AS (SELECT r, k, array_to_string(p[a + 1 : e], '') AS chunk FROM g JOIN u USING (r)),
y AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY r) AS total, chunk FROM x WHERE {strip('chunk')} <> ''
  UNION ALL SELECT r, 0, 1, s FROM w WHERE n <= 500)
SELECT doc_id, i::INT AS chunk_index, total::INT AS total_chunks, len(regexp_extract_all(chunk, '\\S+'))::INT AS token_count, md5(chunk) AS chunk_md5 FROM y JOIN t USING (r)"""
_HTML = collapse(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?si)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&amp;', '&', 'g')"
)
_JOIN = r"regexp_replace(text, '([A-Za-z]+)-\s*\n\s*([a-z]+)', '\1\2', 'g')"
_BLOCK = strip(r"regexp_replace(" + collapse(r"regexp_replace(text, '([A-Za-z])-\s+([a-z])', '\1\2', 'g')") + r", '\b[A-Z]?\d+-\d+(?:/[A-Z]?\d+-\d+)?\b$', '')")
_TITLE = rf"regexp_extract({_S}, '^\d+(?:\.\d+)*\.?\s+(.+)$', 1)"
_FIG, _TAB = r"(?i)^\s*(?:FIG|FIGURE)\.?\s+[A-Z0-9]+(?:[-.][A-Z0-9]+)*\b", r"(?i)^\s*TABLE\s+[A-Z0-9]+(?:[-.][A-Z0-9]+)*\b"
_AXIS = X.AXIS.replace("'", "''")
_CATEGORY = "CASE " + " ".join(f"WHEN contains(name, '{a}') THEN '{b}'" for a, b in X.CATEGORY_NAMES) + " ELSE 'general_document' END"
_LINKS = "|".join(X.LINKS)

QUERIES = {
    "text_normalize": (normalize, f"SELECT doc_id, md5({collapse(_JOIN)}) AS clean_text, md5({_BLOCK}) AS clean_block, length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS length FROM documents"),
    "line_explode": (line_explode, f"SELECT doc_id, count(*) AS n_lines, max(line_no) AS last_line, sum(length(line))::BIGINT AS n_chars FROM ({LINES}) GROUP BY doc_id"),
    "char_class_profile": (char_profile, f"SELECT doc_id, {n_of('text', ALPHA)} AS alpha, {n_of('text', DIGIT)} AS digit, {n_of('text', LOWER)} AS lower, {n_of('text', chr(92) + 'p{Lu}')} AS upper, {n_of('text', PUNCT)} AS punct, {n_of('text', WORD)} AS words FROM documents"),
    "prose_line_filter": (prose_lines, f"SELECT doc_id, line_no::INT AS line_no FROM (SELECT *, {_S} AS s FROM ({LINES})) WHERE {prose('s')}"),
    "visual_ratio_by_doc": (
        visual_ratio,
        f"""SELECT doc_id, n, round(v / n::DOUBLE, 6) AS visual_ratio, (n >= 8 AND p < 2 AND (short / n::DOUBLE > 0.72 OR num / n::DOUBLE > 0.55)) AS table_body FROM (
        SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {visual('s')}) AS v, count(*) FILTER (WHERE {prose('s')}) AS p, count(*) FILTER (WHERE length(s) <= 28 OR {n_of('s', DIGIT)} > {n_of('s', ALPHA)}) AS short,
        count(*) FILTER (WHERE {n_of('s', DIGIT)} + {n_of('s', PUNCT)} > {n_of('s', ALPHA)}) AS num FROM (SELECT doc_id, {_S} AS s FROM ({LINES})) WHERE s <> '' GROUP BY doc_id)""",
    ),
    "low_information_blocks": (low_information, f"SELECT doc_id, line_no::INT AS line_no FROM ({LINES}) WHERE {_S} <> '' AND ({n_of('line', '[A-Za-z]{2,}')} = 0 OR ({n_of('line', '[A-Za-z]{2,}')} < 5 AND {n_of('line', DIGIT)} + {n_of('line', PUNCT)} > greatest({n_of('line', ALPHA)}, 1)))"),
    "sentence_continuations": (
        continuations,
        rf"""SELECT doc_id, line_no::INT AS line_no FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM ({LINES}))
        WHERE b IS NOT NULL AND NOT regexp_matches(b, '[.!?;:)"'']\s*$') AND regexp_matches(line, '^\s*(?:[a-z]|(?:{_LINKS})\b)')""",
    ),
    "line_flags": (
        line_flags,
        rf"""SELECT doc_id, count(*) FILTER (WHERE regexp_matches(s, '(?i)^SECTION\s+(?:[IVXLCDM]+|\d+)') OR (regexp_matches(t, '^\p{{Lu}}') AND {n_of('t', '[A-Za-z]')} > 0 AND {per(n_of('t', '[A-Z]'), n_of('t', '[A-Za-z]'))} >= 0.6 AND {n_of('t', DIGIT)} + {n_of('t', PUNCT)} <= {n_of('t', '[A-Za-z]')})) AS numbered,
        count(*) FILTER (WHERE {n_of('s', '[A-Za-z][A-Za-z/-]*')} BETWEEN 1 AND 8 AND {n_of('s', '[A-Za-z]')} > 0 AND NOT regexp_matches(s, '\d') AND {per(n_of('s', '[A-Z]'), n_of('s', '[A-Za-z]'))} >= 0.85) AS capitals,
        count(*) FILTER (WHERE regexp_matches(s, '{_AXIS}')) AS axis,
        count(*) FILTER (WHERE CASE WHEN regexp_matches(s, '{_FIG}') THEN NOT regexp_matches(regexp_replace(s, '{_FIG}\s*', ''), '^,\s*[a-z]') ELSE regexp_matches(s, '{_TAB}') AND NOT (regexp_matches(regexp_replace(s, '{_TAB}\s*', ''), '^\p{{Ll}}') AND {prose('s')}) END) AS caption
        FROM (SELECT doc_id, {_S} AS s, {_TITLE} AS t FROM ({LINES})) GROUP BY doc_id""",
    ),
    "html_noise_strip": (html_strip, f"SELECT page_id, length(t)::INT AS length, md5(t) AS text_md5 FROM (SELECT page_id, {_HTML} AS t FROM pages)"),
    "path_metadata": (
        path_metadata,
        f"""SELECT page_id, CASE WHEN contains(low, 'example.com') THEN 'apollo_11' WHEN contains(low, 'example.net') THEN 'apollo_13' WHEN contains(low, 'spam') THEN 'challenger' ELSE 'unknown' END AS mission,
        CASE WHEN contains(low, '/en/') THEN 'transcript' WHEN contains(low, '/fr/') THEN 'textract_extracted' WHEN contains(low, '/de/') THEN 'audio_transcript' WHEN contains(low, 'page') THEN 'flight_plan' ELSE 'document' END AS data_type,
        {_CATEGORY} AS category, CASE WHEN length(base) > 1 AND regexp_matches(base, '.\\.[^.]*$') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS stem,
        regexp_replace(regexp_replace(low, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
        FROM (SELECT page_id, lower(url) AS low, regexp_extract(lower(url), '([^/]*)$', 1) AS name, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages)""",
    ),
    "mission_canonicalize": (
        missions,
        """SELECT doc_id, raw, CASE WHEN k = 'sts51l' THEN 'challenger' WHEN k IN ('apollo11', 'apollo13', 'challenger') THEN k END AS mission FROM (SELECT *, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS k FROM
        (SELECT doc_id, ['Apollo 11', 'apollo_13', 'STS-51L', 'CHALLENGER', 'Gemini 4', 'apollo11'][regexp_extract(source, '(\\d+)$', 1)::INT % 6 + 1] AS raw FROM documents))""",
    ),
    "fallback_chain": (fallbacks, "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<h2[^>]*>(.*?)</h2>', 1), ''), nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), nullif(url, ''), 'Unknown source') AS source FROM pages"),
    "timestamp_seconds": (
        clocks,
        """SELECT event_id, CASE WHEN v >= 0 AND a < 60 THEN (v * 60 + a) * 60 + b END AS colon_sec,
        CASE WHEN h < 24 AND s < 60 THEN (CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END) * (((user_id % 90 * 24 + h) * 60 + m) * 60 + s) END AS elapsed_sec
        FROM (SELECT event_id, user_id, floor(value)::BIGINT AS v, event_id % 65 AS a, user_id % 60 AS b, event_id % 26 AS h, (floor(value)::BIGINT % 60 + 60) % 60 AS m, event_id % 61 AS s FROM events)""",
    ),
    "speaker_normalize": (speakers, "SELECT conv_id, turn, ['CAPCOM', 'PAO', 'LMI''', 'CDR', 'CAPCOM', 'TMP'][conv_id % 6 + 1] AS speaker, ['recognized', 'recognized', 'ocr_alias', 'recognized', 'recognized', 'ocr_alias'][conv_id % 6 + 1] AS status FROM conversations"),
    "roman_numerals": (romans, "SELECT item_id, [1, 4, 14, 28, 99, NULL, 60][item_id % 7 + 1] AS number FROM benchmark"),
    "chunk_fixed_stride": (stride, _TOKENS + "SELECT doc_id, i::INT AS chunk_index, total AS total_chunks, m::INT AS token_count, md5(chunk) AS chunk_md5 FROM y"),
    "chunk_audit": (audit, _TOKENS + "SELECT lang, source, count(*) AS chunks, count(DISTINCT doc_id) AS files, max(m)::INT AS most_tokens FROM y GROUP BY lang, source"),
    "chunk_ids": (ids, _TOKENS + "SELECT doc_id, i::INT AS chunk_index, regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') || '::doc_' || doc_id || '_v1::chunk_' || lpad(i::VARCHAR, 4, '0') AS id FROM y"),
    "chunk_packed": (packed, _PACKED),
}
