"""The parsers of reports, stage by stage, over files that are built from the documents; their folds in SQL are list_reduce."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines, reports
from ..session import map_rows
from .base import ALPHA, DIGIT, LOWER, PUNCT, WORD, collapse, n_of, per, prose, strip, table, visual

SMALL, LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_T = f"translate(substr(x, 1, 24), '{SMALL}', '{LARGE}')"
_L = f"translate(x, '{LARGE}', '{SMALL}')"
_NOISE = "11 22 33 44 55 66 77 88 99 00 12 13 14 15 16 17 18 19 "
#: The line that sentence x, number i of document doc_id, becomes: captions, headings, labels, numbers, prose. Read by both engines.
LINE = f"""CASE (doc_id * 5 + i * 7) % 29
WHEN 0 THEN concat('Figure ', doc_id % 9 + 1, '-', i, '. ', substr(x, 1, 40))
WHEN 1 THEN concat('TABLE ', i + 1, ' ', {_T})
WHEN 2 THEN concat('TABLE 4 ', {_L})
WHEN 3 THEN concat(doc_id % 5 + 1, '.', i % 4 + 1, ' ', {_T})
WHEN 4 THEN concat('SECTION ', doc_id % 7 + 1, CASE i % 2 WHEN 0 THEN '' ELSE concat(' - ', {_T}) END)
WHEN 5 THEN 'frequency, hz'
WHEN 6 THEN '12.5 km'
WHEN 7 THEN {_T}
WHEN 8 THEN ''
WHEN 9 THEN concat('12.5  13.75 ', doc_id, ' 99')
WHEN 10 THEN 'THIS PAGE INTENTIONALLY LEFT BLANK'
WHEN 11 THEN concat('A', doc_id % 9, '-', i)
WHEN 12 THEN concat('', doc_id)
WHEN 13 THEN x
WHEN 14 THEN concat('and ', {_L}, '.')
WHEN 15 THEN concat('{_NOISE}', 'NOTE: ', substr(x, 1, 90))
WHEN 16 THEN concat('{_NOISE}{_NOISE}', substr(x, 1, 90))
WHEN 17 THEN concat('Fig 3, which ', {_L})
WHEN 18 THEN CASE doc_id % 4 WHEN 0 THEN 'APPENDIX A' WHEN 1 THEN 'Results and Discussion' ELSE concat(i % 6 + 1, ' ', {_T}) END
WHEN 19 THEN ''
ELSE concat(x, '.') END"""
_MARKED = f"""concat(CASE WHEN doc_id % 6 <> 5 AND i % 12 = 0 THEN concat('--- PAGE ', CAST((i - i % 12) / 12 AS INT) + 1, ' ---', chr(10)) ELSE '' END, {LINE})"""
_HEAD = "CASE WHEN doc_id % 6 = 4 THEN concat('front matter', chr(10)) ELSE '' END"
STOP = "Results and Discussion"
OPTIONS = reports.Options(start_page=2, stop_heading=STOP, mission="Apollo 11", collection="apollo11", report_type="mission_report", drop_keywords=("frequency", "FIG"))


def built(spark, sf_dir) -> DataFrame:
    """(doc_id, path, value): a report for each document, of pages of twelve lines; some have no page markers, some a line before the first."""
    said = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), "[.] ")
    d = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"))
    made = d.select("doc_id", F.expr(f"transform(said, (x, i) -> {_MARKED})").alias("ls"))
    return made.select("doc_id", F.concat(F.lit("memory://r"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.expr(_HEAD), F.array_join("ls", "\n")).alias("value"))


def folded(files: DataFrame, ddl: str, rows: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """rows(path, value) of each file, where the file is."""
    return map_rows(files.select("path", "value"), ddl, lambda path, value: rows(path, value or ""))


def page_split(spark, sf_dir):
    pages = lines.page_rows(built(spark, sf_dir))
    return pages.select("path", "page_no", F.md5("page").alias("page_md5"))


def line_pages(spark, sf_dir):
    """Lines from the second page's marker on, with the page that they are on."""
    rows = lines.line_rows(built(spark, sf_dir), start_page=2)
    return rows.select("path", F.col("line_no").cast("int").alias("line_no"), "page_no", F.md5("line").alias("line_md5"))


def line_kinds(spark, sf_dir):
    """Each predicate over the lines of each file: how many lines it holds for."""
    rows, x = X.measured(built(spark, sf_dir).select("doc_id", F.explode(F.split("value", "\n")).alias("line")), "line")
    flags = {
        "numbered": X.numbered_heading, "capitals": X.short_capital_title, "axis": X.axis_label, "caption": X.visual_caption,
        "visual": X.visual_line, "prose": X.prose_line, "narrative": X.narrative_line, "low": lambda x: (x.s != "") & X.low_information(x),
    }
    return rows.groupBy("doc_id").agg(*(F.count(F.when(c(x), 1)).alias(k) for k, c in flags.items()))


def continuations(spark, sf_dir):
    """Lines that go on with the sentence of the line before."""
    rows = built(spark, sf_dir).select("doc_id", F.split("value", "\n").alias("ls"))
    pairs = rows.select("doc_id", F.posexplode(F.transform("ls", lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.element_at("ls", i)).alias("before")))).alias("_p", "l"))
    met = pairs.where(F.col("l.before").isNotNull() & X.ends_mid_sentence(F.col("l.before")) & X.starts_like_continuation(F.col("l.line")))
    return met.select("doc_id", (F.col("_p") + 1).alias("line_no"))


def kept_pages(spark, sf_dir):
    """Whole pages and the narrative regions of mixed ones, with the groups that blocks may run over."""
    ddl = "path string, page int, grp int, text string"
    found = folded(built(spark, sf_dir), ddl, lambda path, value: [(path, n, g, t) for n, t, g in reports.kept_pages(value, OPTIONS)])
    return found.select("path", "page", "grp", F.md5("text").alias("text_md5"))


def blocks(spark, sf_dir):
    """The blocks of the pages that are kept, after cleaning, salvage and merging."""
    ddl = "path string, n int, text string, first_page int, last_page int, heading boolean"

    def rows(path, value):
        return [(path, i, b.text, b.first, b.last, b.heading) for i, b in enumerate(reports.blocks_of(reports.kept_pages(value, OPTIONS)))]

    return folded(built(spark, sf_dir), ddl, rows).select("path", "n", F.md5("text").alias("text_md5"), "first_page", "last_page", "heading")


def records(spark, sf_dir):
    m = reports.report_records(built(spark, sf_dir), OPTIONS).select("id", "document", "metadata.*")
    kept = ("collection", "mission", "source", "source_type", "source_file", "source_path", "doc_id", "report_type", "section_path", "section_depth", "top_section_id", "top_section_title", "page_start", "page_end")
    return m.select("id", *kept, F.md5("document").alias("document_md5"))


# --- the same in SQL ---


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _any(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, '{_q(pattern)}')"


def capitals(s: str) -> str:
    return per(n_of(s, "[A-Z]"), n_of(s, "[A-Za-z]"))


def noise(s: str) -> str:
    return f"({n_of(s, DIGIT)} + {n_of(s, PUNCT)})"


def caption(s: str) -> str:
    sentence = f"({_any(f'''regexp_replace({s}, '{X.TABLE}{chr(92)}s*', '')''', chr(94) + chr(92) + 'p{Ll}')} AND {prose(s)})"
    return f"(CASE WHEN {_any(s, X.FIGURE)} THEN NOT regexp_matches(regexp_replace({s}, '{X.FIGURE}\\s*', ''), '^,\\s*[a-z]') ELSE {_any(s, X.TABLE)} AND NOT {sentence} END)"


def numbered(s: str) -> str:
    t = rf"regexp_extract({s}, '^\d+(?:\.\d+)*\.?\s+(.+)$', 1)"
    section = _any(s, r"(?i)^SECTION\s+(?:[IVXLCDM]+|\d+)")
    return rf"({section} OR ({_any(t, '^\\p{Lu}')} AND {n_of(t, '[A-Za-z]')} > 0 AND {capitals(t)} >= 0.6 AND {noise(t)} <= {n_of(t, '[A-Za-z]')}))"


def capital_title(s: str) -> str:
    return rf"({n_of(s, '[A-Za-z][A-Za-z/-]*')} BETWEEN 1 AND 8 AND NOT {_any(s, chr(92) + 'd')} AND {n_of(s, '[A-Za-z]')} > 0 AND {capitals(s)} >= 0.85)"


def low_information(s: str) -> str:
    long = n_of(s, "[A-Za-z]{2,}")
    return f"({long} = 0 OR ({long} < 5 AND {noise(s)} > greatest({n_of(s, ALPHA)}, 1)))"


def _set(words) -> str:
    return "[" + ", ".join(f"'{_q(w)}'" for w in words) + "]"


def narrative(s: str) -> str:
    """Of a stripped line."""
    w = f"regexp_extract_all({s}, '{WORD}')"
    plain = rf"list_transform({w}, lambda v: regexp_replace(lower(v), '^[-'']+|[-'']+$', '', 'g'))"
    n, told = f"len({w})", f"list_has_any({plain}, {_set(X.NARRATIVE)})"
    held, small = f"len(list_filter({plain}, lambda v: list_contains({_set(X.FUNCTION)}, v)))", _any(s, r"^\p{Ll}")
    cues = [
        told,
        f"({n} >= 4 AND len(list_filter({w}, lambda v: length(v) >= 5 AND regexp_matches(lower(v), '(?:ed|ing)[-'']*$'))) > 0)",
        _any(s, r"[.!?;:](?:\s|$)"),
        f"({s} LIKE '%-' AND {n} >= 3)",
        f"{held} >= 4",
        _any(s, r"(?i)\bsuch\s+as\b"),
        f"({small} AND {n} >= 6)",
        f"({small} AND {n} >= 4 AND len(list_filter({w}, lambda v: regexp_matches(v, '[^-]-+[^-]'))) > 0)",
    ]
    fragment = f"({n} <= 3 AND coalesce({plain}[1], '') LIKE '%ing' AND NOT {told} AND {held} = 0)"
    solid = f"{n} >= 2 AND {per(n_of(s, ALPHA), n_of(s, chr(92) + 'S'))} >= 0.55 AND {n_of(s, LOWER)} >= 7"
    return f"({solid} AND NOT {visual(s)} AND NOT {caption(s)} AND NOT {fragment} AND ({' OR '.join(cues)}))"


def clean(x: str) -> str:
    joined = collapse(rf"regexp_replace({x}, '([A-Za-z])-\s+([a-z])', '\1\2', 'g')")
    return strip(rf"regexp_replace({joined}, '\b{reports.PAGE_CODE}\b$', '')")


_BLANK = r"(?i)\bTHIS PAGE INTENTIONALLY LEFT BLANK\b"
_DATE = r"(?i)^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{2,4}\s+\d{3,4}\s+(?:UTC|GMT|[ECMP][SD]T)$"


def heading(s: str) -> str:
    """Of a stripped line: {'title', 'id', 'pending'}, or null."""
    section, number = r"(?i)^SECTION\s+(\d+)\s*(?:[-–]+\s*(.+))?$", r"^(\d+(?:\.\d+)*)\.?\s+(.+)$"
    title = strip(f"regexp_extract({s}, '{section}', 2)")
    g = f"regexp_extract({s}, '{number}', 2)"
    own = strip(g)
    fits = f"(NOT {_any(own, _DATE)} AND {_any(own, '^(?:[-–]' + chr(92) + 's*)?[A-Za-z]')} AND {noise(g)} <= {n_of(g, ALPHA)} AND {capitals(own)} >= 0.6 AND length({own}) <= 130)"
    w = f"regexp_extract_all({s}, '[A-Za-z][A-Za-z''/-]*')"
    shouted = f"({capitals(s)} >= 0.82 AND len({w}) <= 8)"
    titled = f"(len({w}) <= 5 AND len(list_filter({w}, lambda v: NOT regexp_matches(v, '^[A-Z]'))) = 0)"
    first = rf"coalesce(nullif(regexp_extract({s}, '\p{{L}}'), ''), 'A')"
    bad = rf"({_any(s, '[.;,]$|[0-9()=+]')} OR len({w}) NOT BETWEEN 1 AND 10 OR (len({w}) = 1 AND NOT list_contains({_set(sorted(reports.ONE_WORD))}, upper({s}))) OR NOT regexp_matches({first}, '^\p{{Lu}}'))"
    made = lambda t, i, p: f"{{'title': {t}, 'id': {i}, 'pending': {p}}}"
    return f"""CASE WHEN {s} = '' OR length({s}) > 140 OR {_any(s, X.AXIS)} OR {_any(s, _BLANK)} OR {_any(s, chr(94) + chr(92) + '([A-Za-z0-9]+' + chr(92) + ')' + chr(92) + 's+')} THEN NULL
    WHEN {_any(s, section)} THEN {made(title, f"regexp_extract({s}, '{section}', 1)", f"{title} = ''")}
    WHEN {_any(s, number)} THEN CASE WHEN {fits} THEN {made(own, f"regexp_extract({s}, '{number}', 1)", 'false')} END
    WHEN {bad} THEN NULL
    WHEN ({shouted} OR {titled}) AND NOT list_contains({_set(reports.NO_HEADINGS)}, upper({s})) THEN {made(s, "''", 'false')} END"""


def salvage(s: str) -> str:
    """Of a cleaned block; notes are the only markers that these files have."""
    alpha, long = n_of(s, ALPHA), n_of(s, "[A-Za-z]{2,}")
    note = strip(rf"regexp_extract({s}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(NOTE:.*)$', 1)")
    noted = f"({_any(s, r'(?i)(?:^|[^\p{L}\p{N}_])NOTE:')} AND {noise(s)} / {alpha}::DOUBLE >= 0.40 AND {n_of(note, '[A-Za-z]{2,}')} >= 4 AND {n_of(note, ALPHA)} > 0 AND {per(noise(note), n_of(note, ALPHA))} <= 0.55)"
    t = f"substr({s}, p)"
    begins = rf"(regexp_matches({t}, '^[A-Za-z][A-Za-z''-]{{2,}}(?:[^\p{{L}}\p{{N}}_]|$)') AND (p = 1 OR NOT regexp_matches(substr({s}, p - 1, 1), '[\p{{L}}\p{{N}}_]')))"
    reads = f"({n_of(t, '[A-Za-z]{2,}')} >= 8 AND {n_of(t, LOWER)} >= 15 AND {per(noise(t), n_of(t, ALPHA))} <= 0.45)"
    at = f"list_filter(range(1, length({s}) + 1), lambda p: {begins} AND {reads})[1]"
    return f"CASE WHEN {alpha} = 0 THEN '' WHEN {noted} THEN {note} WHEN {noise(s)} / {alpha}::DOUBLE <= 0.60 OR {long} IS NULL THEN {s} ELSE coalesce({strip(f'substr({s}, {at})')}, '') END"


def bare(page: str) -> str:
    for p in reports.FURNITURE:
        flags = "(?mi)" if p.flags & 2 else "(?m)"
        page = f"regexp_replace({page}, '{flags}{_q(p.pattern).replace(chr(92) + 'Z', chr(92) + 'z')}', '', 'g')"
    return strip(page)


_MARK = r"(?m)^---\s*PAGE\s*(\d+)\s*---\s*$"
_BUILT = f"""f AS (SELECT doc_id, 'memory://r' || doc_id || '.txt' AS path, {_HEAD} || array_to_string(list_transform(string_split(translate(text, chr(10), ' '), '. '), lambda x, j: {_MARKED.replace('i % ', '(j - 1) % ').replace('(i - ', '((j - 1) - ').replace("'-', i,", "'-', j - 1,").replace("'-', i)", "'-', j - 1)").replace('i + 1', 'j').replace('i * 7', '(j - 1) * 7')}), chr(10)) AS value FROM documents)"""
_PAGES = f"""{_BUILT}, ps AS (SELECT doc_id, path, regexp_extract_all(value, '{_MARK}', 1) AS ns, string_split_regex(value, '{_MARK}') AS parts, value FROM f),
pages AS (SELECT doc_id, path, unnest(CASE WHEN len(ns) = 0 THEN [{{'page_no': 1, 'page': value}}] ELSE list_transform(ns, lambda n, k: {{'page_no': n::INT, 'page': parts[k + 1]}}) END, recursive := true) FROM ps)"""

_S = "l.s"
_STRIPPED = f"list_transform(string_split(page, chr(10)), lambda v: {strip('v')})"
#: What ends a region: its run is kept if it has enough letters.
_OUT = "CASE WHEN a.n >= 60 THEN list_append(a.out, a.run) ELSE a.out END"
_NUMBER = r"regexp_extract(a.heading, '(?i)^SECTION\s+(\d+)\b', 1)"


def _region(out: str, run: str, n: str, head: str, skipped: str) -> str:
    return f"{{'out': {out}, 'run': {run}, 'n': {n}, 'heading': {head}, 'skipped': {skipped}}}"


_DONE = _region(_OUT, "''", "0", "''", "0")
_SAME = _region("a.out", "a.run", "a.n", "a.heading", "a.skipped")
_STEP = f"""CASE WHEN l.s = '' THEN {_DONE}
WHEN {_NUMBER} <> '' AND NOT contains(a.heading, chr(10)) AND l.capitals THEN {_region('a.out', 'a.run', 'a.n', 'a.heading || chr(10) || l.s', 'a.skipped')}
WHEN l.caption THEN {_DONE}
WHEN l.numbered AND {_NUMBER} <> '' AND l.num = {_NUMBER} THEN {_region('a.out', 'a.run', 'a.n', 'a.heading || chr(10) || l.s', 'a.skipped')}
WHEN l.numbered THEN {_region(_OUT, "''", '0', 'l.s', '0')}
WHEN l.narrative THEN {_region('a.out', "CASE WHEN a.run <> '' THEN a.run || chr(10) || l.s WHEN a.heading <> '' THEN a.heading || chr(10) || l.s ELSE l.s END", 'a.n + l.alpha', 'a.heading', '0')}
WHEN a.run <> '' AND a.skipped >= 8 THEN {_DONE}
WHEN a.run <> '' THEN {_region('a.out', 'a.run', 'a.n', 'a.heading', 'a.skipped + 1')}
ELSE {_SAME} END"""
_KEPT = f"""{_PAGES},
started AS (SELECT *, regexp_matches(page, '(?mi)^\\s*{STOP}\\s*$') AS stop FROM pages WHERE page_no >= {OPTIONS.start_page}),
upto AS (SELECT *, {bare(f"CASE WHEN stop THEN regexp_replace(page, '(?si)(^|' || chr(10) || ')[ ]*{STOP}[ ]*(' || chr(10) || '.*)?$', '') ELSE page END")} AS body
  FROM (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY path ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM started) WHERE before = 0),
told AS (SELECT path, page_no, body, row_number() OVER () AS r FROM upto),
ls AS (SELECT path, page_no, r, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS s FROM (SELECT path, page_no, r, list_transform(string_split(body, chr(10)), lambda v: {strip('v')}) AS t FROM told)),
flags AS (SELECT *, {n_of('s', ALPHA)} AS alpha, {capital_title('s')} AS capitals, {caption('s')} AS caption, {numbered('s')} AS numbered, {narrative('s')} AS narrative, {visual('s')} AS visual, {prose('s')} AS prose,
  length(s) <= 28 OR {n_of('s', DIGIT)} > {n_of('s', ALPHA)} AS short, {noise('s')} > {n_of('s', ALPHA)} AS numeric, regexp_extract(s, '^(\\d+)', 1) AS num, {_any('s', X.FIGURE)} AS fig, {_any('s', X.TABLE)} AS tab FROM ls),
sums AS (SELECT r, count(*) FILTER (WHERE s <> '') AS n, bool_or(fig OR (tab AND caption)) AS mixed, count(*) FILTER (WHERE s <> '' AND prose) AS p, count(*) FILTER (WHERE s <> '' AND short) AS short,
  count(*) FILTER (WHERE s <> '' AND numeric) AS num, count(*) FILTER (WHERE visual) AS v,
  list({{'s': s, 'alpha': alpha, 'capitals': capitals, 'caption': caption, 'numbered': numbered, 'narrative': narrative, 'num': num}} ORDER BY i) AS t FROM flags GROUP BY r),
hint AS (SELECT r, contains(regexp_replace(upper(body), '\\s+', ' ', 'g'), 'FREQUENCY') OR regexp_matches(upper(body), '(?m)^\\s*FIG(?:\\.|URE)?\\b') AS hint FROM told),
kinds AS (SELECT path, page_no, r, body, t, CASE WHEN body = '' THEN 'empty' WHEN mixed OR (n >= 8 AND p < 2 AND (short / n::DOUBLE > 0.72 OR num / n::DOUBLE > 0.55)) OR (hint AND v / n::DOUBLE >= 0.35) THEN 'parts' ELSE 'whole' END AS kind FROM told JOIN sums USING (r) JOIN hint USING (r)),
parted AS (SELECT path, page_no, kind, body, CASE kind WHEN 'parts' THEN list_reduce(list_append(t, {{'s': '', 'alpha': 0::BIGINT, 'capitals': false, 'caption': false, 'numbered': false, 'narrative': false, 'num': ''}}), lambda a, l: {_STEP},
  {_region("[]::VARCHAR[]", "''", '0::BIGINT', "''", '0::BIGINT')}).out ELSE []::VARCHAR[] END AS regions FROM kinds),
steps AS (SELECT *, CASE kind WHEN 'parts' THEN len(regions) WHEN 'whole' THEN (coalesce(lag(kind) OVER w, '') <> 'whole' OR lag(page_no) OVER w <> page_no - 1)::INT ELSE 0 END AS more FROM parted WINDOW w AS (PARTITION BY path ORDER BY page_no)),
grouped AS (SELECT *, sum(more) OVER (PARTITION BY path ORDER BY page_no) AS upto FROM steps),
kept AS (SELECT path, page_no, (upto - more + unnest(range(1, len(regions) + 1)))::INT AS grp, unnest(regions) AS body FROM grouped WHERE kind = 'parts' UNION ALL SELECT path, page_no, upto::INT, body FROM grouped WHERE kind = 'whole')"""

_JOINS = f"""a.heading = false AND b.heading = false AND (a.grp = b.grp OR a.last_page = b.first_page) AND NOT regexp_matches(a.text, '[.!?;:)"'']\\s*$') AND regexp_matches(b.text, '^(?:[a-z]|(?:{"|".join(X.LINKS)})\\b)')"""
_BLOCKS = f"""{_KEPT},
bl AS (SELECT path, page_no, grp, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS s FROM (SELECT path, page_no, grp, list_transform(string_split(body, chr(10)), lambda v: {strip('v')}) AS t FROM kept)),
bk AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN {_any('s', f'^(?:{reports.PAGE_CODE}|[0-9]+)$')} OR {_any('s', X.AXIS)} THEN 'skip' WHEN ({heading('s')}) IS NOT NULL THEN 'heading' ELSE 'text' END AS kind FROM bl),
bi AS (SELECT *, sum((kind = 'heading' OR (kind = 'text' AND coalesce(before, '') <> 'text'))::INT) OVER (PARTITION BY path, grp, page_no ORDER BY i) AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY path, grp, page_no ORDER BY i) AS before FROM bk WHERE kind <> 'skip')),
raw AS (SELECT path, grp, page_no, min(i) AS i, string_agg(s, ' ' ORDER BY i) AS x FROM bi WHERE kind IN ('heading', 'text') GROUP BY path, grp, page_no, island),
cl AS (SELECT path, grp, page_no, i, {clean('x')} AS c FROM raw),
sv AS (SELECT path, grp, page_no, i, c, ({heading('c')}) IS NOT NULL AS own, CASE WHEN ({heading('c')}) IS NOT NULL THEN c ELSE {salvage('c')} END AS text FROM cl WHERE NOT {_any('c', _BLANK)}),
hd AS (SELECT path, grp, page_no, i, text, own OR ({heading('text')}) IS NOT NULL AS heading FROM sv WHERE text <> ''),
gd AS (SELECT path, list({{'text': text, 'first_page': page_no, 'last_page': page_no, 'grp': grp, 'heading': heading}} ORDER BY grp, page_no, i) AS bs FROM hd WHERE heading OR NOT {low_information('text')} GROUP BY path),
mg AS (SELECT path, list_reduce(bs[2:], lambda m, b: (CASE WHEN list_transform([m[len(m)]], lambda a: {_JOINS})[1]
  THEN list_append(m[1 : len(m) - 1], list_transform([m[len(m)]], lambda a: {{'text': {clean("a.text || ' ' || b.text")}, 'first_page': least(a.first_page, b.first_page), 'last_page': greatest(a.last_page, b.last_page), 'grp': a.grp, 'heading': false}})[1])
  ELSE list_append(m, b) END), bs[1:1]) AS bs FROM gd),
blocks AS (SELECT path, unnest(range(len(bs))) AS n, unnest(bs, recursive := true) FROM mg)"""

_PUT = "list_append(a.out, {'n': b.n, 'text': b.text, 'first_page': b.first_page, 'last_page': b.last_page, 'stack': a.stack})"
_LABEL = "CASE WHEN h.id <> '' THEN h.id || '. ' || h.title ELSE h.title END"
_APPENDIX = r"regexp_matches({}, '(?i)^APPENDIX(?:\s+[A-Z0-9]+)?$')"
_DEPTH = "coalesce(list_max(list_transform(a.stack, lambda h, k: CASE WHEN h.id <> '' THEN k ELSE 0 END)), 0)"
_NEXT = f"""CASE WHEN b.h.pending THEN a.stack
WHEN a.pend <> '' AND b.h.id = '' THEN [{{'title': b.h.title, 'id': a.pend}}]
WHEN b.h.id <> '' THEN list_append(a.stack[1 : length(b.h.id) - length(replace(b.h.id, '.', ''))], {{'title': b.h.title, 'id': b.h.id}})
WHEN {_APPENDIX.format('b.h.title')} THEN [{{'title': b.h.title, 'id': b.h.id}}]
WHEN len(a.stack) > 0 AND {_APPENDIX.format("coalesce(a.stack[1].title, '')")} THEN [a.stack[1], {{'title': b.h.title, 'id': b.h.id}}]
ELSE list_append(a.stack[1 : {_DEPTH}], {{'title': b.h.title, 'id': b.h.id}}) END"""
_RECORDS = f"""{_BLOCKS},
hs AS (SELECT path, list({{'n': n, 'text': text, 'first_page': first_page, 'last_page': last_page, 'h': {heading('text')}}} ORDER BY n) AS bs FROM blocks GROUP BY path),
fs AS (SELECT path, list_reduce(bs, lambda a, b: (CASE WHEN b.h IS NULL THEN {{'stack': a.stack, 'pend': '', 'out': {_PUT}}} ELSE {{'stack': {_NEXT}, 'pend': CASE WHEN b.h.pending THEN b.h.id ELSE '' END, 'out': a.out}} END),
  {{'stack': []::STRUCT(title VARCHAR, id VARCHAR)[], 'pend': '', 'out': []::STRUCT(n BIGINT, "text" VARCHAR, first_page INT, last_page INT, stack STRUCT(title VARCHAR, id VARCHAR)[])[]}}).out AS out FROM hs),
rs AS (SELECT path, unnest(range(len(out))) AS k, unnest(out) AS o FROM fs),
rr AS (SELECT path, replace(replace(path, 'memory://', ''), '.txt', '') AS stem, k, o, coalesce(array_to_string(list_transform(o.stack, lambda h: {_LABEL}), ' > '), '') AS section, list_filter(o.stack, lambda h: h.id <> '')[1] AS top FROM rs)"""

QUERIES = {
    "page_split": (page_split, f"WITH {_PAGES} SELECT path, page_no, md5(page) AS page_md5 FROM pages"),
    "line_pages": (
        line_pages,
        f"""WITH {_BUILT}, l AS (SELECT path, unnest(string_split(v, chr(10))) AS line, unnest(range(1, len(string_split(v, chr(10))) + 1)) AS line_no FROM (SELECT path, regexp_replace(value, '\\n$', '') AS v FROM f)),
        m AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^\\s*---\\s*PAGE\\s*(\\d+)\\s*---\\s*$') THEN regexp_extract(line, '(\\d+)', 1)::INT END AS mark FROM l),
        p AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS page_no, max((mark = 2)::INT) OVER w AS begun FROM m WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT path, line_no::INT AS line_no, page_no, md5(line) AS line_md5 FROM p WHERE mark IS NULL AND begun = 1""",
    ),
    "line_kinds": (
        line_kinds,
        f"""WITH {_BUILT}, l AS (SELECT doc_id, {strip('v')} AS s FROM (SELECT doc_id, unnest(string_split(value, chr(10))) AS v FROM f))
        SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE {c('s')}) AS {k}" for k, c in {'numbered': numbered, 'capitals': capital_title, 'axis': lambda s: _any(s, X.AXIS), 'caption': caption, 'visual': visual, 'prose': prose, 'narrative': narrative, 'low': lambda s: f"{s} <> '' AND {low_information(s)}"}.items())} FROM l GROUP BY doc_id""",
    ),
    "built_continuations": (
        continuations,
        f"""WITH {_BUILT}, l AS (SELECT doc_id, unnest(string_split(value, chr(10))) AS line, unnest(range(1, len(string_split(value, chr(10))) + 1)) AS line_no FROM f)
        SELECT doc_id, line_no::INT AS line_no FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l)
        WHERE b IS NOT NULL AND NOT regexp_matches(b, '[.!?;:)"'']\\s*$') AND regexp_matches(line, '^\\s*(?:[a-z]|(?:{"|".join(X.LINKS)})\\b)')""",
    ),
    "report_pages": (kept_pages, f"WITH {_KEPT} SELECT path, page_no AS page, grp, md5(body) AS text_md5 FROM kept"),
    "report_blocks": (blocks, f"WITH {_BLOCKS} SELECT path, n::INT AS n, md5(text) AS text_md5, first_page, last_page, heading FROM blocks"),
    "report_records": (
        records,
        f"""WITH {_RECORDS} SELECT stem || '_report_' || lpad(k::VARCHAR, 5, '0') AS id, 'apollo11' AS collection, 'Apollo 11' AS mission, stem || '_report_' || lpad(k::VARCHAR, 5, '0') AS source, 'report' AS source_type, stem || '.txt' AS source_file,
        path AS source_path, stem AS doc_id, 'mission_report' AS report_type, section AS section_path, len(o.stack)::BIGINT AS section_depth, coalesce(top.id, '') AS top_section_id, coalesce(top.title, '') AS top_section_title,
        o.first_page::BIGINT AS page_start, o.last_page::BIGINT AS page_end, md5(CASE WHEN section <> '' THEN section || chr(10) || chr(10) || o.text ELSE o.text END) AS document_md5 FROM rr""",
    ),
}
