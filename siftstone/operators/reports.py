"""Page-structured reports to records: pages, narrative regions, blocks, sections.

A report is one row of whole text; its stages depend on each other's state (regions skip, blocks merge, sections stack), so one fold over the pages runs
where the row is (mapInPandas), without a shuffle. The line predicates are those of functions.text, as plain functions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from ..functions import text as X
from ..session import map_rows
from .transcripts import file_metadata

METADATA = (
    "collection string, mission string, source string, source_type string, source_file string, source_path string, doc_id string, report_type string, section_path string, "
    "section_depth long, top_section_id string, top_section_title string, page_start long, page_end long"
)
RECORD = f"id string, document string, metadata struct<{', '.join(x.replace(' ', ':') for x in METADATA.split(', '))}>"


@dataclass
class Options:
    start_page: int = 1
    stop_heading: str | None = None
    mission: str = ""
    collection: str = ""
    report_type: str = ""
    drop_keywords: Sequence[str] = ()
    figures: bool = True
    tables: bool = True
    with_section: bool = True


@dataclass(frozen=True)
class Counts:
    """Kinds of characters of a line."""

    alpha: int
    digit: int
    punct: int
    lower: int
    solid: int

    @classmethod
    def of(cls, s: str) -> Counts:
        return _counts(s) if len(s) < 500 else _counts.__wrapped__(s)

    @property
    def noise(self) -> int:
        return self.digit + self.punct


@lru_cache(4096)
def kind_of(ch: str) -> tuple[bool, bool, bool, bool, bool]:
    """alpha, digit, punct, lower, solid."""
    solid = not ch.isspace()
    return ch.isalpha(), ch.isdigit(), solid and not ch.isalnum(), ch.islower(), solid


#: Each ASCII character's kind as a letter: capital, small, digit, white space, other.
KIND = bytes(ord("U" if c.isupper() else "L" if c.islower() else "D" if c.isdigit() else "S" if c.isspace() else "P") for c in map(chr, range(128))) + bytes(128)
BEYOND = re.compile(r"[^\x00-\x7f]")


@lru_cache(4096)
def _counts(s: str) -> Counts:
    """A line is asked for several times in a row."""
    kinds = s.encode("ascii", "ignore").translate(KIND)
    capital, lower, digit, punct = map(kinds.count, (b"U", b"L", b"D", b"P"))
    plain = capital + lower, digit, punct, lower, capital + lower + digit + punct
    if s.isascii():
        return Counts(*plain)
    others = [kind_of(ch) for ch in BEYOND.findall(s)]
    return Counts(*(n + sum(k[i] for k in others) for i, n in enumerate(plain)))


def capitals(s: str) -> float:
    kinds = s.encode("ascii", "ignore").translate(KIND)
    n = kinds.count(b"U")
    return n / (n + kinds.count(b"L")) if n else 0.0


FIGURE, TABLE, AXIS = re.compile(X.FIGURE), re.compile(X.TABLE), re.compile(X.AXIS)
WORDS = re.compile(X.WORD)
LONG_WORD = re.compile("[A-Za-z]{2,}")
GROUND_TIME = re.compile(r"(?i)\bGROUND\s+TIME\s+MINUS\s+VEHICLE\s+TIME\b")
NUMBERS = re.compile(r"\d+(?:\.\d+)?")
LABEL = re.compile(r"\d{1,3}[A-Z]|[A-Z]{1,3}\d{1,3}")
CLAUSE, SENTENCE_END, SUCH_AS = re.compile(r"\s*,\s*[a-z]"), re.compile(r"[.!?;:](?:\s|$)"), re.compile(r"(?i)\bsuch\s+as\b")
BLANK_PAGE = re.compile(r"(?i)\bTHIS PAGE INTENTIONALLY LEFT BLANK\b")
PAGE_CODE = r"[A-Z]?\d+-\d+(?:/[A-Z]?\d+-\d+)?"


def prose(s: str) -> bool:
    c = Counts.of(s)
    return len(s) >= 32 and len(WORDS.findall(s)) >= 6 and c.lower >= 10 and c.alpha / c.solid >= 0.5


def caption(s: str) -> bool:
    if m := FIGURE.match(s):
        return not CLAUSE.match(s[m.end() :])
    m = TABLE.match(s)
    return bool(m) and not (s[m.end() :].strip()[:1].islower() and prose(s))


def visual(s: str) -> bool:
    if "ground" in s.casefold() and GROUND_TIME.search(s):
        return True
    if not s or prose(s):
        return False
    c, n = Counts.of(s), len(LONG_WORD.findall(s))
    return caption(s) or c.noise > max(c.alpha, 3) or n <= 4 and len(NUMBERS.findall(s)) >= 3 or n <= 2 and c.digit >= 2 or bool(LABEL.fullmatch(s))


def table_body(lines: list[str]) -> bool:
    """lines: stripped, not blank."""
    if len(lines) < 8:
        return not lines
    counts = [Counts.of(s) for s in lines]
    small = sum(len(s) <= 28 or c.digit > c.alpha for s, c in zip(lines, counts, strict=True))
    numeric = sum(c.noise > c.alpha for c in counts)
    return sum(map(prose, lines)) < 2 and (small / len(lines) > 0.72 or numeric / len(lines) > 0.55)


def keyword_hint(page: str, keywords: Sequence[str]) -> bool:
    whole = re.sub(r"\s+", " ", page).upper()
    for k in (re.sub(r"\s+", " ", k.strip()).upper() for k in keywords):
        if k in ("FIG", "FIG."):
            found = re.search(r"(?m)^\s*FIG(?:\.|URE)?\b", page.upper())
        else:
            found = k and (re.search(rf"\b{re.escape(k)}\b", whole) if len(k) <= 5 and " " not in k else k in whole)
        if found:
            return True
    return False


# Page numbers before the first chapter.
NUMERALS = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx xxi xxii xxiii xxiv xxv xxvi xxvii xxviii".split()
# Page furniture, as whole lines.
HEADERS = (
    r"NASA\s+SP-\d+", r"APOLLO\s+\d+\s+MISSION\s+REPORT", "NATIONAL AERONAUTICS AND SPACE ADMINISTRATION", "MANNED SPACECRAFT CENTER", r"HOUSTON,?\s*TEXAS",
    r"GEORGE C\.?\s*MARSHALL SPACE FLIGHT CENTER", r"MPR[-– ]*SAT[-– ]*FE[-– ]*\d+[-– ]*\d+", "SATURN V LAUNCH VEHICLE FLIGHT EVALUATION REPORT.*", r"APOLLO\s+\d+\s+MISSION",
    r"APOLLO\s+\d+\s+FLIGHT PLAN", r"AS-\d+/CSM-\d+/LM-\d+", "Revision A", r"MSC\s+FORM\s+\d+[A-Z]?",
)
#: A word of each header, in small letters, without which it can't stand in a page; none has an i, whose forms fold in more than one way.
HEADER_WORDS = ("nasa", "apollo", "aeronaut", "manned", "houston", "george", "mpr", "saturn", "apollo", "apollo", "as-", "rev", "msc")
FURNITURE = [(r"\A\s*\d+\s*\n+", "m"), (r"\n+\s*\d+\s*\Z", "m"), (rf"^\s*{PAGE_CODE}\s*$", "m"), (rf"^\s*(?:{'|'.join(NUMERALS)})\s*$", "mi"), *((rf"^\s*{h}\s*$", "mi") for h in HEADERS), (r"^\s*#{2,}\s*$", "m")]
PROBES = ("", "", "-", "", *HEADER_WORDS, "##")
FURNITURE = [re.compile(p, re.M | (re.I if "i" in f else 0)) for p, f in FURNITURE]


def bare_page(page: str) -> str:
    folded = page.casefold()
    for word, p in zip(PROBES, FURNITURE, strict=True):
        if word in folded:
            page = p.sub("", page)
    return page.strip()


def pages_of(text: str) -> list[tuple[int, str]]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = re.split(r"(?m)^---\s*PAGE\s*(\d+)\s*---\s*$", text)
    return [(int(n), p) for n, p in zip(parts[1::2], parts[2::2], strict=True)] if len(parts) > 1 else [(1, text)]


# --- narrative regions ---

NARRATIVE, FUNCTION = frozenset(X.NARRATIVE), frozenset(X.FUNCTION)


SECTION = re.compile(r"(?i)SECTION\s+(?:[IVXLCDM]+|\d+)")
NUMBERED = re.compile(r"\d+(?:\.\d+)*\.?\s+(.+)$")
LETTER = re.compile("[A-Za-z]")


def numbered_candidate(s: str) -> bool:
    if SECTION.match(s):
        return True
    m = NUMBERED.match(s)
    if not m:
        return False
    title = m[1].strip()
    letters = len(LETTER.findall(title))
    return title[:1].isupper() and letters > 0 and capitals(title) >= 0.6 and Counts.of(title).noise <= letters


def capital_title(s: str) -> bool:
    return 1 <= len(re.findall("[A-Za-z][A-Za-z/-]*", s)) <= 8 and not re.search(r"\d", s) and capitals(s) >= 0.85


def narrative(s: str) -> bool:
    c, words = Counts.of(s), WORDS.findall(s)
    if visual(s) or caption(s) or len(words) < 2 or c.alpha / max(1, c.solid) < 0.55 or c.lower < 7:
        return False
    plain = [w.casefold().strip("-'") for w in words]
    told = not NARRATIVE.isdisjoint(plain)
    held = sum(w in FUNCTION for w in plain)
    if len(words) <= 3 and plain[0].endswith("ing") and not told and not held:
        return False
    n, small = len(words), s[0].islower()
    cues = (
        told,
        n >= 4 and any(len(w) >= 5 and p.endswith(("ed", "ing")) for w, p in zip(words, plain, strict=True)),
        SENTENCE_END.search(s),
        s.endswith("-") and n >= 3,
        held >= 4,
        SUCH_AS.search(s),
        small and n >= 6,
        small and n >= 4 and any("-" in w.strip("-") for w in words),
    )
    return any(cues)


def section_number(heading: str) -> str:
    m = re.match(r"(?i)SECTION\s+(\d+)\b", heading)
    return m[1] if m else ""


def regions(page: str, patience: int = 8, least: int = 60) -> list[str]:
    """Runs of narrative lines. Visual lines between them are skipped, up to patience in a row; blank lines and captions end a run; a heading waits for prose and
    comes before it. Runs need least letters outside headings."""
    out: list[str] = []
    run: list[str] = []
    heading, skipped = "", 0

    def done():
        nonlocal run, heading, skipped
        if sum(Counts.of(x).alpha for x in run if not numbered_candidate(x)) >= least:
            out.append("\n".join(run).strip())
        run, heading, skipped = [], "", 0

    for s in map(str.strip, page.splitlines()):
        number = section_number(heading)
        if not s:
            done()
        elif number and "\n" not in heading and capital_title(s):
            heading += f"\n{s}"
        elif caption(s):
            done()
        elif numbered_candidate(s):
            m = re.match(r"(\d+)(?:\.\d+)*", s)
            if number and m and m[1] == number:
                heading += f"\n{s}"
            else:
                done()
                heading = s
        elif narrative(s):
            run += [heading] * (not run and bool(heading)) + [s]
            skipped = 0
        elif run:
            skipped += 1
            if skipped > patience:
                done()
    done()
    return out


def kept_pages(text: str, o: Options) -> Iterator[tuple[int, str, int]]:
    """(page, text, group): whole pages in a row share a group, a region has its own."""
    group, whole_before = 0, None
    stop = re.compile(rf"(?mi)^\s*{re.escape(o.stop_heading)}\s*$") if o.stop_heading else None
    for number, page in pages_of(text):
        if number < o.start_page:
            continue
        end = stop.search(page) if stop else None
        page = bare_page(page[: end.start()] if end else page)
        lines = [x.strip() for x in page.splitlines() if x.strip()]
        mixed = any(o.figures and FIGURE.match(x) or o.tables and TABLE.match(x) and caption(x) for x in lines)
        if not page:
            whole_before = None
        elif mixed or table_body(lines) or keyword_hint(page, o.drop_keywords) and sum(map(visual, lines)) / len(lines) >= 0.35:
            for region in regions(page):
                group += 1
                yield number, region, group
            whole_before = None
        else:
            group += whole_before is None or number != whole_before + 1
            yield number, page, group
            whole_before = number
        if end:
            return


# --- headings ---


@dataclass
class Heading:
    title: str
    id: str = ""
    pending: bool = False

    @property
    def label(self) -> str:
        return f"SECTION {self.id}" if self.pending else f"{self.id}. {self.title}" if self.id else self.title

    @property
    def appendix(self) -> bool:
        return bool(re.fullmatch(r"(?i)APPENDIX(?:\s+[A-Z0-9]+)?", self.title))


def roman(s: str) -> int | None:
    total = top = 0
    for v in ({"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}.get(c, 0) for c in reversed(s.upper())):
        total, top = total + (-v if v < top else v), max(top, v)
    return total or None


# One-word titles that are headings, and titles that are none.
ONE_WORD = frozenset("INTRODUCTION SUMMARY CONCLUSIONS REFERENCES APPENDIX APPROVAL CONTENTS TRAJECTORY STRUCTURES SEPARATION".split())
NO_HEADINGS = frozenset(("TABLE OF CONTENTS", "LIST OF ILLUSTRATIONS", "LIST OF TABLES", "ABBREVIATIONS", "SYMBOLS AND ABBREVIATIONS"))
DATE_TITLE = re.compile(r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{2,4}\s+\d{3,4}\s+(?:UTC|GMT|[ECMP][SD]T)")


ITEM = re.compile(r"\([A-Za-z0-9]+\)\s+")
SECTION_HEADING = re.compile(r"(?i)SECTION\s+([IVXLCDM]+|\d+)\s*(?:[-–]+\s*(.+))?")
NUMBERED_HEADING = re.compile(r"(\d+(?:\.\d+)*)\.?\s+(.+)")
TITLE_START = re.compile(r"(?:[-–]\s*)?[A-Za-z]")
TITLE_WORDS = re.compile(r"[A-Za-z][A-Za-z'/-]*")
NO_TITLE = re.compile(r"[.;,]$|[\d()=+]")


def heading_of(line: str) -> Heading | None:
    s = line.strip()
    return _heading_of(s) if 0 < len(s) <= 140 else None


@lru_cache(4096)
def _heading_of(s: str) -> Heading | None:
    """Of a line without white space around it, which is asked for several times in a row; nobody changes a heading."""
    if AXIS.match(s) or BLANK_PAGE.search(s) or ITEM.match(s):
        return None
    if m := SECTION_HEADING.fullmatch(s):
        title = (m[2] or "").strip()
        return Heading(title, str(roman(m[1])) if m[1].isalpha() else m[1], not title)
    if m := NUMBERED_HEADING.fullmatch(s):
        title, c = m[2].strip(), Counts.of(m[2])
        fits = not DATE_TITLE.fullmatch(title) and TITLE_START.match(title) and c.noise <= c.alpha and capitals(title) >= 0.6 and len(title) <= 130
        return Heading(title, m[1]) if fits else None
    words = TITLE_WORDS.findall(s)
    if NO_TITLE.search(s) or not 1 <= len(words) <= 10 or len(words) == 1 and s.upper() not in ONE_WORD or not next((c for c in s if c.isalpha()), "A").isupper():
        return None
    shouted = capitals(s) >= 0.82 and len(words) <= 8
    titled = len(words) <= 5 and all(w[0].isupper() for w in words)
    return Heading(s) if (shouted or titled) and s.upper() not in NO_HEADINGS else None


# --- blocks ---


@dataclass
class Block:
    text: str
    first: int
    last: int
    group: int
    heading: bool = False


HYPHEN, LAST_CODE = re.compile(r"([A-Za-z])-\s+([a-z])"), re.compile(rf"\b{PAGE_CODE}\b$")


def clean(s: str) -> str:
    s = re.sub(r"\s+", " ", HYPHEN.sub(r"\1\2", s) if "-" in s else s).strip()
    return (LAST_CODE.sub("", s) if "-" in s else s).strip()


def salvage(s: str) -> str:
    """The narrative part of a block: itself if it isn't noisy, else from a note's marker or the first word on from which it reads as prose, else nothing."""
    c = Counts.of(s)
    if not c.alpha:
        return ""

    mark = re.search(r"(?i)\bNOTE:\s*|(?<!\*)\*{1,2}(?=[A-Za-z])", s)
    if mark and c.noise / c.alpha >= 0.40:
        t = s[mark.start() :].lstrip("* ").strip()
        k = Counts.of(t)
        if len(LONG_WORD.findall(t)) >= 4 and k.alpha and k.noise / k.alpha <= 0.55:
            return t
    if c.noise / c.alpha <= 0.60:
        return s
    # Counts of every suffix at once: linear in the block, however many words it has.
    kinds = [kind_of(ch) for ch in reversed(s)]
    alpha, noise, lower = (list(accumulate(x, initial=0)) for x in ((k[0] for k in kinds), (k[1] or k[2] for k in kinds), (k[3] for k in kinds)))
    long = [m.start() for m in LONG_WORD.finditer(s)]
    for m in re.finditer(r"\b[A-Za-z][A-Za-z'-]{2,}\b", s):
        n = len(s) - m.start()
        if len(long) - bisect_left(long, m.start()) >= 8 and lower[n] >= 15 and alpha[n] and noise[n] / alpha[n] <= 0.45:
            return s[m.start() :].strip()
    return ""


def low_information(s: str) -> bool:
    c, n = Counts.of(s), len(LONG_WORD.findall(s))
    return n == 0 or n < 5 and c.noise > max(c.alpha, 1)


CODE_LINE = re.compile(rf"{PAGE_CODE}|\d+")


def raw_blocks(pages: Iterator[tuple[int, str, int]]) -> Iterator[Block]:
    """Headings by themselves; other lines run on until a blank line, the end of a page's text or another group."""
    for number, page, group in pages:
        held: list[str] = []
        for s in (*map(str.strip, page.splitlines()), ""):
            heading = bool(s) and heading_of(s) is not None
            skip = s and (CODE_LINE.fullmatch(s) or AXIS.match(s))
            if (not s or heading and not skip) and held:
                yield Block(" ".join(held), number, number, group)
                held = []
            if s and not skip:
                if heading:
                    yield Block(s, number, number, group)
                else:
                    held.append(s)


CONTINUES = re.compile(rf"(?:[a-z]|(?:{'|'.join(X.LINKS)})\b)")


def blocks_of(pages: Iterator[tuple[int, str, int]]) -> list[Block]:
    """Cleaned blocks; one that ends in the middle of a sentence takes in the next if that goes on with it and is of the same group or page. It keeps its own group."""
    out: list[Block] = []
    for b in raw_blocks(pages):
        b.text = clean(b.text)
        b.heading = heading_of(b.text) is not None
        if BLANK_PAGE.search(b.text):
            continue
        if not b.heading:
            b.text = salvage(b.text)
            b.heading = heading_of(b.text) is not None
        if not b.text or not b.heading and low_information(b.text):
            continue
        p = out[-1] if out else None
        if p and not p.heading and not b.heading and (p.group == b.group or p.last == b.first) and not re.search(r"[.!?;:)\"']\s*$", p.text) and CONTINUES.match(b.text):
            p.text, p.first, p.last = clean(f"{p.text} {b.text}"), min(p.first, b.first), max(p.last, b.last)
            p.heading = heading_of(p.text) is not None
        else:
            out.append(b)
    return out


@dataclass
class Sections:
    """The headings above a block."""

    stack: list[Heading] = field(default_factory=list)
    pending: Heading | None = None

    def enter(self, h: Heading) -> None:
        waiting, self.pending = self.pending, None
        if h.pending:
            self.pending = h
        elif waiting and not h.id:
            self.stack = [Heading(h.title, waiting.id)]
        elif h.id:
            self.stack = [*self.stack[: h.id.count(".")], h]
        elif h.appendix:
            self.stack = [h]
        elif self.stack and self.stack[0].appendix:
            self.stack = [self.stack[0], h]
        else:
            depth = max((i + 1 for i, x in enumerate(self.stack) if x.id), default=0)
            self.stack = [*self.stack[:depth], h]


def parse_report(path: str, text: str, o: Options) -> list[dict]:
    """Records of one file: id, document, metadata; numbered from 0 without gaps."""
    own = file_metadata(path, o, "report")
    own.pop("doc_number", None)
    own["collection"] = o.collection
    own["mission"] = o.mission
    sections, out = Sections(), []
    for b in blocks_of(kept_pages(text, o)):
        if h := heading_of(b.text):
            sections.enter(h)
            continue
        sections.pending = None
        where = " > ".join(h.label for h in sections.stack)
        top = next((h for h in sections.stack if h.id), Heading(""))
        key = f"{own['doc_id']}_report_{len(out):05d}"
        document = f"{where}\n\n{b.text}".strip() if o.with_section and where else b.text
        more = {"report_type": o.report_type, "section_path": where, "section_depth": len(sections.stack), "top_section_id": top.id, "top_section_title": top.title, "page_start": b.first, "page_end": b.last}
        out.append({"id": key, "document": document, "metadata": own | more | {"source": key}})
    return out


def report_records(files: DataFrame, options: Options | None = None) -> DataFrame:
    """files(path, value): one row for each whole file. Gives (id, document, metadata)."""
    o = options or Options()
    fields = [x.split()[0] for x in METADATA.split(", ")]

    def rows(path: str, text: str | None) -> Iterator[tuple]:
        for r in parse_report(path, text or "", o):
            yield r["id"], r["document"], {f: r["metadata"].get(f) for f in fields}

    return map_rows(files.select("path", "value"), RECORD, rows)
