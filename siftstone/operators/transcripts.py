"""Transcripts to records: one row for each utterance.

A file is one row of whole text, so a fold over its lines runs where the row is (mapInPandas), without a shuffle. Diarized transcripts need
no state beyond "the latest header", so diarized() says them in window functions for line tables; the two others are folds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import ship
from .lines import Line, alternatives, artifact, source_lines, speaker_names

PARSERS = ("auto", "challenger", "apollo", "pao")
FORMATS = {"challenger": "challenger_diarized", "apollo": "apollo_block", "pao": "pao_commentary"}

METADATA = (
    "collection string, mission string, source string, source_type string, source_file string, source_path string, doc_id string, transcript_format string, utterance_index long, "
    "doc_number string, speaker string, speaker_id long, timestamp string, timestamp_sec long, timestamp_valid boolean, segment_marker string, source_line_start long, source_line_end long, "
    "page_start long, page_end long, speaker_label_status string, calendar_date string"
)
RECORD = f"id string, document string, metadata struct<{', '.join(x.replace(' ', ':') for x in METADATA.split(', '))}>"


@dataclass
class Options:
    parser: str = "auto"
    skip: int = 0
    start_page: int | None = None
    mission: str = ""
    collection: str = ""
    implicit: str = "PAO"
    speakers: Sequence[str] = ()

    def __post_init__(self):
        if self.parser not in PARSERS:
            raise ValueError(f"parser must be one of: {', '.join(PARSERS)}")
        self.names = speaker_names(self.speakers)
        self.speaker_line = re.compile(rf"\s*({alternatives(self.names)})\s*", re.I)


def clean(s: str) -> str:
    s = re.sub(r"([A-Za-z]+)-\s*\n\s*([a-z]+)", r"\1\2", s)
    return re.sub(r"\s+", " ", s).strip()


def speaker_of(s: str) -> str:
    s = re.sub(r"\s+", " ", s.strip().upper())
    return X.SPEAKER_ALIASES.get(s, s)


def status_of(s: str) -> str:
    return "ocr_alias" if speaker_of(s) in X.DAMAGED_SPEAKERS else "recognized"


def colon_seconds(t: str) -> int | None:
    parts = [int(x) for x in t.split(":")] if re.fullmatch(r"\d+(:\d+)+", t) else []
    if len(parts) not in (2, 3) or parts[-1] >= 60 or len(parts) == 3 and parts[1] >= 60:
        return None
    return sum(x * 60**i for i, x in enumerate(reversed(parts)))


def elapsed_seconds(t: str) -> int | None:
    m = re.fullmatch(r"(-?)(\d{2,3})\s+(\d{2})\s+(\d{2})\s+(\d{2})", t.strip())
    if not m or int(m[3]) >= 24 or int(m[4]) >= 60 or int(m[5]) >= 60:
        return None
    return (-1 if m[1] else 1) * (((int(m[2]) * 24 + int(m[3])) * 60 + int(m[4])) * 60 + int(m[5]))


@dataclass
class Open:
    """The utterance being gathered."""

    lines: list[Line] = field(default_factory=list)
    start: Line | None = None

    def record(self, **more) -> dict | None:
        text = clean("\n".join(x.text for x in self.lines))
        if not text:
            return None
        pages = [x.page for x in (*([self.start] if self.start else []), *self.lines) if x.page is not None]
        return {
            "document": text,
            "source_line_start": (self.start or self.lines[0]).number,
            "source_line_end": self.lines[-1].number,
            "page_start": min(pages, default=None),
            "page_end": max(pages, default=None),
        } | {k: v for k, v in more.items() if v not in ("", None)}


HEADER = re.compile(r"\[(\d+(?::\d+)+)\]\s+spk_(\d+):\s*(.*)")


def parse_diarized(text: str, o: Options) -> Iterator[dict]:
    """[time] spk_n: text opens an utterance, other lines go on with it; lines before the first header go. Pages follow the lines read last."""
    now: dict | None = None

    def done():
        document = clean("\n".join(now["text"])) if now else ""
        return [{"document": document} | {k: v for k, v in now.items() if k != "text" and v is not None}] if document else []

    for line in source_lines(text, o.speaker_line, o.skip):
        s = line.text.strip()
        if not s or artifact(s, False):
            continue
        if m := HEADER.match(s):
            yield from done()
            seconds = colon_seconds(m[1])
            now = {
                "text": [m[3]], "timestamp": m[1], "timestamp_sec": seconds, "timestamp_valid": seconds is not None, "speaker": f"spk_{int(m[2])}", "speaker_id": int(m[2]),
                "source_line_start": line.number, "source_line_end": line.number, "page_start": line.page, "page_end": line.page,
            }
        elif now:
            now["text"].append(s)
            now["source_line_end"] = line.number
            if line.page is not None:
                now["page_start"] = line.page if now["page_start"] is None else now["page_start"]
                now["page_end"] = line.page
    yield from done()


# How time stamps are written, who may be glued to one, and how words begin behind it.
TIME = r"-?\d{2,3}\s+\d{2}\s+\d{2}\s+\d{2}"
CREW = "CDR|CMP|LMP|CC"
SAID = r"[A-Z][a-z]|I(?:\s|')|\.\.\."


def parse_blocks(text: str, o: Options) -> Iterator[dict]:
    """Time stamps and speakers on lines of their own or run together; the first rule that a line fits decides."""
    names = alternatives(o.names)
    named = alternatives([n for n in o.names if len(re.sub("[^A-Za-z]", "", n)) >= 2])
    # (pattern, whether only a line that awaits a speaker fits); groups: time, who, said
    rules = [
        (re.compile(rf"\s*(?P<time>{TIME})\s+(?P<who>{names})(?:\s+(?P<said>.+))?\s*", re.I), False),
        (re.compile(rf"\s*(?P<time>{TIME})(?P<crew>{CREW})\s*(?P<said>(?:{SAID}).*)\s*"), False),
        (re.compile(rf"\s*(?P<time>{TIME})(?P<crew>{CREW})\s*"), False),
        (re.compile(rf"\s*(?P<time>{TIME})\s*"), False),
        (re.compile(r"\s*(?P<time>(?=[A-Z0-9%?]*[A-Z%?])[A-Z0-9%?]{2,3}\s+\d{2}\s+\d{2}\s+\d{2})\s*", re.I), False),
        (re.compile(r"(?P<crew>PRESIDENT NIXON)\s+(?P<said>.+)"), False),
        (re.compile(rf"\s*(?P<who>{names})\s*", re.I), False),
        (re.compile(rf"(?P<crew>{CREW})(?P<said>(?:{SAID}|[A-Z]{{2,}}[A-Z .'-]*$).*)"), True),
        (re.compile(rf"(?P<who>{named})\s+(?P<said>\S.*)"), True),
    ]
    time, who, status, awaiting = "", "", "", False
    seconds: int | None = None
    now, digits = Open(), []

    def done():
        nonlocal now
        r = now.record(speaker=who, timestamp=time, timestamp_sec=seconds, timestamp_valid=seconds is not None if time else None, speaker_label_status=status) if who and now.lines else None
        now = Open()
        return [r] if r else []

    def at_time(t: str, line: Line):
        nonlocal time, seconds, who, status, awaiting
        out = done()
        time = re.sub(r"\s+", " ", t.strip())
        seconds, who, status, awaiting, now.start = elapsed_seconds(time), "", "", True, line
        return out

    for line in source_lines(text, o.speaker_line, o.skip, o.start_page):
        s = line.text.strip()
        if not s or artifact(s, False):
            continue
        if re.fullmatch(r"\d{2}", s) and not who:
            digits.append(line)
            if len(digits) == 4:
                yield from at_time(" ".join(x.text.strip() for x in digits), digits[0])
                digits = []
            continue
        digits = []
        m = next((m for p, waits in rules if (awaiting or not waits) and (m := p.fullmatch(s))), None)
        if m is None:
            if who:
                now.lines.append(line._replace(text=s))
            continue
        g = m.groupdict()
        if g.get("time"):
            yield from at_time(g["time"], line)
        if speaker := g.get("who") or g.get("crew"):
            if who or now.lines:
                yield from done()
            who, status, awaiting = speaker_of(speaker), status_of(speaker) if g.get("who") else "recognized", False
            now.start = now.start or line
        if g.get("said"):
            now.lines.append(line._replace(text=g["said"]))
    yield from done()


# Dates and headers of commentary.
DATE = re.compile(r"\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?")
SEGMENT = re.compile(r"(?:APOLLO\s+\d+\s+(?:MISSION\s+COMMENTARY|STATUS\s+REPORT|SPACECRAFT\s+COMMENTARY).*|CDT\b.*GET\b.*|MC\s+\d+)", re.I)
# Speakers that commentary names before their words.
NAMED = ("PRESIDENT NIXON", "COMM TECH", "CAP COM", "CAPCOM", "HORNET", "SWIM 1", "MCC", "IWO")
SPOKEN = re.compile(rf"(?P<who>{alternatives(NAMED)})(?:\s*[:\-]\s*|\s+)(?P<said>\S.*)")


def parse_commentary(text: str, o: Options) -> Iterator[dict]:
    """Blank lines, dates, segment headers and speakers' lines end an utterance; dates and segments hold until the next; a header gives the floor back to the implicit speaker.
    A start that no line followed stays for the next utterance."""
    who = segment = date = ""
    now, boundary = Open(), True

    def done():
        nonlocal now
        if not now.lines:
            return []
        r = now.record(speaker=speaker_of(who or o.implicit or "PAO"), segment_marker=segment, calendar_date=date)
        now = Open()
        return [r] if r else []

    for line in source_lines(text, o.speaker_line, o.skip, o.start_page):
        s = line.text.strip()
        if not s or DATE.fullmatch(s) or SEGMENT.fullmatch(s):
            yield from done()
            boundary = True
            if s and DATE.fullmatch(s):
                date = s
            elif s:
                segment, who = s, o.implicit
            continue
        if artifact(s, True):
            continue
        if m := o.speaker_line.fullmatch(s):
            yield from done()
            who, now.start, boundary = speaker_of(m[1]), line, False
            continue
        if boundary and (m := SPOKEN.fullmatch(s)):
            yield from done()
            who, now.start, s = speaker_of(m["who"]), line, m["said"]
        who = who or o.implicit
        now.start = now.start or line
        now.lines.append(line._replace(text=s))
        boundary = False
    yield from done()


PARSE: dict[str, Callable] = {"challenger": parse_diarized, "apollo": parse_blocks, "pao": parse_commentary}


def detect(text: str, name: str) -> str:
    """By the diarized header, then the file's name, then the head of the text: its first 5,000 characters, which is the rule and no shortcut."""
    if re.search(r"(?m)^\[\d+(?::\d+)+\]\s+spk_\d+:", text):
        return "challenger"
    if any(x in name.lower() for x in ("pao", "commentary")) or re.search(r"(?i)MISSION\s+COMMENTARY|STATUS\s+REPORT|SPACECRAFT\s+COMMENTARY", text[:5000]):
        return "pao"
    return "apollo"


def file_metadata(path: str, o: Options, kind: str) -> dict:
    name = path.rsplit("/", 1)[-1]
    in_memory = path.startswith("memory://")
    number, flight = re.match(r"(\d+)-", name), re.search(r"(STS-\d+[A-Z]?)", name)
    folder = "" if in_memory or "/" not in path else path.rsplit("/", 2)[-2]
    stem = re.sub(r"(?<=.)\.[^.]*$", "", name)
    return {"collection": o.collection or folder, "mission": o.mission or (flight[1] if flight else ""), "source_type": kind, "source_file": name, "source_path": path, "doc_id": stem} | ({"doc_number": number[1]} if number else {})


def parse_transcript(path: str, text: str, o: Options) -> list[dict]:
    """Records of one file: id, document, metadata; utterances are numbered from 0 without gaps."""
    name = path.rsplit("/", 1)[-1]
    kind = detect(text, name) if o.parser == "auto" else o.parser
    own = file_metadata(path, o, "transcript") | {"transcript_format": FORMATS[kind]}
    out = []
    for i, r in enumerate(PARSE[kind](text, o)):
        key = f"{own['doc_id']}_utt_{i:06d}"
        out.append({"id": key, "document": r.pop("document"), "metadata": own | {"utterance_index": i, "source": key} | r})
    return out


def transcript_records(files: DataFrame, options: Options | None = None) -> DataFrame:
    """files(path, value): one row for each whole file. Gives (id, document, metadata)."""
    ship(files.sparkSession)
    o = options or Options()
    fields = [x.split()[0] for x in METADATA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["value"], strict=True):
                rows = parse_transcript(path, text or "", o)
                yield pd.DataFrame({"id": [r["id"] for r in rows], "document": [r["document"] for r in rows], "metadata": [{f: r["metadata"].get(f) for f in fields} for r in rows]}, dtype=object)  # of a file without records, too

    return files.select("path", "value").mapInPandas(run, RECORD)


def diarized(lines: DataFrame, path: str = "path", number: str = "line_no", text: str = "line") -> DataFrame:
    """The diarized rule as gaps and islands over a line table: (path, utterance_index, timestamp, timestamp_sec, speaker_id, line_start, line_end, document)."""
    s = X.strip(text)
    pattern = r"^\[(\d+(?::\d+)+)\]\s+spk_(\d+):\s*(.*)$"
    by = Window.partitionBy(path).orderBy(number)
    head = lines.where(s != "").withColumn("_s", s).withColumn("_head", F.col("_s").rlike(pattern))
    island = head.withColumn("_island", F.sum(F.col("_head").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_island > 0")
    said = F.when(F.col("_head"), F.regexp_extract("_s", pattern, 3)).otherwise(F.col("_s"))
    take = lambda i: F.max(F.when(F.col("_head"), F.regexp_extract("_s", pattern, i)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), said.alias("t")))), lambda x: x.t)
    told = island.groupBy(path, "_island").agg(take(1).alias("timestamp"), take(2).cast("long").alias("speaker_id"), F.min(number).alias("line_start"), F.max(number).alias("line_end"), X.clean_text(F.array_join(parts, "\n")).alias("document"))
    kept = told.where("document <> ''")
    return kept.select(path, (F.row_number().over(Window.partitionBy(path).orderBy("_island")) - 1).alias("utterance_index"), "timestamp", X.colon_seconds("timestamp").alias("timestamp_sec"), "speaker_id", "line_start", "line_end", "document")


def parser_of(text: Column, name: Column) -> Column:
    """detect() as an expression."""
    commentary = r"(?i)MISSION\s+COMMENTARY|STATUS\s+REPORT|SPACECRAFT\s+COMMENTARY"
    return F.when(text.rlike(r"(?m)^\[\d+(?::\d+)+\]\s+spk_\d+:"), "challenger").when(F.lower(name).rlike("pao|commentary") | F.substring(text, 1, 5000).rlike(commentary), "pao").otherwise("apollo")
