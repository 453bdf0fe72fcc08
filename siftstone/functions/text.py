"""Text expressions. Patterns are in Java's syntax; all stay on the JVM side."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\s+"
LETTER, DIGIT, LOWER, UPPER = r"\p{L}", r"\p{Nd}", r"\p{Ll}", r"\p{Lu}"
#: Neither letter, number nor white space.
PUNCT = r"[^\p{L}\p{N}\s]"
WORD = r"[A-Za-z][A-Za-z'-]*"


#: What is left out to count characters of a class: removing runs of others is cheaper than gathering each match.
OTHERS = {LETTER: r"\P{L}+", DIGIT: r"\P{Nd}+", LOWER: r"\P{Ll}+", UPPER: r"\P{Lu}+", PUNCT: r"[\p{L}\p{N}\s]+", r"\S": r"\s+", "[A-Za-z]": "[^A-Za-z]+", "[A-Z]": "[^A-Z]+"}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(c, pattern: str) -> Column:
    if pattern in OTHERS:
        return F.length(F.regexp_replace(col(c), OTHERS[pattern], ""))
    return F.regexp_count(col(c), F.lit(pattern))


def strip(c) -> Column:
    """Both ends without any white space (trim() removes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def newlines(c) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))  # no white space but single spaces is left


def clean_text(c) -> Column:
    """Words broken at a line's end are joined, lines too, white space is collapsed."""
    joined = F.regexp_replace(col(c), r"([A-Za-z]+)-\s*\n\s*([a-z]+)", "$1$2")
    broken = col(c).rlike(r"-\s*\n")  # the pattern tries each letter of each word; most texts have no such hyphen
    return collapse(F.when(broken, joined).otherwise(col(c)))


def clean_block(c) -> Column:
    """Any hyphen before white space and a small letter joins; a page code at the end goes."""
    joined = collapse(F.regexp_replace(col(c), r"([A-Za-z])-\s+([a-z])", "$1$2"))
    return strip(F.regexp_replace(joined, r"\b[A-Z]?\d+-\d+(?:/[A-Z]?\d+-\d+)?\b$", ""))


def replace_all(c, rules: list[tuple[str, str]]) -> Column:
    """A rules table as a fold of replacements, in order."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, col(c))


def first_match(c, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose text c contains."""
    out = F.lit(default)
    for needle, value in reversed(rules):
        out = F.when(col(c).contains(needle), F.lit(value)).otherwise(out)
    return out


# Letters of Unicode 16, which Java may know and Python's tables may not.
NEW_LETTERS = "[\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U00010d50-\U00010d65]"


@cache
def _small() -> tuple[str, str]:
    """Capitals and their small letters, as Python has them, where both are one character."""
    pairs = [(c, x) for c in map(chr, range(0x110000)) if (x := c.lower()) != c and len(x) == 1]
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


@cache
def _folded() -> tuple[dict[str, str], str, dict[str, str], str]:
    """Small letters that fold further: to one character, to several, and a class of a regular expression that has all of each. Such a class
    takes in what lies between near neighbours, so that it is a few ranges; what it has too much folds to itself."""
    further = {c: f for c in map(chr, range(0x80, 0x110000)) if (c.lower() == c or len(c.lower()) > 1) and (f := c.casefold()) != c and c != "ß"}

    def ranges(chars: list[str]) -> str:
        out: list[list[str]] = []
        for c in chars:
            if out and ord(c) - ord(out[-1][1]) < 32:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "[" + "".join(f"{a}-{b}" for a, b in out) + "]"

    one, several = ({c: f for c, f in further.items() if (len(f) == 1) == single} for single in (True, False))
    return one, ranges([*one]), several, ranges([*several])


def casefold(c) -> Column:
    """Python's str.casefold: what differs in case only is equal, ß and ss, and σ and ς, too. Small letters are most of it; the few that fold
    further are looked for first."""
    one, has_one, several, has_several = _folded()
    rules = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in several.items()))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is computed once, however often f reads it
    long = lambda x: F.when(x.rlike(has_several), F.aggregate(rules, x, lambda s, r: F.replace(s, r["k"], r["v"]))).otherwise(x)
    single = lambda x: F.when(x.rlike(has_one), F.translate(x, "".join(one), "".join(one.values()))).otherwise(x)
    more = lambda x: bound(bound(F.replace(x, F.lit("ß"), F.lit("ss")), long), single)
    small = lambda x: F.when(x.rlike(NEW_LETTERS), F.translate(x, *_small())).otherwise(F.lower(x))
    return bound(bound(col(c), small), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), more(x)).otherwise(x))


def alnum_key(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]", "")


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stem(path) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    name = F.regexp_extract(col(path), "([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def first_filled(*cs) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs))


def words(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))


# --- numbers in text ---


def colon_seconds(c) -> Column:
    """MM:SS or HH:MM:SS to seconds; null if out of range or of another shape."""
    return F.when(col(c).rlike(r"^\d+:\d+$"), _pair(col(c))).when(col(c).rlike(r"^\d+:\d+:\d+$"), _triple(col(c)))


def _field(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("long")


def _pair(c: Column) -> Column:
    m, s = (_field(c, r"^(\d+):(\d+)$", i) for i in (1, 2))
    return F.when(s < 60, m * 60 + s)


def _triple(c: Column) -> Column:
    h, m, s = (_field(c, r"^(\d+):(\d+):(\d+)$", i) for i in (1, 2, 3))
    return F.when((m < 60) & (s < 60), (h * 60 + m) * 60 + s)


def elapsed_seconds(c) -> Column:
    """Signed "DDD HH MM SS" to seconds; null if out of range or damaged."""
    pattern = r"^(-?)(\d{2,3})\s+(\d{2})\s+(\d{2})\s+(\d{2})$"
    t = strip(c)
    d, h, m, s = (_field(t, pattern, i) for i in (2, 3, 4, 5))
    total = ((d * 24 + h) * 60 + m) * 60 + s
    return F.when((h < 24) & (m < 60) & (s < 60), F.when(F.regexp_extract(t, pattern, 1) == "-", -total).otherwise(total))


def roman(c) -> Column:
    """Roman numerals up to C; other letters count as 0; null for 0."""
    value = F.create_map(*(F.lit(x) for k, v in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}.items() for x in (k, v)))
    letters = F.reverse(F.split(F.upper(col(c)), ""))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))

    def step(acc: Column, letter: Column) -> Column:
        v = F.coalesce(F.try_element_at(value, letter), F.lit(0))
        return F.struct(F.when(v < acc.top, acc.total - v).otherwise(acc.total + v).alias("total"), F.greatest(acc.top, v).alias("top"))

    return F.nullif(F.aggregate(letters, zero, step).total, F.lit(0))


# --- predicates on lines ---


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


class Line:
    """What predicates ask of a line: its text without white space at the ends (s), how many characters of each kind it has, its runs of letters, and what is already told of it."""

    def __init__(self, s: Column, counts: dict[str, Column], told: dict[str, Column] | None = None):
        self.s, self.counts, self.told = s, counts, told or {}

    def __getattr__(self, kind: str) -> Column:
        if kind in self.__dict__.get("counts", {}):
            return self.counts[kind]
        raise AttributeError(kind)


COUNTED = {"alpha": LETTER, "digit": DIGIT, "punct": PUNCT, "solid": r"\S", "letters": "[A-Za-z]", "capitals": "[A-Z]"}


def line_of(c) -> Line:
    """Of an expression: each count is computed where a predicate asks for it. Of a Line: itself."""
    return c if isinstance(c, Line) else counted(strip(c))


def counted(c) -> Line:
    return Line(col(c), {k: count_of(c, p) for k, p in COUNTED.items()})


def has_words(s: Column, n: int, more: str = "'-") -> Column:
    """At least n words: a letter, then letters and more. Reads only as far as the nth, and by classes that Java tests fast."""
    return s.rlike(rf"^(?:[^A-Za-z]*+[A-Za-z]++(?:[{more}]++[A-Za-z]*+)*+){{{n}}}")


def has_long_words(s: Column, n: int) -> Column:
    """At least n runs of two letters or more."""
    return s.rlike(rf"^(?:(?:[^A-Za-z]++|[A-Za-z](?![A-Za-z]))*+[A-Za-z]{{2,}}+){{{n}}}")


def has_small(s: Column, n: int) -> Column:
    return s.rlike(rf"^(?:\P{{Ll}}*+\p{{Ll}}){{{n}}}")


def mostly_letters(x: Line, of: int, least: int) -> Column:
    """least / of of what isn't white space are letters, in a line that holds some. Most lines have so many of A to Z that neither signs nor white space need be counted."""
    of, least = (F.lit(n).cast("long") for n in (of, least))
    return F.when(x.letters * of >= F.length(x.s) * least, True).otherwise(x.alpha * of >= x.solid * least)


def measured(rows: DataFrame, c) -> tuple[DataFrame, Line]:
    """rows with columns (_s, _letters, _prose, _caption, _visual) that are computed once a line, and the Line that reads them: for several predicates on the same line.
    Other counts are made where a predicate asks for them, which few lines come to."""
    blank_ends = col(c).rlike(r"^\s") | F.right(col(c), F.lit(1)).rlike(r"[\s\x85\u2028\u2029]")  # a line feed of any kind may follow the white space that strip takes
    rows = rows.withColumn("_s", F.when(blank_ends, strip(c)).otherwise(col(c))).withColumn("_letters", count_of("_s", COUNTED["letters"]))
    own = counted("_s")
    own.counts["letters"] = F.col("_letters")
    for name, predicate in (("prose", prose_line), ("caption", visual_caption), ("visual", visual_line)):
        rows = rows.withColumn(f"_{name}", predicate(own))
        own.told[name] = F.col(f"_{name}")
    return rows, own


def prose_line(c) -> Column:
    """At least 32 characters, 6 words, 10 small letters, half of what isn't white space letters. Words and small letters are read only as far as they suffice."""
    x = line_of(c)
    if "prose" in x.told:
        return x.told["prose"]
    return (F.length(x.s) >= 32) & has_words(x.s, 6) & has_small(x.s, 10) & mostly_letters(x, 2, 1)


FIGURE = r"(?i)^\s*(?:FIG|FIGURE)\.?\s+[A-Z0-9]+(?:[-.][A-Z0-9]+)*\b"
TABLE = r"(?i)^\s*TABLE\s+[A-Z0-9]+(?:[-.][A-Z0-9]+)*\b"


def visual_caption(c) -> Column:
    """A figure's or table's caption, and not a sentence that begins with its number."""
    x = line_of(c)
    if "caption" in x.told:
        return x.told["caption"]
    rest = F.regexp_replace(x.s, TABLE + r"\s*", "")
    figure = ~F.regexp_replace(x.s, FIGURE + r"\s*", "").rlike(r"^,\s*[a-z]")
    table = x.s.rlike(TABLE) & ~(rest.rlike(r"^\p{Ll}") & prose_line(x))
    return x.s.rlike(r"(?i)^\s*(?:FIG|TABLE)") & F.when(x.s.rlike(FIGURE), figure).otherwise(table)


def visual_line(c) -> Column:
    """A line of a chart or table: a caption, or mostly numbers and signs, and no prose. A blank line is none."""
    x = line_of(c)
    if "visual" in x.told:
        return x.told["visual"]
    numbers = count_of(x.s, r"\d+(?:\.\d+)?")
    few = (~has_long_words(x.s, 5) & (numbers >= 3)) | (~has_long_words(x.s, 3) & (x.digit >= 2)) | x.s.rlike(r"^(?:\d{1,3}[A-Z]|[A-Z]{1,3}\d{1,3})$")
    dense = (x.s.rlike(DIGIT) & few) | ((x.letters < F.length(x.s) - x.letters) & (x.digit + x.punct > F.greatest(x.alpha, F.lit(3))))
    clock = x.s.rlike("(?i)GROUND") & x.s.rlike(r"(?i)\bGROUND\s+TIME\s+MINUS\s+VEHICLE\s+TIME\b")
    return (x.s != "") & ((~prose_line(x) & (visual_caption(x) | dense)) | clock)


def low_information(c) -> Column:
    # White space at the ends counts for nothing here, so that an expression isn't stripped first.
    x = c if isinstance(c, Line) else counted(c)
    noisy = ~has_long_words(x.s, 5) & (x.digit + x.punct > F.greatest(x.alpha, F.lit(1)))
    if isinstance(c, Line):
        noisy = (x.letters < F.length(x.s) - x.letters) & noisy  # else there are too many letters, and no more need be counted
    return ~x.s.rlike("[A-Za-z]{2}") | noisy


def ends_mid_sentence(c) -> Column:
    return ~col(c).rlike(r"[.!?;:)\"']\s*$")


# The words a continuation begins with.
LINKS = "and or but because which that of in on for with by as from to the this".split()


def starts_like_continuation(c) -> Column:
    return col(c).rlike(rf"^\s*(?:[a-z]|(?:{'|'.join(LINKS)})\b)")


def numbered_heading(c) -> Column:
    """SECTION n, or a number and a title in capitals."""
    s = line_of(c).s
    title = F.regexp_extract(s, r"^\d+(?:\.\d+)*\.?\s+(.+)$", 1)
    letters, upper = count_of(title, "[A-Za-z]"), count_of(title, "[A-Z]")
    noise = count_of(title, DIGIT) + count_of(title, PUNCT)
    titled = title.rlike(r"^\p{Lu}") & (letters > 0) & (ratio(upper, letters) >= 0.6) & (noise <= letters)
    return s.rlike(r"(?i)^SECTION\s+(?:[IVXLCDM]+|\d+)") | F.when(s.rlike(r"^\d"), titled).otherwise(False)


def short_capital_title(c) -> Column:
    x = line_of(c)
    return (x.letters > 0) & (ratio(x.capitals, x.letters) >= 0.85) & ~x.s.rlike(r"\d") & ~has_words(x.s, 9, "/-")


# Units and quantities on the axes of charts.
AXIS = (
    r"(?i)^(?:(?:rms\s+)?amplitude\s*[.,:/-]?\s*arbitrary\s+units?"
    r"|\d+(?:\.\d+)?\s*(?:fps|hz|sec|min|hr|deg|m|km|ft|psi|dbm?)"
    r"|(?:frequency|time|amplitude|altitude|velocity|temperature|pressure|distance|range|latitude|longitude|pitch|yaw|roll)\s*[.,:/-]?\s*"
    r"(?:hz|seconds?|sec|min(?:utes?)?|hours?|hr|degrees?|deg|meters?|m|kilometers?|km|feet|ft|volts?|amps?|psi|dbm?|percent|units?))$"
)


def axis_label(c) -> Column:
    x = line_of(c)
    return (~x.told["prose"] if "prose" in x.told else F.lit(True)) & x.s.rlike(AXIS)  # a label has four words at most, prose six at least


# Words of narrative, and words that hold sentences together.
NARRATIVE = "am is are was were be been being has have had do does did will would can could may might must should which that when while because therefore then".split()
FUNCTION = "a an the to of for by from that which when while because with as this these those".split()


#: A word (WORD) begins at a letter that isn't within another one; hyphens and apostrophes at its end are no part of what it says.
_BEGIN, _END = r"(?i)(?:^|[^A-Za-z'-])['-]*+", r"['-]*+(?![A-Za-z])"


def narrative_line(c) -> Column:
    """A line of prose, also on a page of charts: no caption or visual line, mostly letters, and one of eight cues of running text. Words are looked at where they stand."""
    x = line_of(c)
    s, words = x.s, lambda n: has_words(x.s, n)
    told = s.rlike(f"{_BEGIN}(?:{'|'.join(NARRATIVE)}){_END}")
    function_word = f"{_BEGIN}(?:{'|'.join(FUNCTION)}){_END}"
    inflected = s.rlike(f"{_BEGIN}(?=[A-Za-z][A-Za-z'-]{{4}})[A-Za-z'-]*?(?:ed|ing){_END}")
    hyphened = s.rlike(f"{_BEGIN}[A-Za-z](?:[A-Za-z'-]*[A-Za-z'])?-+[A-Za-z']")
    small = s.rlike(r"^\p{Ll}")
    any_of = lambda *cues: reduce(lambda a, b: a | b, cues)
    # What tells of most lines comes first, what reads all of a line last. No cue stands twice in a condition: Spark computes such a one for every line, asked for or not.
    ended = [s.endswith(end) for end in ".!?;:"]
    late = [told, s.rlike(r"[.!?;:](?:\s|$)"), s.rlike(r"(?i)\bsuch\s+as\b")]
    many = any_of(*ended, small & words(6), s.endswith("-"), *late, inflected, F.regexp_count(s, F.lit(function_word)) >= 4, small & hyphened)
    whole = ~s.rlike(f"(?i)^[^A-Za-z]*+(?=[A-Za-z])[A-Za-z'-]*?ing{_END}") | s.rlike(function_word)
    few = told | (whole & any_of(*ended, s.endswith("-") & words(3), *late[1:]))
    solid = (prose_line(x) | (has_small(s, 7) & words(2))) & mostly_letters(x, 20, 11)
    return solid & ~visual_line(x) & ~visual_caption(x) & F.when(words(4), many).otherwise(few)


# --- names ---

# Labels of speakers that scanning splits.
SPEAKER_ALIASES = {"P AO": "PAO", "P A O": "PAO", "CAP COM": "CAPCOM", "CAPCOMM": "CAPCOM"}
# Labels that scanning damages.
DAMAGED_SPEAKERS = ("TMP", "CMH", "C :", "MP", "CMI'", "LMI", "LMU", "LMI'")
# The collections' missions.
MISSIONS = {"apollo11": "Apollo 11", "apollo13": "Apollo 13", "challenger": "Challenger"}
MISSION_ALIASES = {"sts51l": "challenger"}


def speaker(c) -> Column:
    s = F.upper(collapse(c))
    return reduce(lambda x, kv: F.when(s == kv[0], F.lit(kv[1])).otherwise(x), SPEAKER_ALIASES.items(), s)


def speaker_status(c) -> Column:
    return F.when(speaker(c).isin(*DAMAGED_SPEAKERS), "ocr_alias").otherwise("recognized")


def mission_key(c) -> Column:
    """One of the missions' keys, or null."""
    key = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")
    key = reduce(lambda x, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(x), MISSION_ALIASES.items(), key)
    return F.when(key.isin(*MISSIONS), key)


# What a path tells, first match first.
MISSION_PATHS = [("apollo11", "apollo_11"), ("apollo_11", "apollo_11"), ("apollo13", "apollo_13"), ("apollo_13", "apollo_13"), ("challenger", "challenger")]
TYPE_PATHS = [("transcript", "transcript"), ("textract", "textract_extracted"), ("audio", "audio_transcript"), ("flight_plan", "flight_plan")]
CATEGORY_NAMES = [
    ("pao", "public_affairs_officer"), ("cm", "command_module"), ("tec", "technical"), ("flight_plan", "flight_plan"), ("mission_audio", "mission_audio"),
    ("ntrs", "nasa_archive"), ("19900066485", "technical_report"), ("19710015566", "mission_report"), ("full_text", "complete_document"),
]
