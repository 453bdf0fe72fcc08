"""Predicates read a line only as far as they must, and say what whole counts would."""

import random
import re

from siftstone.functions import text as X
from siftstone.operators import reports as R

PIECES = [
    "the", "was", "Such as", "going", "ended", "re-entry", "don't", "A", "b", "OF", "X/Y", "-", "'", "--", "12", "3.5", "7.8.9", "A1", "35R", ".", "!", ";", ",", "(m/s)", "é", "Éa", "ß", "²", "٣",
    "Figure 2", "FIG. 1-2", "Table 3", "SECTION IV", "4.1 SUMMARY", "GROUND  TIME MINUS VEHICLE TIME", "underground", "time, sec", "12.5 km", "  ", "\t",
]


def made(n):
    r = random.Random(18)
    lines = [r.choice(["", "", " "]) + r.choice([" ", " ", "", "  "]).join(r.choices(PIECES, k=r.choice([1, 2, 3, 4, 6, 9, 14]))) + r.choice(["", "", ".", "-", " ", "\t"]) for _ in range(n)]
    return lines + ["", " ", "\t \t", "1 b " * 250_000, "a" * 300_000, "-'" * 200_000, "word " * 200_000, "12 " * 200_000]


def test_predicates_say_what_whole_counts_say(spark):
    lines = made(4000)
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    rows, x = X.measured(df, "line")
    flags = {"prose": X.prose_line, "visual": X.visual_line, "caption": X.visual_caption, "numbered": X.numbered_heading, "capitals": X.short_capital_title, "axis": X.axis_label, "narrative": X.narrative_line, "low": X.low_information}
    plain = df.select("i", *(p("line").alias(k) for k, p in flags.items())).orderBy("i").collect()
    once = rows.select("i", *(p(x).alias(k) for k, p in flags.items())).orderBy("i").collect()
    held = dict.fromkeys(flags, 0)
    for line, a, b in zip(lines, plain, once, strict=True):
        s = line.strip(" \t")
        want = {"prose": R.prose(s), "visual": R.visual(s), "caption": R.caption(s), "numbered": R.numbered_candidate(s), "capitals": R.capital_title(s), "axis": bool(R.AXIS.match(s)), "narrative": bool(s) and R.narrative(s), "low": R.low_information(s)}
        if "²" in s or "٣" in s or re.match(r"(?i)fig(?:ure)?\b", s):  # Python has other digits, and lets white space stand before a caption's comma
            want = {k: a[k] for k in want}
        for k, v in want.items():
            assert (bool(a[k]), bool(b[k])) == (v, v), (k, line[:80])
            held[k] += v
    assert min(held.values()) > 9, held


def test_a_line_is_counted_once(spark):
    """Of all characters only letters are counted for every line; the rest is for lines that come to it."""
    rows, _ = X.measured(spark.createDataFrame([("x",)], "line string"), "line")
    plan = rows.select("_s", "_letters")._jdf.queryExecution().optimizedPlan().toString()
    assert rows.columns == ["line", "_s", "_letters", "_prose", "_caption", "_visual"]
    assert plan.count("length(regexp_replace(") <= 1
