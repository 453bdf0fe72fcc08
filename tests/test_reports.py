"""Reports: fixtures of our own for each rule; line predicates as functions and as expressions agree."""

import pytest

from siftstone.functions import text as X
from siftstone.operators import reports as R
from siftstone.operators import validate
from siftstone.sources import files

PROSE = "The crew was asked to repeat the measurement because the first one had failed."
MORE = "A second reading was then taken by the ground station and it agreed with the plan of the day."


def parse(text, **options):
    return R.parse_report("memory://r.txt", text, R.Options(**options))


def texts(text, **options):
    return [r["document"] for r in parse(text, **options)]


def test_caption_ends_a_region_and_chart_noise_goes():
    got = texts(f"RESULTS OF TEST\n{PROSE}\nFIGURE 3-1. RATES\n10 20 30\n40.5 60.1\n{MORE}")
    assert [x.split("\n\n")[-1] for x in got] == [PROSE, MORE]
    assert texts("FIGURE 1-1. ALTITUDE\n10 20 30\nPITCH DEG\n3.5 4.5") == []


def test_pages_merge_only_without_a_gap():
    cut = PROSE.removesuffix(" because the first one had failed.")
    rows = parse(f"--- PAGE 1 ---\n{cut}\n--- PAGE 2 ---\nbecause the first one had failed.")
    assert [(r["document"], r["metadata"]["page_start"], r["metadata"]["page_end"]) for r in rows] == [(PROSE, 1, 2)]
    rows = parse(f"--- PAGE 1 ---\n{cut}\n--- PAGE 2 ---\nFIGURE 2-2. X\n1 2 3\n--- PAGE 3 ---\nbecause the first one had failed again and again.")
    assert [(r["metadata"]["page_start"], r["metadata"]["page_end"]) for r in rows] == [(1, 1), (3, 3)]


def test_start_page_stop_heading_and_blank_pages():
    text = f"--- PAGE 1 ---\nskipped words of the cover page\n--- PAGE 2 ---\n{PROSE}\n--- PAGE 3 ---\nTHIS PAGE INTENTIONALLY LEFT BLANK\n--- PAGE 4 ---\n{MORE}\nReferences\ntrailer\n--- PAGE 5 ---\nnever seen at all"
    assert texts(text, start_page=2, stop_heading="REFERENCES") == [PROSE, MORE]


def test_sections():
    text = f"SECTION IV\nFLIGHT PATH\n\n4.1 SUMMARY\n{PROSE}\n\n4.2.1 DETAIL\n{MORE}\n\nWIND DATA\n{PROSE}\n\nAPPENDIX B\n{MORE}\n\nAPPROVAL\n{PROSE}"
    m = [r["metadata"] for r in parse(text)]
    assert [x["section_path"] for x in m] == ["4. FLIGHT PATH > 4.1. SUMMARY", "4. FLIGHT PATH > 4.1. SUMMARY > 4.2.1. DETAIL", "4. FLIGHT PATH > 4.1. SUMMARY > 4.2.1. DETAIL > WIND DATA", "APPENDIX B", "APPENDIX B > APPROVAL"]
    assert [(x["top_section_id"], x["section_depth"]) for x in m][:2] == [("4", 2), ("4", 3)] and m[3]["top_section_id"] == ""
    assert R.heading_of("16 Jul 69 0932 EDT") is None and R.heading_of("(a) Something") is None and R.heading_of("TABLE OF CONTENTS") is None


def test_hyphens_axis_labels_and_noise():
    assert texts("The vertical-\ncomponent of the speed was measured by the ground station.") == ["The verticalcomponent of the speed was measured by the ground station."]
    assert texts("The speed was measured\ntime, sec\nby the ground station in flight.") == ["The speed was measured by the ground station in flight."]
    assert R.salvage("1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 ** NOTE: values are for the first stage only") == "NOTE: values are for the first stage only"
    assert R.salvage("12 34 56 78 90 12 3") == "" and R.low_information("12 ab 34")


def test_mixed_page_by_keyword_and_tables():
    assert R.keyword_hint("a Burn   chart here", ["BURN CHART"]) and not R.keyword_hint("reform now", ["FORM"]) and R.keyword_hint("x\nFig. 2", ["FIG"]) and not R.keyword_hint("see fig 2", ["FIG"])
    assert R.caption("TABLE 2-2. DATA") and not R.caption("Table 2-2 have been taken from the first report of the team.") and not R.caption("Figure 2, which shows it")
    assert R.table_body(["1 2 3"] * 9) and not R.table_body(["1 2 3"] * 7) and R.table_body([])


LINES = [
    PROSE, MORE, "", "   ", "10 20 30", "TABLE 2-2. DATA", "FIGURE 1 X", "35R", "ABC123", "4.1 SUMMARY", "SECTION IV", "WIND DATA", "time, sec", "25 fps", "a b", "the end of it", "And so-", "x = 3.5 (m/s)", "é è ü", "16 Jul 69 0932 EDT",
    "Going up slowly", "such as this-and that", "the re-entry went well", "left hand side-panel view of it", "Was ended early by-", "the plan of the day, for which a team", "running", "stood by the door of", "OPENED the second valve again", "Table 2-2 have been taken from the first report of the team.", "Figure 2, which shows it", "GROUND TIME MINUS VEHICLE TIME", "12 ab 34", "!!!", "No. 7 of the list of all things that are to be done", "CM 12 LM 14 of 20",
]


def test_expressions_say_the_same_as_functions(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    flags = {"prose": X.prose_line("line"), "visual": X.visual_line("line"), "low": X.low_information("line"), "numbered": X.numbered_heading("line"), "capitals": X.short_capital_title("line"), "axis": X.axis_label("line"), "caption": X.visual_caption("line"), "block": X.clean_block("line"), "narrative": X.narrative_line("line")}
    for r in df.select("i", "line", *(c.alias(k) for k, c in flags.items())).collect():
        s = r.line.strip()
        want = (R.prose(s), R.visual(s), R.low_information(r.line), R.numbered_candidate(s), R.capital_title(s), bool(R.AXIS.match(s)), R.caption(s), R.clean(r.line), R.narrative(s))
        assert (r.prose, r.visual, r.low, bool(r.numbered), bool(r.capitals), r.axis, r.caption, r.block, r.narrative) == want, r.line


def test_numbers_in_text(spark):
    from siftstone.operators import transcripts as T

    clocks = ["1:02", "1:60", "75:00", "1:02:03", "1:60:00", "x", "1", "1:2:3:4", "00 01 18 42", "-00 00 00 10", "00 24 00 00", "0% 00 00 00", "100 00 00 01"]
    df = spark.createDataFrame([(c,) for c in clocks], "c string").select("c", X.colon_seconds("c").alias("a"), X.elapsed_seconds("c").alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(T.colon_seconds(c), T.elapsed_seconds(c)) for c in clocks]
    romans = ["I", "IV", "xiv", "XXVIII", "Q", "", "MCX"]
    df = spark.createDataFrame([(c,) for c in romans], "c string").select(X.roman("c").alias("a"))
    assert [r.a for r in df.collect()] == [R.roman(c) for c in romans]


def test_records_and_their_validation(spark):
    frame = files.in_memory(spark, {"a.txt": PROSE, "b.txt": f"SUMMARY\n{MORE}"})
    records = R.report_records(frame, R.Options(mission="Apollo 11", collection="apollo11"))
    assert validate.validate_records(records).count() == 2
    with pytest.raises(ValueError, match="duplicate_id=2"):
        validate.validate_records(records.union(records))
    with pytest.raises(ValueError, match="missing"):
        validate.validate_records(records.drop("document"))
    assert validate.validate_records(records.limit(0)).count() == 0
    with pytest.raises(ValueError):
        files.in_memory(spark, {"a": " "})
