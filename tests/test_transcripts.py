"""Transcripts: fixtures of our own for each rule, and the window form against the fold."""

import pytest
from pyspark.sql import functions as F

from siftstone.operators import transcripts as T
from siftstone.sources import files

MEMORY = "memory://"


def parse(text, parser="auto", name="t.txt", **more):
    return T.parse_transcript(MEMORY + name, text, T.Options(parser=parser, **more))


def said(rows):
    return [(r["metadata"].get("speaker"), r["document"]) for r in rows]


def test_blocks_of_time_speaker_and_text():
    rows = parse("00 02 10 05\nCDR\nWe read you\nfive by.\n00 02 10 11\nCC\nGood.\n00 02 10 20\nLMP (EAGLE)\nSame here.", "apollo")
    assert said(rows) == [("CDR", "We read you five by."), ("CC", "Good."), ("LMP (EAGLE)", "Same here.")]
    m = rows[0]["metadata"]
    assert (m["timestamp"], m["timestamp_sec"], m["timestamp_valid"], m["source_line_start"], m["source_line_end"], m["speaker_label_status"]) == ("00 02 10 05", 7805, True, 1, 4, "recognized")
    assert [r["id"] for r in rows] == ["t_utt_000000", "t_utt_000001", "t_utt_000002"]


def test_fused_lines():
    rows = parse("00 00 00 01 CDR Going up.\n00 00 00 02CMPRoger that\n00 00 00 03LMP\nAlone.\n00 00 00 04\nCCMARK.\n00 00 00 05\nCMP words here\nTMP\nunclear\nPRESIDENT NIXON Hello there", "apollo")
    assert said(rows) == [("CDR", "Going up."), ("CMP", "Roger that"), ("LMP", "Alone."), ("CC", "MARK."), ("CMP", "words here"), ("TMP", "unclear"), ("PRESIDENT NIXON", "Hello there")]
    assert [r["metadata"]["speaker_label_status"] for r in rows if r["metadata"]["speaker"] == "TMP"] == ["ocr_alias"]


def test_times_that_are_negative_broken_or_out_of_range():
    rows = parse("--- PAGE 2 ---\nnot yet\n--- PAGE 3 ---\n-00 00 00 10\nCDR\nEarly.\n00 30 00 00\nCDR\nBroken.\n0% 01 02 03\nCDR\nDamaged.", "apollo", start_page=3)
    m = [r["metadata"] for r in rows]
    assert [(x.get("timestamp_sec"), x["timestamp_valid"]) for x in m] == [(-10, True), (None, False), (None, False)]
    assert [x["source_line_start"] for x in m] == [4, 7, 10] and {x["page_start"] for x in m} == {3}
    with pytest.raises(ValueError, match="start page 9"):
        parse("--- PAGE 2 ---\nx", "apollo", start_page=9)


def test_headers_that_were_split():
    tape = "Tape\n12/3\n-\nPage\n44\n00 01 01 01\nCDR\nStill here.\n»\nEND\nOF\nTAPE\n«"
    assert said(parse(tape, "apollo")) == [("CDR", "Still here.")]
    spread = "01\n02\n03\n04\nCDR\nOn time.\n(GOSS\nNET 1)\nMore."
    rows = parse(spread, "apollo")
    assert said(rows) == [("CDR", "On time. More.")] and rows[0]["metadata"]["timestamp_sec"] == ((1 * 24 + 2) * 60 + 3) * 60 + 4
    titles = "00 01 01 01\nCDR\nWords.\nAP\nOLL 11 ATR-TO-GROUID VOICE TRANSCR\nTape 4/2\n17\nAPOLLO 11 AIR-TO-GROUND VOICE TRANSCRIPTION\nAfter."
    assert said(parse(titles, "apollo")) == [("CDR", "Words. After.")]


def test_commentary_keeps_speaker_segment_and_date():
    text = "APOLLO 11 MISSION COMMENTARY 7/17\nThis is control.\n\n12\nCAPCOM: Go ahead.\n7/18/69\nCAPCOM\nSecond day.\n\nStill the same.\nCDT 4:00 GET 10:00\nBack to control."
    rows = parse(text)
    assert said(rows) == [("PAO", "This is control."), ("CAPCOM", "Go ahead."), ("CAPCOM", "Second day."), ("CAPCOM", "Still the same."), ("PAO", "Back to control.")]
    assert [r["metadata"].get("calendar_date") for r in rows] == [None, None, "7/18/69", "7/18/69", "7/18/69"]
    assert rows[4]["metadata"]["segment_marker"].startswith("CDT")


def test_a_start_without_lines_stays():
    rows = parse("SWIM 1\n\nlater words", "pao")
    assert rows[0]["metadata"]["source_line_start"] == 1 and rows[0]["metadata"]["source_line_end"] == 3


DIARIZED = "lost\n[0:05] spk_0: Hello\nand on\n--- PAGE 2 ---\n[1:70] spk_12: Bad clock\n[0:09] spk_1:   \n[1:02:03] spk_1: End-\nless"


def test_diarized():
    rows = parse(DIARIZED)
    assert said(rows) == [("spk_0", "Hello and on"), ("spk_12", "Bad clock"), ("spk_1", "Endless")]
    assert [r["metadata"].get("timestamp_sec") for r in rows] == [5, None, 3723] and rows[1]["metadata"]["page_start"] == 2


def test_windows_say_the_same_as_the_fold(spark):
    text = DIARIZED.replace("--- PAGE 2 ---\n", "")
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"), 1)], "path string, line_no int, line string")
    got = [tuple(r) for r in T.diarized(lines).orderBy("utterance_index").select("utterance_index", "timestamp", "timestamp_sec", "speaker_id", "line_start", "line_end", "document").collect()]
    want = [tuple(r["metadata"].get(k) for k in ("utterance_index", "timestamp", "timestamp_sec", "speaker_id", "source_line_start", "source_line_end")) + (r["document"],) for r in parse(text)]
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "challenger").mkdir()
    (tmp_path / "challenger" / "7-STS-51L_talk.txt").write_text(DIARIZED)
    (tmp_path / "challenger" / "summary.txt").write_text("no")
    (tmp_path / "challenger" / ".hidden.txt").write_text("no")
    found = files.corpus_files(spark, str(tmp_path))
    assert [(r.file_name, r.mission) for r in found.collect()] == [("7-STS-51L_talk.txt", "challenger")]
    m = T.transcript_records(found).select("metadata.*").first()
    assert (m.collection, m.mission, m.doc_number, m.doc_id) == ("challenger", "STS-51L", "7", "7-STS-51L_talk")
    for bad in ({}, {"path": " ", "raw_text": ""}, {"path": "x", "raw_text": "y"}):
        with pytest.raises(ValueError):
            files.one_source(spark, **bad)
    with pytest.raises(ValueError):
        T.Options(parser="other")
    kinds = spark.createDataFrame([(DIARIZED, "a"), ("x", "my_PAO.txt"), ("STATUS REPORT", "b"), ("x", "b")], "t string, n string").select(T.parser_of(F.col("t"), F.col("n")).alias("k"), "t", "n").collect()
    assert [r.k for r in kinds] == [T.detect(r.t, r.n) for r in kinds] == ["challenger", "pao", "pao", "apollo"]


def test_pages_and_lines_as_tables(spark):
    from siftstone.operators import lines as L
    from siftstone.operators.reports import pages_of

    cases = {"a": "lost\n--- PAGE 3 ---\none\r\ntwo\n--- PAGE 4 ---\n\nthree\n", "b": "no marker\nat all", "c": "--- PAGE 1 ---\n", "d": ""}
    df = spark.createDataFrame(list(cases.items()), "path string, value string")
    got = {}
    for r in L.page_rows(df).collect():
        got.setdefault(r.path, []).append((r.page_no, r.page.strip()))
    assert got == {k: [(n, p.strip()) for n, p in pages_of(t)] for k, t in cases.items()}
    for start in (None, 4):
        want = {(k, x.number, x.page, x.text) for k, t in cases.items() for x in (L.numbered(t, 0, start) if start is None or k == "a" else [])}
        assert {tuple(r) for r in L.line_rows(df, start_page=start).collect() if r.path != "d"} == want
