"""The workflows end to end over a small corpus of our own."""

import json

import pytest

from siftstone import app, models
from siftstone.operators import reports, transcripts
from siftstone.sources import store

REPORT = "--- PAGE 1 ---\nSECTION 1 - PROPULSION\nThe main engine was ignited on time and it burned for the planned number of seconds.\n"
TALK = "[0:05] spk_0: The weather at the launch site is cold this morning.\n[0:09] spk_1: Understood, ice has been seen on the tower."
CATALOG = (
    ("apollo11/report.txt", reports.Options(mission="Apollo 11", collection="apollo11", report_type="mission_report")),
    ("challenger/*_talk.txt", transcripts.Options("challenger", mission="STS-51L", collection="challenger")),
)


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    for folder, name, text in (("apollo11", "report.txt", REPORT), ("challenger", "a_talk.txt", TALK)):
        (at / folder).mkdir()
        (at / folder / name).write_text(text)
    return at


@pytest.fixture(scope="module")
def held(spark, base):
    c = store.Collection(spark, str(base / "store"), "c")
    out = app.ingest_corpus(spark, str(base), c, catalog=CATALOG)
    assert (out["files_processed"], out["documents_added"], out["errors"], sorted(out["missions"])) == (2, 2, 0, ["apollo11", "challenger"])
    return c


def test_documents_carry_their_tags(held):
    text = {r.mission: r.document for r in held.rows().collect()}
    assert text["apollo11"].startswith("[block=00000 pages=1-1]\n1. PROPULSION\n\nThe main engine")
    assert text["challenger"] == "[utt=000000 time=0:05 speaker=spk_0 lines=1-1]\nThe weather at the launch site is cold this morning.\n[utt=000001 time=0:09 speaker=spk_1 lines=2-2]\nUnderstood, ice has been seen on the tower."


def test_again_skips_and_replaces(spark, base, held):
    assert app.ingest_corpus(spark, str(base), held, catalog=CATALOG)["documents_skipped"] == 2
    assert app.ingest_corpus(spark, str(base), held, "replace", catalog=CATALOG)["documents_updated"] == 2


def test_retrieval_and_chat(held):
    assert [r.mission for r in app.retrieve(held, " main engine ", 5, "STS-51L").collect()] == ["challenger"]
    assert app.retrieve(held, "engine", 5, "all").count() == 2
    for bad in (("", 3, None), ("x", 0, None), ("x", 3, "Gemini")):
        with pytest.raises(ValueError):
            app.retrieve(held, *bad)
    chat = app.Chat(held)
    assert "main engine was ignited" in chat.ask("when was the main engine ignited?") and len(chat.history) == 2

    class Mute:
        def generate(self, question, context, history):
            return " "

    chat.generator = Mute()
    with pytest.raises(RuntimeError):
        chat.ask("again")
    assert len(chat.history) == 2


def test_batch(spark, held, tmp_path):
    ask = lambda i, m, q: (i, m, "c", q, "The main engine was ignited on time.")
    q = spark.createDataFrame([ask("q1", "Apollo 11", "when was the engine ignited"), ask("q2", "Gemini", "x"), ask("q3", "all", "ice on the tower")], "id string, mission string, category string, user_input string, reference string")

    class Fails(models.ExtractiveGenerator):
        def generate(self, question, context, history):
            if "ice" in question:
                raise TimeoutError("slow")
            return super().generate(question, context, history)

    report = app.batch_report(app.evaluate_batch(q, held, generator=Fails()), {"top_k": 5})
    s = report["summary"]
    assert (s["question_count"], s["failed_question_ids"]) == (3, ["q2", "q3"]) and s["metrics"]["faithfulness"]["count"] == 1
    assert [r["context_count"] for r in report["results"]] == [1, 0, 2] and "unknown mission" in report["results"][1]["error"] and "TimeoutError: slow" in report["results"][2]["error"]


def test_command_line(spark, held, base, tmp_path, capsys):
    for bad in (["evaluate", "--top-k", "0"], ["ingest", "--chunk-size", "5", "--chunk-overlap", "5"], ["other"]):
        with pytest.raises(SystemExit) as e:
            app.main(bad, spark)
        assert e.value.code == 2
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "q1", "mission": "all", "category": "c", "user_input": "main engine", "reference": "The main engine was ignited."}]}))
    at = ["--store", str(base / "store"), "--collection-name", "c"]
    assert app.main(["evaluate", *at, "--dataset", str(tmp_path / "q.json"), "--output", str(tmp_path / "out.json")], spark) == 0
    assert json.loads((tmp_path / "out.json").read_text())["summary"]["question_count"] == 1 and "q1:" in capsys.readouterr().out
    assert app.main(["ask", *at, "main engine"], spark) == 0 and app.main(["ingest", *at, "--stats-only"], spark) == 0
