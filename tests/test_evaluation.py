"""Scores by their definitions, and judges whose metrics are slow, fail, or fail once."""

import threading
import time

import pytest

from siftstone import app, models

ROWS = "id string, user_input string, response string, contexts array<string>, reference string, error string"


class Told(models.OverlapJudge):
    """Four of the answer's claims are in the reference; one of the reference's five isn't in the answer."""

    def verdicts(self, metric, question, answer, contexts, reference=None):
        return {"faithfulness": [True, True, False, True], "context_precision": [True, False, True], "context_recall": [True, True, False], "answer_claims": [True] * 4, "reference_claims": [True] * 4 + [False]}[metric]

    def questions(self, answer):
        return ["same", "other", " "]


class Axes(models.HashEmbedder):
    def embed(self, texts):
        return [[1.0, 0.0] if t in ("asked", "same") else [0.0, 2.0] for t in texts]


def scored(spark, rows, judge, **k):
    results = spark.createDataFrame(rows, ROWS)
    asked = models.embed_rows(results.select("id", "user_input"), Axes(), "user_input")
    told = app.verdict_scores(models.judged_rows(results, judge, **k), asked, lambda d: models.embed_rows(d, Axes(), "text"))
    return {r["id"]: r.asDict() for r in told.collect()}


def test_scores_are_the_definitions(spark):
    got = scored(spark, [("a", "asked", "answer", ["x"], "ref", None), ("b", "asked", "answer", ["x"], None, None), ("c", "asked", None, ["x"], "ref", "KeyError: no answer")], Told())
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert round(a["factual_correctness"], 2) == 0.89  # 4 true positives, 1 false negative
    assert a["response_relevancy"] == 0.5  # cosines 1 and 0; a blank question is none
    assert round(a["context_precision"], 3) == 0.833 and a["faithfulness"] == 0.75 and round(a["context_recall"], 3) == 0.667
    assert a["retrieval_f1"] == pytest.approx(2 * (5 / 6) * (2 / 3) / (5 / 6 + 2 / 3))
    assert b["faithfulness"] == 0.75 and b["response_relevancy"] == 0.5
    assert all(b[m] is None for m in ("factual_correctness", "context_precision", "context_recall", "retrieval_f1"))
    assert all(v is None for r in (a, b) for m, v in r.items() if m.endswith("_error"))


def test_one_metric_fails_alone(spark):
    class Broken(Told):
        def verdicts(self, metric, *rest):
            if metric in ("context_recall", "reference_claims"):
                raise KeyError(metric)
            return super().verdicts(metric, *rest)

        def questions(self, answer):
            raise ValueError("none")

    a = scored(spark, [("a", "asked", "answer", ["x"], "ref", None)], Broken(), retries=0)["a"]
    assert a["faithfulness"] == 0.75 and round(a["context_precision"], 3) == 0.833 and a["faithfulness_error"] is a["context_precision_error"] is None
    assert all(a[m] is None for m in ("context_recall", "factual_correctness", "response_relevancy", "retrieval_f1"))
    assert (a["context_recall_error"], a["factual_correctness_error"], a["response_relevancy_error"]) == ("KeyError: 'context_recall'", "KeyError: 'reference_claims'", "ValueError: none")
    assert a["retrieval_f1_error"]


def test_a_slow_metric_holds_no_other(spark):
    class Slow(Told):
        def verdicts(self, metric, question, *rest):
            if metric == "faithfulness" and question == "slow":
                time.sleep(60)
            return super().verdicts(metric, question, *rest)

    began = time.monotonic()
    got = scored(spark, [("a", "slow", "answer", ["x"], "ref", None), ("b", "asked", "answer", ["x"], "ref", None)], Slow(), patience=1.5, at_once=2)
    assert time.monotonic() - began < 50
    assert got["a"]["faithfulness"] is None and got["a"]["faithfulness_error"].startswith("TimeoutError")
    assert got["b"]["faithfulness"] == 0.75 and round(got["a"]["factual_correctness"], 2) == 0.89


def test_calls_run_together_and_are_made_again():
    lock, state = threading.Lock(), {"open": 0, "most": 0, "failed": 0}

    def call(i):
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
        time.sleep(0.05)
        with lock:
            state["open"] -= 1
            if i == 3 and not state["failed"]:
                state["failed"] = 1
                raise OSError("once")
        if i == 4:
            raise OSError("always")
        return i

    calls = [lambda i=i: call(i) for i in range(12)]
    out = models.call_all(calls, at_once=4, patience=5, retries=1)
    assert out == [(i, None) if i != 4 else (None, "OSError: always") for i in range(12)] and state["most"] == 4
    assert models.call_all(calls[3:5], at_once=4, patience=5, retries=0) == [(3, None), (None, "OSError: always")] and models.call_all([]) == []
    assert models.call_all([lambda: time.sleep(9), lambda: 1], at_once=1, patience=0.2) == [(None, "TimeoutError: no answer within 0.2 seconds"), (1, None)]


def test_the_stand_in_judges_claims_of_both_sides():
    judge, ask = models.OverlapJudge(), lambda m: models.OverlapJudge().verdicts(m, "q", "The crew landed. It rained frogs.", ["the crew landed safely"], "The crew landed. The engine burned for two minutes.")
    assert ask("answer_claims") == [True, False] and ask("reference_claims") == [True, False] and ask("faithfulness") == [True, False] and ask("context_recall") == [True, False]
    assert judge.questions("One. Two? !") == ["One.", "Two?"]
