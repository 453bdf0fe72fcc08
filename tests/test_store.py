"""The collection, contexts, scores, models, question sets and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from siftstone import models
from siftstone.operators import chunks, collection, context, evaluate, search
from siftstone.sources import files, reports, store
from siftstone.streaming import ingest

CHUNK = "document string, mission string, source string, source_path string, source_type string, chunk_index int"


def chunk(spark, *rows):
    return spark.createDataFrame(rows, CHUNK)


def test_store_modes(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "c")
    a = [(f"text {i}", "Apollo 11", "f.txt", "/x/f.txt", "report", i) for i in range(3)]
    assert c.write(chunk(spark, *a)) == {"added": 3, "updated": 0, "skipped": 0}
    assert c.write(chunk(spark, a[0], ("new", "Apollo 11", "f.txt", "/x/f.txt", "report", 3))) == {"added": 1, "updated": 0, "skipped": 1}
    changed = [("other", *a[0][1:])]
    assert c.write(chunk(spark, *changed), "update") == {"added": 0, "updated": 1, "skipped": 0} and c.count() == 4
    assert c.write(chunk(spark, *changed), "replace") == {"added": 0, "updated": 1, "skipped": 0}
    assert [(r.id, r.document, r.mission) for r in c.rows().collect()] == [("apollo11::f::chunk_0000", "other", "apollo11")]
    assert c.get("apollo11::f::chunk_0000").count() == 1 and c.file_rows("apollo11", "/x/f.txt").count() == 1
    with pytest.raises(ValueError, match="one file"):
        c.write(chunk(spark, a[0], ("z", "Apollo 11", "g.txt", "/x/g.txt", "report", 0)), "replace")
    for bad in [("x", "Gemini", "f", "/f", "report", 0), (" ", "Apollo 11", "f", "/f", "report", 0), ("x", "Apollo 11", "f", "", "report", 0)]:
        with pytest.raises(ValueError):
            c.write(chunk(spark, bad))
    with pytest.raises(ValueError):
        c.write(chunk(spark, a[0], a[0]))
    with pytest.raises(ValueError):
        c.delete_source(" ")
    assert {(r.facet, r.value): r.n for r in c.stats().collect()}["total", "files"] == 1
    assert store.discover(spark, str(tmp_path)) == {"c": "c (1 rows)"} and c.delete_source("f") == 1 and c.count() == 0
    with pytest.raises(FileNotFoundError):
        store.Collection(spark, str(tmp_path), "none", create=False)


def test_ingest_isolates_files(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "c")
    good, bad = ("t", "STS-51L", "a", "/a", "report", 0), ("t", "Nowhere", "b", "/b", "report", 0)
    twice = [("t", "Apollo 11", "d", p, "report", 0) for p in ("/d", "/e")]
    out = store.ingest(c, chunk(spark, good, bad, *twice), "skip", lambda d: models.embed_rows(d, models.HashEmbedder(8)))
    assert (out["files_processed"], out["documents_added"], out["errors"], list(out["missions"])) == (1, 1, 3, ["challenger"])
    assert {p: why.split(": ", 2)[2] for p, why in out["failures"]} == {"/b": "mission: 1, id: 1", "/d": "repeated ids: 1", "/e": "repeated ids: 1"}
    assert c.rows().select(F.size("embedding")).first()[0] == 8
    assert store.ingest(c, chunk(spark, good).limit(0), "skip", lambda d: d)["files_processed"] == 0


def test_many_files_are_one_version(spark, tmp_path, caplog):
    c = store.Collection(spark, str(tmp_path), "c")
    rows = [(f"text {i}", "Apollo 11" if i % 2 else "STS-51L", f"f{i}", f"/f{i}", "report", 0) for i in range(50)]
    plain = lambda d: d
    out = store.ingest(c, chunk(spark, *rows), "skip", plain)
    assert c.version() == 2 and out["files_processed"] == 50 and out["missions"]["apollo11"] == {"files": 25, "chunks": 25, "added": 25, "updated": 0, "skipped": 0}
    out = store.ingest(c, chunk(spark, *[(f"new {r[0]}", *r[1:3], r[3], r[4], 1) for r in rows]), "replace", plain)
    assert c.version() == 3 and c.count() == 50 and c.rows().where("document like 'new %'").count() == 50  # each file replaces its own rows
    assert c.vacuum(1) == 2 and c.version() == 3 and c.count() == 50 and len(list((tmp_path / "c" / "data").iterdir())) == 1

    class Choosy(models.HashEmbedder):
        def embed(self, texts):
            if any("text 7" in t for t in texts):
                raise KeyError("no vector")
            return super().embed(texts)

    with caplog.at_level("WARNING"):
        out = store.ingest(c, chunk(spark, *rows[6:9]), "update", lambda d: models.embed_rows(d, Choosy(4)))
    assert (out["files_processed"], out["errors"], [p for p, _ in out["failures"]]) == (2, 1, ["/f7"]) and "KeyError" in out["failures"][0][1] + caplog.text


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = store.Collection(spark, str(tmp_path), "c"), store.Collection(spark, str(tmp_path), "c")
    rows = [(f"text {i}", "Apollo 11", f"f{i}", f"/f{i}", "report", 0) for i in range(3)]
    commit, raced = a._commit, []

    def late(base, state):
        """The other one commits between a's reading and a's commit."""
        if not raced:
            raced.append(b.write(chunk(spark, rows[1])))
        commit(base, state)

    a._commit = late
    assert a.write(chunk(spark, rows[0])) == {"added": 1, "updated": 0, "skipped": 0} and raced
    assert sorted(r.document for r in b.rows().collect()) == ["text 0", "text 1"] and b.version() == 3
    a._commit = lambda base, state: commit(0, state)  # always too late
    with pytest.raises(store.Lost):
        a.write(chunk(spark, rows[2]))
    assert b.count() == 2


def test_model_arguments():
    assert [models.reasoning_effort(m) for m in ("GPT-5.4-mini", "gpt-5", "gpt-5-nano", "gpt-4o", "gpt-50")] == ["low", "minimal", "minimal", None, None]
    given = {"max_tokens": 9, "top_p": 0.1, "seed": 1}
    assert models.request_arguments("gpt-4o", given, 50) == given
    assert models.request_arguments("gpt-5.4", given, 50) == {"seed": 1, "temperature": 1.0, "max_completion_tokens": 50, "reasoning_effort": "low"}


def test_chunk_sizes(spark):
    text = " ".join(f"sentence {i} has five words." for i in range(40))
    df = spark.createDataFrame([(1, text, "report"), (2, "short", None), (3, " \n", "report")], "id int, text string, source_type string")
    for size, overlap in ((64, 8), (128, 16)):
        for made in (chunks.stride_chunks(df, "text", size, overlap), chunks.packed_chunks(df, "text", "source_type", size, overlap)):
            rows = made.orderBy("id", "chunk_index").collect()
            assert max(r.token_count for r in rows) <= size and {r.id for r in rows} == {1, 2} and sum(r.id == 1 for r in rows) == rows[0].total_chunks > 1
    packed = chunks.pack(text, lambda s: len(s.split()), 64, 0, ("\n\n",))
    assert "".join(packed) == text
    for bad in ((0, 0), (10, 10), (10, -1), (True, 0)):
        with pytest.raises(ValueError):
            chunks.check_sizes(*bad)


def test_search_with_many_queries_is_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(60)] + [(99, None, 0), (98, [0.0, 0.0, 0.0], 1)], "id int, embedding array<double>, label int")
    found = lambda **k: sorted(map(tuple, search.search(rows, rows.where("id < 30"), 4, **k).select("query_id", "rank", "id").collect()))
    few = found(), found(facet="label")
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 7)
    assert (found(), found(facet="label")) == few and len(few[0]) == 120
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 1000)
    monkeypatch.setattr(search, "MATRIX_QUERIES", 1)
    assert (found(), found(facet="label")) == few
    exact = {(r.query_id, r.id): r.distance for r in search.search(rows, rows.where("id < 30"), 4).collect()}
    monkeypatch.setattr(search, "MATRIX_QUERIES", 64)
    assert exact == pytest.approx({(r.query_id, r.id): r.distance for r in search.search(rows, rows.where("id < 30"), 4).collect()}, abs=1e-12)
    assert search.search(rows, rows.where("id = 1"), 500).count() == 60
    assert search.search(rows, rows.where("id = 1"), 5, where=F.col("label") == 2).where("id % 3 <> 2").count() == 0
    with pytest.raises(ValueError):
        search.search(rows, rows, 0)


@pytest.mark.parametrize(("broadcast", "matrix"), [(1000, 64), (3, 64), (1000, 1)])
def test_search_without_null_facets_and_non_finite_vectors(spark, monkeypatch, broadcast, matrix):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i)], "ab"[i % 2] if i % 3 else None) for i in range(12)] + [(20, [nan, 1.0], "a"), (21, [1.0, inf], "b"), (22, [1.0, nan], None), (23, [-inf, 1.0], "a")]
    table = spark.createDataFrame(rows, "id int, embedding array<double>, label string")
    monkeypatch.setattr(search, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(search, "MATRIX_QUERIES", matrix)
    found = lambda facet: sorted((r.query_id, r.id) for r in search.search(table, table, 100, facet=facet).collect())
    assert found(None) == [(i, j) for i in range(12) for j in range(12)]
    assert found("label") == [(i, j) for i in range(12) for j in range(12) if i % 3 and j % 3 and i % 2 == j % 2]


def test_search_past_parts_keeps_ids_whole(spark, monkeypatch):
    big = (1 << 62) + 1
    rows = spark.createDataFrame([(big + i, [1.0, float(i)], f"{i % 2}") for i in range(30)] + [(7, [1.0], "0")], "id long, embedding array<float>, label string")
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    monkeypatch.setattr(search, "PART_BYTES", 64)
    monkeypatch.setattr(search, "HELD", 5)
    got = {(r.query_id, r["rank"], r.id) for r in search.search(rows, rows, 1).collect()}
    assert got == {(big + i, 1, big + i) for i in range(30)} | {(7, 1, 7)}
    assert {(r.query_id - big, r.id - big) for r in search.search(rows, rows.where("id > 7"), 15, facet="label").collect()} == {(i, j) for i in range(30) for j in range(30) if i % 2 == j % 2}


def test_worked_scores(spark):
    ranked = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("q", 3, True), ("z", 1, False)], "query_id string, rank int, useful boolean")
    got = {r.query_id: r.context_precision for r in search.precision(ranked).collect()}
    assert got["q"] == pytest.approx(0.8333333) and got["z"] == 0
    one = spark.range(1).select(search.f1(F.lit(0.8333), F.lit(0.8)).alias("a"), search.f1(F.lit(0.0), F.lit(0.0)).alias("b"), search.f1(F.lit(float("nan")), F.lit(0.5)).alias("c"), evaluate.claim_f1(F.lit(4), F.lit(0), F.lit(1)).alias("d")).first()
    assert one.a == pytest.approx(0.816, abs=1e-3) and one.b == 0 and one.c is None and one.d == pytest.approx(0.889, abs=1e-3)


def test_relevancy_is_a_mean_cosine(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<double>")
    r = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 3.0])], "id string, embedding array<double>")
    assert [tuple(x) for x in evaluate.relevancy(q, r).collect()] == [("a", 0.5)]


def test_summary_leaves_out_what_does_not_count(spark):
    nan = math.nan
    rows = spark.createDataFrame([("q1", 0.8, 0.5, None), ("q2", nan, 0.7, None), ("q3", 0.1, 0.1, "Timeout"), ("q4", None, math.inf, None)], "id string, faithfulness double, context_recall double, error string")
    got = {r.metric: (r.n, round(r["mean"], 6)) for r in evaluate.summarise(rows, "id", ("faithfulness", "context_recall")).collect()}
    assert got == {"faithfulness": (1, 0.8), "context_recall": (2, 0.6)} and tuple(evaluate.failed(rows, "id").first()) == (1, "q3")


def test_contexts_and_prompts(spark):
    rows = spark.createDataFrame([("q", 1, "Same  text", "apollo11"), ("q", 2, "other", "STS-51L"), ("q", 3, "same TEXT ", "x"), ("q", 4, "  ", "x")], "query_id string, rank int, text string, mission string")
    kept = context.distinct_in_order(rows, "text", "query_id", "rank").withColumn("e", F.lit("")).withColumn("page", F.col("rank"))
    got = context.cited_context(kept, "query_id", context.cited_block("number", "text", "mission", ["e"], ["e"], ["e"], ("page", F.lit(None).cast("int")))).first().context
    assert got == "RETRIEVED DOCUMENTS\n\n[DOCUMENT 1]\nMISSION = Apollo 11\nSOURCE = Unknown source\nFILEPATH = Unknown filepath\nTYPE = unknown\nPAGES = 1-1\n\nSame  text\n\n---\n\n[DOCUMENT 2]\nMISSION = Challenger\nSOURCE = Unknown source\nFILEPATH = Unknown filepath\nTYPE = unknown\nPAGES = 2-2\n\nother"
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(8)], "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in context.last_turns(turns, "conv_id", "turn", 4).collect()) == [4, 5, 6, 7] and context.last_turns(turns, "conv_id", "turn", 0).count() == 0
    with pytest.raises(ValueError):
        context.last_turns(turns, "conv_id", "turn", -1)
    assert context.NO_CONTEXT in spark.range(1).select(context.user_prompt(F.lit("why"), F.lit(" "))).first()[0]


def test_questions_and_reports(spark, tmp_path):
    q = {"id": "q1", "mission": "m", "category": "c", "user_input": "u", "reference": "r", "extra": 1}
    put = lambda x: (tmp_path / "q.json").write_text(json.dumps(x)) and str(tmp_path / "q.json")
    assert files.questions(spark, put({"questions": [q, q | {"id": "q2"}]})).count() == 2
    for bad in ({"questions": []}, {"other": 1}, {"questions": [q, q]}, {"questions": [q | {"reference": " "}]}, {"questions": [{k: v for k, v in q.items() if k != "mission"}]}):
        with pytest.raises(ValueError):
            files.questions(spark, put(bad))
    at = reports.write_report({"a": [math.nan, math.inf, 1.5], "t": "月"}, str(tmp_path / "deep" / "r.json"))
    assert open(at, encoding="utf-8").read() == '{\n  "a": [\n    null,\n    null,\n    1.5\n  ],\n  "t": "月"\n}\n'
    assert reports.report_lines({"results": [{"id": 1, "f1": 0.5}, {"id": 2, "error": "E: x"}, {"id": 3, "f1": True}], "summary": {}}, ("f1",)) == ["1: f1=0.500", "2: ERROR - E: x", "3: no valid metric scores", "{}"]


def test_models_fail_as_data(spark):
    class Broken:
        def generate(self, question, context, history):
            if question == "bad":
                raise KeyError("x")
            return "" if question == "mute" else "said"

    rows = spark.createDataFrame([(q, "") for q in ("good", "bad", "mute", " ")], "user_input string, context string")
    got = {r.user_input: (r.response, (r.error or "").split(":")[0]) for r in models.answer_rows(rows, Broken()).collect()}
    assert got == {"good": ("said", ""), "bad": (None, "KeyError"), "mute": (None, "RuntimeError"), " ": (None, "ValueError")}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(2):
        chunk(spark, *[(f"v{k}", "Apollo 13", "s", "/s", "report", i) for i in range(k, k + 2)]).coalesce(1).write.mode("append").parquet(str(src))
    c = store.Collection(spark, str(tmp_path / "store"), "c")
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(src))
    ingest.stream_upsert(stream, c, "update", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.chunk_index for r in c.rows().collect()) == [0, 1, 2]
    turns = tmp_path / "turns"
    spark.createDataFrame([(1, i, "user", str(i)) for i in range(9)], "conv_id long, turn long, role string, text string").write.parquet(str(turns))
    q = ingest.running_history(spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(turns)), 3).writeStream.outputMode("update").format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [t.turn for t in spark.sql("select * from held").first().history] == [6, 7, 8]


def test_modes_and_facets(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "x")], "m string, k string")
    got = {(r.facet, r.value): r.n for r in collection.facet_counts(df, {"m": F.col("m"), "k": F.col("k")}).collect()}
    assert got == {("m", "a"): 2, ("m", "b"): 1, ("k", "unknown"): 2, ("k", "x"): 1}
    with pytest.raises(ValueError):
        collection.upsert(df, df, "merge")


def _shuffled(spark) -> int:
    jvm = spark.sparkContext._jvm
    told = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(told.apply(i).shuffleWriteBytes() for i in range(told.size()))


def test_checks_and_rows_that_go_carry_no_text(spark):
    text = F.expr("array_join(transform(sequence(1, 200), i -> sha2(concat(id, '-', i), 256)), '')")
    rows = spark.range(400).select(F.concat(F.lit("c"), "id").alias("id"), text.alias("document"), F.lit("apollo11").alias("mission"), F.concat(F.lit("s"), "id").alias("source"), F.concat(F.lit("/f"), (F.col("id") % 7).cast("string")).alias("filepath"))
    stored, incoming = rows.repartition(3).cache(), rows.where("id <> 'c3'").withColumn("filepath", F.when(F.col("id") != "c5", F.col("filepath"))).cache()
    assert stored.count() == 400 and incoming.count() == 399
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = _shuffled(spark)
        assert [tuple(r) for r in store.broken_files(incoming).collect()] == [(None, "ValueError: rows that can't be stored: filepath: 1")]
        gone = collection.changes(stored, incoming, "replace").where("gone").collect()
        assert [(r.id, r.mission, r.filepath, r.document, r.source) for r in gone] == [("c3", "apollo11", "/f3", None, None)]
        assert _shuffled(spark) - began < 400_000  # the texts are 5 MB
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        stored.unpersist()
        incoming.unpersist()
