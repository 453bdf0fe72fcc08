"""Models and tables are asked once, however often their answers are read."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftstone import app, models
from siftstone.operators import search
from siftstone.plans import state


class Counting(models.HashEmbedder):
    """Counts the texts that begin with "text"."""

    def __init__(self, seen):
        super().__init__(16)
        self.seen = seen

    def embed(self, texts):
        self.seen.add(sum(t.startswith("text") for t in texts))
        return super().embed(texts)


class Answer:
    def __init__(self, seen):
        self.seen = seen

    def generate(self, question, context, history):
        self.seen.add(1)
        return f"An answer to {question}"


class Held:
    def __init__(self, rows):
        self.held = rows

    def rows(self):
        return self.held


def documents(spark, n=30):
    rows = [(f"d{i:02}", f"text {i} engine {'fire' if i % 3 else 'water'}", (None, "apollo11", "challenger")[i % 3], "s", "f", "report") for i in range(n)]
    d = spark.createDataFrame(rows, "id string, document string, mission string, source string, filepath string, source_type string").repartition(3)
    return d.withColumns({c: F.lit(None).cast("long") for c in ("page_start", "page_end", "source_line_start", "source_line_end")} | {"document_category": F.lit(None).cast("string")})


def test_batch_asks_for_each_vector_and_answer_once(spark):
    seen, answered = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    held = Held(models.embed_rows(documents(spark), Counting(seen)))
    asked = spark.createDataFrame([("a", "Apollo 11", "engine fire"), ("b", "all", "engine water"), ("c", "Gemini", "x"), ("d", "STS-51L", "engine")], "id string, mission string, user_input string").withColumn("reference", F.col("user_input"))
    out = {r.id: r for r in app.evaluate_batch(asked, held, 4, models.HashEmbedder(16), Answer(answered)).collect()}
    assert seen.value == 30 and answered.value == 3
    assert [out[k].context_count for k in "abcd"] == [4, 4, 0, 4] and "unknown mission" in out["c"].error
    assert all(int(t.split()[1]) % 3 == 1 for t in out["a"].retrieved_contexts) and all(int(t.split()[1]) % 3 == 2 for t in out["d"].retrieved_contexts)
    assert all(int(t.split()[1]) % 3 == 0 for t in out["b"].retrieved_contexts)  # rows without a mission are found too


def test_wide_queries_meet_all_facets_on_every_path(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, (None, "a", "b")[i % 3], rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(90)]
    asked = [(1000 + i, ("a", None, "b", "c")[i % 4], rng.integers(-2, 3, 3).astype(float).tolist(), i % 2 == 1) for i in range(70)]
    c = spark.createDataFrame(rows, "id long, kind string, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "id long, kind string, embedding array<float>, any boolean")
    want = set()
    for i, kind, v, wide in asked:
        near = [(round(1 - np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), 9) + 0.0, j) for j, own, w in rows if any(w) and any(v) and (wide or kind == own and kind)]
        want |= {(i, r, j) for r, (_, j) in enumerate(sorted(near)[:4], 1)}
    for few, most in ((1000, 1000), (64, 1000), (64, 10)):  # pair by pair, as a matrix, by parts
        monkeypatch.setattr(search, "MATRIX_QUERIES", few)
        monkeypatch.setattr(search, "BROADCAST_QUERIES", most)
        assert {tuple(r) for r in search.search(c, q, 4, facet="kind", wide="any").select("query_id", "rank", "id").collect()} == want


def test_least_of_each_line_are_the_first_of_equal_ones():
    order = np.random.default_rng(4).integers(0, 5, (40, 30)).astype(float)
    order[3] = np.inf
    for k in (1, 7, 29, 30, 50):
        i, j = search._least(order, k)
        for n, line in enumerate(order):
            assert sorted(j[i == n]) == sorted(np.argsort(line, kind="stable")[:k])


def test_vectors_that_nobody_reads_cost_no_call(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = models.embed_rows(documents(spark), Counting(seen))
    assert len(rows.drop("embedding").collect()) == 30 and seen.value == 0
    assert len(rows.where("embedding[0] < 9").selectExpr("id", "embedding").collect()) == 30 and seen.value == 30


def test_hashes_of_words():
    texts = ["The engine, the ENGINE fired.", "", "Straße ß 12 a_b"]
    want = np.zeros((3, 8))
    for i, t in enumerate(texts):
        for w, n in Counter(re.findall(r"\w+", t.lower())).items():
            h = zlib.crc32(w.encode())
            want[i, h % 8] += n if h >> 16 & 1 else -n
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(models.HashEmbedder(8).embed(texts), want / np.where(size, size, 1))


def test_chain_embeds_each_chunk_once(spark, monkeypatch):
    seen, own = spark.sparkContext.accumulator(0), models.HashEmbedder.embed

    class Own(models.HashEmbedder):
        def embed(self, texts):
            seen.add(len(texts))
            return own(self, texts)

    monkeypatch.setattr(state, "HashEmbedder", Own)
    at = "/root/testdata/sf0.001"
    docs = state.table(spark, at, "documents")
    n = state.chunks.stride_chunks(docs).count()
    questions = state.table(spark, at, "benchmark").count()
    told = state.rag(spark, at).collect()
    # Questions are embedded to be counted and to be sent.
    assert len({r.id for r in told}) == questions and n <= seen.value <= n + 2 * questions
