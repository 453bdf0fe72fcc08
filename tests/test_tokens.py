"""Chunk sizes in tokens of a real tokenizer."""

import base64
import os
import pickle
import random

import pytest

from siftstone import app, models
from siftstone.operators import chunks

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")
DOCS = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet"


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("brute", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_encoders(spark, encoder):
    count, rng = models.TokenCounter(PATH, remembered=50), random.Random(1)
    pieces = [" ", "\n", "word", "Ω", "漢", "12", "'s", "<|endoftext|>", "😀", "-", "é"]
    for _ in range(500):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert count(t) == count(t) == len(encoder.encode_ordinary(t))
    for r in spark.read.parquet(DOCS).select("text").collect():
        assert count(r.text) == len(encoder.encode_ordinary(r.text))
    assert len(count._known) <= 50 and pickle.loads(pickle.dumps(count))("some words") == count("some words")


@pytest.mark.parametrize(("size", "overlap"), [(60, 12), (500, 100)])
def test_chunks_are_bounded_in_tokens(spark, encoder, size, overlap):
    docs = spark.read.parquet(DOCS).selectExpr("doc_id", "text", "'transcript' AS source_type")
    made = chunks.packed_chunks(docs, "text", "source_type", size, overlap, models.TokenCounter(PATH))
    found = {}
    for r in made.orderBy("doc_id", "chunk_index").collect():
        assert r.token_count == len(encoder.encode_ordinary(r.chunk)) <= size
        found.setdefault(r.doc_id, []).append(r)
    count = lambda t: len(encoder.encode_ordinary(t))
    for r in docs.collect():
        own, text = found.get(r.doc_id, []), r.text.strip()
        assert [x.chunk_index for x in own] == list(range(len(own))) and {x.total_chunks for x in own} <= {len(own)}
        whole = [] if not text else [text] if count(text) <= size else chunks.pack(text, count, size, overlap, ("\n",))
        assert [x.chunk for x in own] == whole
        if text and r.doc_id % 5 == 0:  # without overlap the chunks are the text
            assert "".join(chunks.pack(text, count, size, 0, ("\n",))).split() == text.split()


def test_a_chunk_above_its_pieces_is_an_error():
    with pytest.raises(RuntimeError, match="pieces"):
        chunks.pack("a b c d", lambda s: len(s.split()) ** 2, 3, 0, ("\n",))


def test_ingest_counts_tokens(spark, tmp_path):
    records = spark.createDataFrame([("a_report_00000", "unquestionably " * 40, "apollo_11")], "id string, document string, collection string")
    meta = "named_struct('collection', collection, 'mission', 'Apollo 11', 'source_type', 'report', 'source_file', 'a.txt', 'source_path', '/a.txt', 'doc_id', 'a', 'page_start', 1L, 'page_end', 1L) AS metadata"
    rows = records.selectExpr("id", "document", meta)
    by_words, by_tokens = app.file_chunks(rows, 50, 5).count(), app.file_chunks(rows, 50, 5, models.TokenCounter(PATH)).count()
    assert by_words == 1 < by_tokens
    assert app.parser().parse_args(["ingest", "--token-ranks", PATH]).token_ranks == PATH
