"""What a task's Python holds doesn't grow with its rows."""

import resource
import tracemalloc

import numpy as np
import pandas as pd

from siftstone.operators import chunks, reports, search
from siftstone.plans import parsers


def test_output_of_many_files_leaves_in_pieces(spark):
    files = spark.range(300).selectExpr("concat('f', id) AS path", "'x' AS value").coalesce(1)

    def rows(path, value):
        return [(path, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10, path + "y" * 2_000_000)]

    got = parsers.folded(files, "path string, mb long, text string", rows).selectExpr("path", "mb", "length(text) AS n").collect()
    assert len(got) == 300 and min(r.n for r in got) > 2_000_000
    assert max(r.mb for r in got) < 450


def test_chunks_leave_python_as_one_array(spark):
    docs = spark.createDataFrame([(None, "a b c " * 400, "report"), (2, " ", "report"), (3, "one", "other")], "n int, text string, source_type string")
    made = chunks.packed_chunks(docs)
    assert "Generate inline" in made._jdf.queryExecution().toString()
    got = sorted(made.select("n", "chunk_index", "total_chunks", "token_count", "source_type").collect(), key=str)
    assert [tuple(r) for r in got] == [(3, 0, 1, 1, "other"), (None, 0, 3, 500, "report"), (None, 1, 3, 500, "report"), (None, 2, 3, 400, "report")]


def test_distances_held_at_once():
    rows = pd.DataFrame({"id": range(20_000), "_v": list(np.random.default_rng(1).normal(size=(20_000, 8))), "_n": 1.0})
    part, asked = search.Part(rows, None), np.random.default_rng(2).normal(size=(400, 8))
    tracemalloc.start()
    found = sum(len(ids) for _, ids, *_ in part.nearest(np.arange(400), asked, None, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2000 and peak < 50 << 20


def test_kinds_of_characters_beyond_ascii():
    for s in ("", "Straße 12, ÄÖÜ — «x» ٣ ǅ ²", "ABC def 12.5; \x1c\t\x00", "ñ", "٣٤"):
        told = [(c.isalpha(), c.isdigit(), not c.isspace() and not c.isalnum(), c.islower(), not c.isspace()) for c in s]
        c = reports.Counts.of(s)
        assert [c.alpha, c.digit, c.punct, c.lower, c.solid] == [sum(k[i] for k in told) for i in range(5)]
    assert reports.bare_page("ſaturn v launch vehicle flight evaluation report x\nText\nNaſa SP-12") == "Text"
