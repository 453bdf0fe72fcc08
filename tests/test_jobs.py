"""The jobs: two runs over growing input, restarts, and brute force on small tables with nulls, repeats and blanks."""

import hashlib
import json
import re
import shutil
from pathlib import Path

import pytest

from jobs import chunk_ingest, config, curate

DOCS = "doc_id long, text string, lang string, source string, mission string, document string, `key` int, batch string"


def write(spark, at, rows):
    """rows: (doc_id, text, lang), with columns that clash with names of the jobs."""
    spark.createDataFrame([(i, t, lang, "Src 1.txt", "m", "d", 1, "b") for i, t, lang in rows], DOCS).coalesce(1).write.mode("append").parquet(str(at))


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def stored(spark, at):
    return sorted(tuple(r) for r in chunk_ingest.stored(spark, str(at)).select("doc_id", "id", "chunk_index", "total_chunks", "token_count", "document", "mission", "batch").collect())


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / x) for x in ("documents", "chunks", "mark")]


def test_two_runs_over_growing_input(spark, places):
    docs, out, mark = places
    write(spark, docs, [(1, words(0, 12), "en"), (2, "two", "12"), (3, "", "en"), (None, "no id", "en"), (4, None, "de"), (5, " spaced  out ", None)])
    run = lambda: chunk_ingest.ingest(spark, docs, out, mark, size=5, overlap=2)
    assert run() == {"batches": 1, "rows_read": 6, "documents": 3, "chunks": 6}
    first = stored(spark, out)
    assert [(r[0], r[5], r[6]) for r in first if r[0] != 1] == [(2, "two", "12"), (5, "spaced  out", "unknown")]
    assert all(r[1] == f"{r[6]}::src_1_{r[0]}::chunk_{r[2]:04d}" for r in first)
    assert [r[5] for r in first if r[0] == 1] == [words(0, 5), words(3, 8), words(6, 11), words(9, 12)]
    # Nothing new: no batch, the same files.
    assert run() == {"batches": 0, "rows_read": 0, "documents": 0, "chunks": 0}
    assert stored(spark, out) == first
    # Id 1 comes again with another text and is skipped; so is one of two rows of id 7, the one with the larger digest.
    write(spark, docs, [(1, "changed", "en"), (7, "seven", "fr"), (7, "sieben", "de"), (7, "sieben", "de")])
    assert run() == {"batches": 1, "rows_read": 4, "documents": 1, "chunks": 1}
    grown = stored(spark, out)
    assert [r for r in grown if r[0] != 7] == first and all(r[7] == 0 for r in first)
    digest = lambda t, lang: hashlib.sha256("\x01".join((lang, "Src 1.txt", t)).encode()).hexdigest()
    (seven,) = [r for r in grown if r[0] == 7]
    assert seven[5] == min(("seven", "fr"), ("sieben", "de"), key=lambda x: digest(*x))[0] and seven[7] == 1
    assert len({r[1] for r in grown}) == len(grown)


def test_one_run_or_many_give_the_same_chunks(spark, places, tmp_path):
    docs, out, mark = places
    parts = [[(i, words(i, 3 * i + 1), "en") for i in range(k, 40, 3)] for k in range(3)]
    for part in parts:
        write(spark, docs, part)
        chunk_ingest.ingest(spark, docs, out, mark, size=7, overlap=3)
    whole = [str(tmp_path / x) for x in ("whole", "mark2")]
    chunk_ingest.ingest(spark, docs, *whole, size=7, overlap=3)
    assert [r[:-1] for r in stored(spark, out)] == [r[:-1] for r in stored(spark, whole[0])]
    apart = [str(tmp_path / x) for x in ("apart", "mark3")]
    assert chunk_ingest.ingest(spark, docs, *apart, size=7, overlap=3, files_per_batch=1)["batches"] == 3
    assert [r[:-1] for r in stored(spark, apart[0])] == [r[:-1] for r in stored(spark, out)]


def test_a_batch_that_is_run_again_overwrites_itself(spark, places):
    """A run that dies between its output and its mark takes the same batch again."""
    docs, out, mark = places
    for part in ([(1, "one", "en")], [(2, "two", "en"), (1, "other", "en")]):
        write(spark, docs, part)
        chunk_ingest.ingest(spark, docs, out, mark)
    before = stored(spark, out)
    (place,) = Path(mark).glob("commits/1")
    place.unlink()
    (place.parent / ".1.crc").unlink(missing_ok=True)
    assert chunk_ingest.ingest(spark, docs, out, mark)["documents"] == 1
    assert stored(spark, out) == before


def test_an_output_of_another_checkpoint_is_refused(spark, places, tmp_path):
    docs, out, mark = places
    for i in (1, 2):
        write(spark, docs, [(i, "text", "en")])
        chunk_ingest.ingest(spark, docs, out, mark)
    held = stored(spark, out)
    with pytest.raises(Exception, match="don't belong together"):
        chunk_ingest.ingest(spark, docs, out, str(tmp_path / "new mark"))
    assert stored(spark, out) == held


def test_ids_of_one_source_are_apart(spark, places):
    docs, out, mark = places
    write(spark, docs, [(i, "text", "en") for i in (1, -1, 11, -11, 0)])
    chunk_ingest.ingest(spark, docs, out, mark)
    assert len({r[1] for r in stored(spark, out)}) == 5


def test_no_rows(spark, places):
    docs, out, mark = places
    write(spark, docs, [])
    assert chunk_ingest.ingest(spark, docs, out, mark)["chunks"] == 0
    assert stored(spark, out) == []
    write(spark, docs, [(1, "one", "en")])
    assert chunk_ingest.ingest(spark, docs, out, mark)["chunks"] == 1


def brute(rows, least):
    """What curate says of rows (doc_id, text, lang), by its words."""

    def clean(t):
        t = re.sub(r"([A-Za-z]+)-\s*\n\s*([a-z]+)", r"\1\2", t or "")
        return re.sub(r"\s+", " ", re.sub(r"\s*\n\s*", " ", t)).strip()

    told = {}
    for i, t, lang in rows:
        told.setdefault((clean(t).lower(), i), []).append((lang or "unknown", clean(t)))
    out = []
    for (key, i), own in told.items():
        (mission, text), n = min(own), len(clean(own[0][1]).split(" ")) if key else 0
        letters, digits = len(re.findall("[A-Za-z]{2,}", text)), len(re.findall(r"\d", text))
        signs, alpha = len(re.findall(r"[^\w\s]|_", text)), sum(c.isalpha() for c in text)
        smaller = any(k == key and j is not None and i is not None and j < i for k, j in told)
        noise = letters == 0 or letters < 5 and digits + signs > max(alpha, 1)
        status = "no_id" if i is None else "blank" if not text else "short" if n < least else "noise" if noise else "duplicate" if smaller else "kept"
        out.append((i, n, len(own), hashlib.sha256(key.encode()).hexdigest(), text if status == "kept" else None, status, mission))
    return sorted(out, key=str)


ROWS = [(1, "A line that is bro-\n ken here", "en"), (2, "a LINE  that is\nbroken HERE", "de"), (None, "a line that is broken here", "en"), (3, "", "en"), (4, None, None), (5, "too short", "en")]
ROWS += [(6, "1 2 3 4 5 6 ! ? .", "en"), (7, "five words are just enough", ""), (7, "five words are just enough", "en"), (7, "five words are just enough", "en"), (7, "but this id has another text", "en"), (None, None, "en")]


def test_curated_rows_are_the_brute_ones(spark, tmp_path):
    docs, out = str(tmp_path / "d"), str(tmp_path / "o")
    write(spark, docs, [])
    assert curate.curate(spark, docs, out) == {}
    rows = ROWS + [(i, "the same text for all of these", "en") for i in range(100, 300)]
    write(spark, docs, rows)
    told = curate.curate(spark, docs, out)
    read = lambda: sorted(((r["doc_id"], r["n_words"], r["copies"], r["digest"], r["document"], r["status"], r["mission"]) for r in spark.read.schema(curate.ROWS).parquet(f"{out}/documents").collect()), key=str)
    found = read()
    assert found == brute(rows, 5)
    assert told == {s: sum(r[5] == s for r in found) for s in {r[5] for r in found}} and told["kept"] == 4 and told["duplicate"] == 200
    assert sum(r["rows"] for r in spark.read.json(f"{out}/summary").collect()) == len(rows)
    # Again, and with a text less: nothing of before stays.
    assert curate.curate(spark, docs, out) == told and read() == found
    shutil.rmtree(docs)
    write(spark, docs, ROWS)
    curate.curate(spark, docs, out, least_words=2)
    assert read() == brute(ROWS, 2)


def test_hot_copies_do_not_meet_in_one_task(spark):
    """Rows are dealt by digest and id together, never by digest alone with their texts."""
    plan = curate.judged(spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string"))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.match(r"key#\d+, doc_id#\d+L?, \d+$|key#\d+, \d+$", x) for x in dealt) and sum("doc_id" in x for x in dealt) == 2


def test_settings(tmp_path):
    given = tmp_path / "own.json"
    given.write_text(json.dumps({"documents": "/in", "output": "/out", "checkpoint": "/mark", "size": 9}))
    told = config.settings("chunk_ingest", "", ["--config", str(given), "--overlap", "3"])
    assert told == {"documents": "/in", "output": "/out", "checkpoint": "/mark", "facet": "lang", "size": 9, "overlap": 3, "files_per_batch": 1000}
    assert set(config.settings("curate", "", ["--documents", "a", "--output", "b"])) == {"documents", "output", "facet", "least_words"}
    for argv in ([], ["--documents", "a", "--output", "b", "--least-words", "x"]):
        with pytest.raises(SystemExit) as e:
            config.settings("curate", "", argv)
        assert e.value.code == 2
    given.write_text('{"other": 1}')
    with pytest.raises(SystemExit):
        config.settings("curate", "", ["--config", str(given)])


def test_bad_sizes_are_refused_before_anything_starts(spark, places):
    with pytest.raises(ValueError):
        chunk_ingest.ingest(spark, *places, size=5, overlap=5)
    with pytest.raises(ValueError):
        curate.curate(spark, places[0], places[1], least_words=-1)
