"""Collections as a base and changes: what a write costs, writers that die, and states against the plain algebra."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftstone.operators import collection as C
from siftstone.sources import store
from siftstone.streaming import ingest

CHUNK = "document string, mission string, source string, source_path string, source_type string, chunk_index int"


def chunk(spark, *rows):
    return spark.createDataFrame(rows, CHUNK)


def rows_of(ids, text="text"):
    """Chunks of files of ten."""
    return [(f"{text} {i} " + "x" * 300, ("Apollo 11", "STS-51L")[i // 10 % 2], f"f{i // 10}.txt", f"/f{i // 10}", "report", i % 10) for i in ids]


def told(c):
    return sorted((r.id, r.document[:12], r.mission, r.filepath) for r in c.rows().collect())


def size(at):
    return {p: p.stat().st_size for p in Path(at).rglob("*.parquet")}


class Died(BaseException):
    pass


def test_a_small_write_is_small(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "c")
    c.write(chunk(spark, *rows_of(range(20_000))))
    before = size(tmp_path)
    for mode, more in (("update", rows_of(range(200), "new")), ("skip", rows_of(range(19_900, 20_100))), ("update", rows_of(range(400, 600), "again"))):
        have = size(tmp_path)
        c.write(chunk(spark, *more).coalesce(1), mode)
        assert sum(v for k, v in size(tmp_path).items() if k not in have) <= 0.03 * sum(before.values())
    assert c.count() == 20_100 and c.rows().where("document like 'new %' or document like 'again %'").count() == 400
    assert c.compact() and not c.compact() and c.count() == 20_100 and len(c._marker(c.version())["parts"]) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_states_are_those_of_the_algebra(spark, tmp_path, monkeypatch, seed):
    """Random writes of all modes, deletions, merges: after each the rows are upsert()'s."""
    monkeypatch.setattr(store, "SHARE", 0.8)
    monkeypatch.setattr(store, "CHANGES", 4)
    rng, c = random.Random(seed), store.Collection(spark, str(tmp_path), "c")
    state = spark.createDataFrame([], store.SCHEMA)
    most = 0
    for step in range(9):
        if step % 4 == 3:
            part = f"f{rng.randrange(4)}."
            gone = c.delete_source(part)
            assert gone == C.with_source(state, part).count()
            state = C.without_source(state, part)
        else:
            mode = C.MODES[step % 3] if step else "skip"
            new = store.prepare(chunk(spark, *rows_of(rng.sample(range(60), 40 if not step else 7), f"t{step}")))
            counts = c.write_files(new, mode)
            assert sum(sum(v.values()) for v in counts.values()) == new.count()
            state = C.upsert(state, new, mode)
        state = spark.createDataFrame(state.collect(), store.SCHEMA)
        assert told(c) == sorted((r.id, r.document[:12], r.mission, r.filepath) for r in state.collect()), step
        most = max(most, len(c._marker(c.version())["parts"]))
        assert most <= 5
    assert most > 2
    old = c.version() - 1
    assert c.rows(old).count() >= 0 and c.vacuum(1) > 0 and told(c) == sorted((r.id, r.document[:12], r.mission, r.filepath) for r in state.collect())


@pytest.mark.parametrize("at", ["before the rows", "after the rows", "after the merge", "draft", "before the place", "after the place"])
def test_a_writer_that_dies_stops_no_other(spark, tmp_path, monkeypatch, at):
    c = store.Collection(spark, str(tmp_path), "c")
    c.write(chunk(spark, *rows_of(range(10))))
    if at == "after the merge":
        monkeypatch.setattr(store, "SHARE", 0.0)
    write, put, calls = store.Collection._write, store.Collection._put, []

    def dying_write(self, rows):
        if at == "before the rows":
            raise Died
        out = write(self, rows)
        calls.append(1)
        if at == "after the rows" or at == "after the merge" and len(calls) == 2:
            raise Died
        return out

    def dying_put(self, version, marker):
        if at == "before the place":
            raise Died
        if at == "draft":
            self._fs.create(self._path(f"{self.at}/current/draft-x"), False).close()
            raise Died
        put(self, version, marker)
        if at == "after the place":
            raise Died

    monkeypatch.setattr(store.Collection, "_write", dying_write)
    monkeypatch.setattr(store.Collection, "_put", dying_put)
    with pytest.raises(Died):
        c.write(chunk(spark, *rows_of(range(10, 15))))
    monkeypatch.undo()
    monkeypatch.setattr(store, "ATTEMPTS", 1)
    other = store.Collection(spark, str(tmp_path), "c", create=False)
    assert other.count() == (15 if at == "after the place" else 10)
    other.write(chunk(spark, *rows_of(range(8, 20))))
    assert other.count() == 20 and c.count() == 20
    other.vacuum(1, grace=0)
    assert other.count() == 20


def test_an_empty_marker_of_old_wedges_nothing(spark, tmp_path, monkeypatch):
    c = store.Collection(spark, str(tmp_path), "c")
    c.write(chunk(spark, *rows_of(range(10))))
    (tmp_path / "c" / "current" / str(c.version() + 1)).touch()
    monkeypatch.setattr(store, "ATTEMPTS", 1)
    c.write(chunk(spark, *rows_of(range(10, 12))))
    assert c.count() == 12


def test_vacuum_leaves_what_a_writer_has_just_written(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "c")
    c.write(chunk(spark, *rows_of(range(10))))
    live = c._write(spark.createDataFrame([], store.CHANGE))[0]
    c.vacuum(1)
    assert (tmp_path / "c" / "data" / live).exists() and c.count() == 10
    c.vacuum(1, grace=-1)
    assert not (tmp_path / "c" / "data" / live).exists() and c.count() == 10


def test_a_mission_filter_prunes_base_and_changes(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "c")
    c.write(chunk(spark, *rows_of(range(100))))
    c.write(chunk(spark, *rows_of(range(20), "new")), "update")
    assert len(c._marker(c.version())["parts"]) == 2
    found = c.file_rows("apollo11", "/f0")
    assert sorted(r.document[:3] for r in found.collect()) == ["new"] * 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(mission") >= 2 and "PushedFilters: [IsNotNull(filepath), EqualTo(filepath,/f0)" in plan


def test_streams_of_many_files_replace_and_count_once(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "c")
    c.write(chunk(spark, *rows_of(range(30))))
    src, mark = tmp_path / "in", str(tmp_path / "mark")
    chunk(spark, *rows_of([0, 10, 20], "new")).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(CHUNK).parquet(str(src))
    ingest.stream_upsert(stream(), c, "replace", mark).awaitTermination()
    # Each of the three files has one chunk now, and the stream's batch is known.
    assert [r[1][:3] for r in told(c)] == ["new"] * 3
    version = c.version()
    Path(mark, "commits", "0").unlink()
    Path(mark, "commits", ".0.crc").unlink(missing_ok=True)
    ingest.stream_upsert(stream(), c, "replace", mark).awaitTermination()
    assert c.version() == version
    c.write(chunk(spark, *rows_of([1])))
    assert c._marker(c.version())["streams"] == {mark: 0}


def test_modes_are_checked(spark):
    empty = spark.createDataFrame([], store.SCHEMA)
    with pytest.raises(ValueError):
        C.changes(empty, empty, "merge")
    assert C.changes(empty, empty, "replace").where(F.col("gone")).count() == 0
