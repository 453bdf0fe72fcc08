"""A keyed vector collection as Parquet: a base, and the changes since then, each a folder that Spark writes once and nothing alters.

Layout: <root>/<name>/data/<id> holds rows partitioned by mission; <root>/<name>/current/<n> is a marker, the largest of which counts: it names the base, the changes
since then in order, and how many rows each has. A change has rows that came or were replaced, and ids that went; readers take each id's last word. So a write costs
what changes, not the collection. When the changes together pass SHARE of the base, or are CHANGES in number, the write that makes them so writes a new base.

A marker is written under another name and then put in its place, never over another one: of two writers that started from the same version one makes
the next marker, and the other builds its change again from that; a writer that dies at any step leaves at most folders that no marker names. Files have to be put in place
in one step: on HDFS by a rename without overwriting, on a local disk by a link. Object stores whose rename copies don't promise that.
Folders that no reader should still need go with vacuum(). All access goes through Hadoop's file system, so root may be anywhere that Spark can write."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import collection as C
from ..operators.validate import blank, duplicates, violations

SCHEMA = (
    "id string, document string, embedding array<float>, mission string, source string, filepath string, source_type string, data_type string, document_category string, file_type string, "
    "chunk_index int, total_chunks int, token_count int, page_start long, page_end long, source_line_start long, source_line_end long"
)


#: Of rows that go, only id, mission and gone count.
CHANGE = f"{SCHEMA}, gone boolean"

log = logging.getLogger(__name__)

#: Times that a writer builds its change before it gives up; files whose failure is told one by one.
ATTEMPTS, FAILURES = 20, 1000
#: Part of the base's rows, and number, from which on changes are merged into a new base; seconds that a folder without a marker is left alone, as its writer may be at work.
SHARE, CHANGES, GRACE = 0.25, 32, 3600


def _names(ddl: str) -> list[str]:
    return [f.strip().split(" ", 1)[0] for f in ddl.split(", ")]


class Lost(RuntimeError):
    """Another writer has made the next version."""


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, create: bool = True):
        if not name.strip():
            raise ValueError("the collection's name must not be blank")
        self.spark, self.name, self.at = spark, name, f"{root.rstrip('/')}/{name}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.version() is None:
            if not create:
                raise FileNotFoundError(f"no collection {name}")
            try:
                self._commit(0, spark.createDataFrame([], CHANGE))
            except Lost:
                pass  # another one has just made it

    def version(self) -> int | None:
        return max(self._markers(), default=None)

    def _markers(self) -> list[int]:
        at = self._path(f"{self.at}/current")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getLen() > 0 and s.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _marker(self, version: int) -> dict:
        """parts: the base's folder and those of the changes, each with its number of rows; streams: the last batch of each stream that wrote here."""
        stream = self._fs.open(self._path(f"{self.at}/current/{version}"))
        try:
            told = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(told) if told.startswith("{") else {"parts": [[told, None]], "streams": {}}

    def _put(self, version: int, marker: dict) -> None:
        """The marker of version, whole or not at all; Lost if there is one."""
        jvm, target = self.spark.sparkContext._jvm, self._path(f"{self.at}/current/{version}")
        if self._fs.exists(target) and self._fs.getFileStatus(target).getLen() == 0:
            self._fs.delete(target, False)  # of a writer that died, as markers were written in place once
        draft = self._path(f"{self.at}/current/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(marker).encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                place = lambda p: jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(place(target), place(draft))
                self._fs.delete(draft, False)
            else:
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), plain)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Lost from e
            raise

    def _write(self, rows: DataFrame) -> list:
        """A new folder of rows, and how many they are (by their files' footers)."""
        name = uuid.uuid4().hex
        rows.write.partitionBy("mission").parquet(f"{self.at}/data/{name}")
        return [name, self.spark.read.schema(rows.schema).parquet(f"{self.at}/data/{name}").count()]

    def _commit(self, base: int, change: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """The state after version base, with change (SCHEMA and gone); Lost if there is another one already."""
        before = self._marker(base) if base and base in self._markers() else {"parts": [], "streams": {}}
        made = [self._write(change if before["parts"] else change.where("NOT gone").drop("gone"))]
        parts = [*before["parts"], *made]
        first, later = parts[0][1], sum(n for _, n in parts[1:])
        if len(parts) > 1 and (first is None or later > SHARE * first or len(parts) > CHANGES + 1):
            parts = [self._write(self._merged(parts))]
            made += parts
        try:
            self._put(base + 1, {"parts": parts, "streams": before["streams"] | (dict([stream]) if stream else {})})
        except Lost:
            self._drop(name for name, _ in made)
            raise
        self._drop(name for name, _ in made if name not in [x for x, _ in parts])

    def _drop(self, names: Iterable[str]) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.at}/data/{name}"), True)

    def _merged(self, parts: list) -> DataFrame:
        """Each id's last word. Ids of the changes are few beside the base, so that they, and not its rows, travel."""
        base, *changes = (f"{self.at}/data/{name}" for name, _ in parts)
        rows = self.spark.read.schema(SCHEMA).parquet(base)
        if not changes:
            return rows
        told = reduce(DataFrame.unionByName, (self.spark.read.schema(CHANGE).parquet(at).withColumn("_n", F.lit(i)) for i, at in enumerate(changes)))
        last = told.groupBy("id").agg(F.max("_n").alias("_n"))
        now = told.join(last, ["id", "_n"], "left_semi").where("NOT gone").select(*rows.columns)
        return rows.join(last.select("id"), "id", "left_anti").select(*rows.columns).unionByName(now)

    def _change(self, step: Callable[[DataFrame], tuple[DataFrame | None, Any]], stream: tuple[str, int] | None = None) -> Any:
        """step gives the change (None: nothing changes) and what to tell of it, from the stored rows; again, if another writer was faster."""
        for _ in range(ATTEMPTS):
            base = self.version() or 0
            change, told = step(self.rows(base))
            if change is None:
                return told
            try:
                self._commit(base, change, *([stream] if stream else []))
                return told
            except Lost:
                continue
        raise Lost(f"{ATTEMPTS} times another writer was faster")

    def compact(self) -> bool:
        """Merges all changes into a new base, as a version of its own; whether there were any."""
        base = self.version()
        marker = self._marker(base)
        if len(marker["parts"]) == 1:
            return False
        part = self._write(self._merged(marker["parts"]))
        try:
            self._put(base + 1, marker | {"parts": [part]})
        except Lost:
            self._drop([part[0]])
            raise
        return True

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> int:
        """Removes the folders that only versions before the last keep need, and those that no marker names and that are older than grace seconds; returns how many."""
        marks = self._markers()
        named = {v: {name for name, _ in self._marker(v)["parts"]} for v in marks}
        held = set().union(*(named[v] for v in marks[-max(1, keep) :]))
        known, now = set().union(*named.values()), time.time()
        gone = []
        for s in self._fs.listStatus(self._path(f"{self.at}/data")):
            name = s.getPath().getName()
            if name not in held and (name in known or s.getModificationTime() / 1000 < now - grace):
                gone.append(name)
        for v in marks[: -max(1, keep)]:
            self._fs.delete(self._path(f"{self.at}/current/{v}"), False)  # first, so that no marker names what isn't there
        self._drop(gone)
        return len(gone)

    def rows(self, version: int | None = None) -> DataFrame:
        return self._merged(self._marker(self.version() if version is None else version)["parts"])

    def count(self) -> int:
        return self.rows().count()

    def get(self, *ids: str) -> DataFrame:
        return self.rows().where(F.col("id").isin(*ids))

    def file_rows(self, mission: str, filepath: str) -> DataFrame:
        """Both filters reach the scan: the mission prunes partitions."""
        return self.rows().where((F.col("mission") == mission) & (F.col("filepath") == filepath))

    def write(self, incoming: DataFrame, mode: str = "skip") -> dict[str, int]:
        """Checks everything, then makes the next state. Counts: added, updated, skipped."""
        prepared = prepare(incoming)
        if mode == "replace" and prepared.select("mission", "filepath").distinct().count() > 1:
            raise ValueError("replace takes one file at a time")
        told = self.write_files(prepared, mode)
        return {k: sum(own[k] for own in told.values()) for k in ("added", "updated", "skipped")}

    def write_files(self, prepared: DataFrame, mode: str, stream: tuple[str, int] | None = None) -> dict[str, dict[str, int]]:
        """Rows of any number of files, prepared, as one version; counts for each mission. In replace mode each file replaces its own rows. stream: the name and batch
        number of a stream's rows, which count once, however often they come."""
        if stream and self._marker(self.version())["streams"].get(stream[0], -1) >= stream[1]:
            return {}

        def step(stored: DataFrame) -> tuple[DataFrame, dict]:
            counts = C.upsert_counts(stored, prepared, mode, by=("mission",)).collect()  # a line for each mission
            return C.changes(stored, prepared, mode).select(*_names(CHANGE)), {r["mission"]: {k: r[k] for k in ("added", "updated", "skipped")} for r in counts}

        return self._change(step, stream)

    def delete_source(self, part: str) -> int:
        def step(stored: DataFrame) -> tuple[DataFrame | None, int]:
            gone = C.with_source(stored, part)
            n = gone.count()
            return gone.withColumn("gone", F.lit(True)).select(*_names(CHANGE)) if n else None, n

        return self._change(step)

    def stats(self) -> DataFrame:
        rows = self.rows()
        facets = C.facet_counts(rows, {"mission": F.col("mission"), "data_type": X.first_filled("data_type", "source_type"), "document_category": X.first_filled("document_category", "source_type"), "file_type": F.col("file_type")})
        totals = rows.agg(F.count("*").alias("chunks"), F.count_distinct("filepath").alias("files")).unpivot([], ["chunks", "files"], "value", "n").select(F.lit("total").alias("facet"), "value", "n")
        return facets.unionByName(totals)


def keyed(incoming: DataFrame) -> DataFrame:
    """incoming(document, mission or collection, source, ..., chunk_index) with canonical mission, source, filepath and id."""
    have = set(incoming.columns)
    pick = lambda *cs: X.first_filled(*(c for c in cs if c in have)) if any(c in have for c in cs) else F.lit(None).cast("string")
    from ..operators.chunks import chunk_id

    named = incoming.withColumns({"mission": X.mission_key(pick("collection", "mission")), "source": pick("source", "doc_id", "source_file"), "filepath": pick("source_path", "filepath")})
    return named.withColumn("id", chunk_id("mission", "source", "chunk_index"))


def checks() -> dict[str, Column]:
    """What a keyed row that can't be stored breaks."""
    return {"mission": F.col("mission").isNull(), "source": blank("source"), "filepath": blank("filepath"), "document": blank("document"), "id": F.col("id").isNull()}


def stored_columns(rows: DataFrame) -> DataFrame:
    wanted = [f.strip().split(" ", 1) for f in SCHEMA.split(", ")]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted))


def prepare(incoming: DataFrame) -> DataFrame:
    """Keyed rows with the stored columns; ValueError with counts if any row can't be stored."""
    rows = keyed(incoming)
    bad = {r["check"]: r["n"] for r in violations(rows, checks()).collect() if r["n"]}
    if twice := duplicates(rows, "id").count():
        bad["repeated ids"] = twice
    if bad:
        raise ValueError(f"rows that can't be stored: {bad}")
    return stored_columns(rows)


def discover(spark: SparkSession, root: str) -> dict[str, str]:
    """Readable collections below root by name, with a label that tells their rows; others are passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for name in sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []:
        try:
            out[name] = f"{name} ({Collection(spark, root, name, create=False).count()} rows)"
        except Exception:  # noqa: BLE001  an unreadable collection is no collection
            continue
    return out


def broken_files(rows: DataFrame) -> DataFrame:
    """(filepath, why) of keyed rows: the files that hold rows that can't be stored, or ids that other rows have too."""
    twice = duplicates(rows.where("id is not null"), "id").select("id", F.lit(True).alias("_twice"))
    own = checks()
    told = [*own, "repeated ids"]
    # Told before the join, so that no text travels with it.
    flags = rows.select("id", "filepath", *(F.coalesce(c, F.lit(False)).alias(f"_c{i}") for i, c in enumerate(own.values())))
    flags = flags.join(twice, "id", "left").withColumn(f"_c{len(own)}", F.col("_twice").isNotNull())
    counts = flags.groupBy("filepath").agg(*(F.count_if(f"_c{i}").alias(f"_n{i}") for i in range(len(told))))
    broken = [F.when(F.col(f"_n{i}") > 0, F.concat(F.lit(f"{k}: "), F.col(f"_n{i}").cast("string"))) for i, k in enumerate(told)]
    why = F.concat(F.lit("ValueError: rows that can't be stored: "), F.concat_ws(", ", *broken))
    return counts.where(F.coalesce(*broken).isNotNull()).select("filepath", why.alias("why"))


def ingest(collection: Collection, chunks: DataFrame, mode: str, embed: Callable[[DataFrame], DataFrame]) -> dict:
    """Chunks of any number of files, told by their paths, as one version of the collection. A file with rows that can't be stored is counted and told with the reason, and the
    others go on; where embedding fails, files are written one by one, so that a file's failure is its own. Missions are counted under their canonical key."""
    rows = keyed(chunks).persist()
    try:
        bad = broken_files(rows).persist()
        good = rows.join(bad.select(F.col("filepath").alias("_bad")), F.col("filepath").eqNullSafe(F.col("_bad")), "left_anti")
        out: dict = {"files_processed": 0, "documents_added": 0, "documents_updated": 0, "documents_skipped": 0, "errors": bad.count(), "missions": {}, "failures": []}
        out["failures"] = [(r["filepath"], r["why"]) for r in bad.orderBy("filepath").limit(FAILURES).collect()]
        files = good.groupBy("mission").agg(F.count_distinct("filepath").alias("files"), F.count("*").alias("chunks")).collect()  # a line for each mission
        if files:
            try:
                counts = collection.write_files(stored_columns(embed(good)), mode)
            except Lost:
                raise
            except Exception as e:  # noqa: BLE001  of some file's text; which one is found by writing them alone
                log.warning("one write for all files failed, files are written one by one: %s", e)
                return _one_by_one(collection, good, mode, embed, out)
            for r in files:
                own = counts.get(r["mission"], {"added": 0, "updated": 0, "skipped": 0})
                out["missions"][r["mission"]] = {"files": r["files"], "chunks": r["chunks"], **own}
                out["files_processed"] += r["files"]
                for k, v in own.items():
                    out[f"documents_{k}"] += v
        return _told(out)
    finally:
        rows.unpersist()


def _one_by_one(collection: Collection, good: DataFrame, mode: str, embed: Callable[[DataFrame], DataFrame], out: dict) -> dict:
    for r in good.groupBy("filepath", "mission").agg(F.count("*").alias("n")).orderBy("filepath").toLocalIterator():
        own = out["missions"].setdefault(r["mission"], {"files": 0, "chunks": 0, "added": 0, "updated": 0, "skipped": 0})
        try:
            counts = collection.write_files(stored_columns(embed(good.where(F.col("filepath") == r["filepath"]))), mode)[r["mission"]]
        except Exception as e:  # noqa: BLE001  one file's failure is its own
            out["errors"] += 1
            out["failures"] += [(r["filepath"], f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")][: max(0, FAILURES - len(out["failures"]))]
            continue
        out["files_processed"] += 1
        own["files"] += 1
        own["chunks"] += r["n"]
        for k, v in counts.items():
            own[k] += v
            out[f"documents_{k}"] += v
    out["missions"] = {k: v for k, v in out["missions"].items() if v["files"]}
    return _told(out)


def _told(out: dict) -> dict:
    for path, why in out["failures"]:
        log.warning("%s was not stored: %s", path, why)
    log.info("%d files, %d chunks added, %d updated, %d skipped, %d failed", out["files_processed"], out["documents_added"], out["documents_updated"], out["documents_skipped"], out["errors"])
    return out
