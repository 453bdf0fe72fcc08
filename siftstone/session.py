"""Sessions, and how Python workers find the package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that Python holds as objects at once, and characters of output after which a piece of it goes: texts are long, and an Arrow batch has 10,000 of them.
SLICE, PIECE = 128, 4_000_000


def local_session(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """For tests and benchmarks; on a cluster the caller's session is used as it is."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions or cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("siftstone").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. A cluster whose machines don't have it there ships it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, in tests on one machine, a folder in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; later reads survive the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def map_rows(df: DataFrame, ddl: str, rows: Callable[..., Iterable[tuple]]) -> DataFrame:
    """rows(*values) gives the output rows of one row. Memory of a task: an Arrow batch, which Spark bounds in rows and bytes, SLICE rows as objects, a piece of output and what one row gives."""
    ship(df.sparkSession)
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    def piece(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, SLICE).columns), strict=True):
                    for made in rows(*row):
                        out.append(made)
                        held += 32 + sum(len(v) for v in made if isinstance(v, str))
                        if held >= PIECE:
                            yield piece(out)
                            out, held = [], 0
        if out:
            yield piece(out)

    return df.mapInArrow(run, ddl)
