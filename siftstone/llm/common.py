"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import session
from ..session import shared_dir

#: Rows that Python holds as objects at once, and rows of an Arrow batch: texts are long, and Spark's 10,000 of them crowd a worker.
SLICE, BATCH = 256, 1000
#: So many keys can be hot, with more than so many rows; parts that a hot key's rows are dealt to.
HOT, HOT_ROWS, SALTS = 500, 100_000, 64
#: Bytes of an emitted or a shuffled partition aimed at; rows of a few numbers that may travel to every task.
PART_BYTES, BROADCAST_ROWS = 64 << 20, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_name(column: str) -> str:
    """A column's name as it is, dots included."""
    return f"`{column.replace('`', '``')}`"


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; later reads survive the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Let Python workers find the package, and keep Arrow batches to BATCH rows unless the session says otherwise."""
    session.ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, str(BATCH))


def hot_values(counts: DataFrame, key: str, n: str = "n") -> list:
    """Of counts(key, n) the HOT values with the most rows, if more than HOT_ROWS: whatever the table's size, any other value has less than the HOT-th part of all rows or few."""
    return [r[0] for r in counts.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n)).limit(HOT).select(key).collect()]


def salted_join(rows: DataFrame, small: DataFrame, hot: list, key: str = "u") -> DataFrame:
    """rows joined with small, which has a value of key once: rows of a hot value are dealt to SALTS parts, and so are copies of its row of small."""
    if not hot:
        return rows.join(small, key)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file system: path may be anywhere that Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_slices(df: DataFrame, ddl: str, start: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """start() runs once in a task; what it returns makes the output rows of the columns (lists) of at most SLICE rows. Memory: one Arrow batch and a slice."""
    ship(df.sparkSession)
    schema = to_arrow_schema(schema_of(ddl))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                out = f(*(c.to_pylist() for c in batch.slice(i, SLICE).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return df.mapInArrow(rows, ddl)


def map_rows(df: DataFrame, ddl: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """As map_slices, for functions of one row."""

    def each():
        f = start()
        return lambda *columns: [f(*row) for row in zip(*columns, strict=True)]

    return map_slices(df, ddl, each)
