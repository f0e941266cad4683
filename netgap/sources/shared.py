"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings of executions whose result is written: shuffle files go when the execution ends, and Arrow batches are bounded
#: by bytes, since 10,000 rows of text would be held several times at once.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests), a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='netgap-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, the settings of ``WRITING`` hold."""
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` after a round trip through Parquet: its lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def merged(df: DataFrame) -> DataFrame:
    """``df``, never broadcast for the size of its files: Parquet packs regular numbers a hundredfold, and the driver
    would hold them unpacked."""
    return df.hint("merge")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``written``, for tables that grow with the input: joins with it sort and merge."""
    table = written(df, name)
    out = merged(table)
    out.written_to = table.written_to
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.written_to)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
