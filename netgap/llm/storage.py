"""The shared folder: intermediate tables, and files that all executors can read."""

from __future__ import annotations

from pyspark.sql import SparkSession

from netgap.sources.shared import delete, drop, new_path, shared_folder, tidy, written

__all__ = ["delete", "drop", "new_path", "shared_folder", "tidy", "write_bytes", "written"]


def write_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """A file in the shared folder, written through Spark's file system layer; returns its path."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_folder(spark)}/{name}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    return path
