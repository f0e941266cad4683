"""Consecutive numbers in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netgap.sources.shared import kept


def numbered(df: DataFrame, key: str, out: str, start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in the order of ``key``: range partitions, their sizes, a running number."""
    placed = kept(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    rows, before = [], start - 1
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _before long")
    return placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_before") + F.col("_r")).drop("_p", "_before", "_r")
