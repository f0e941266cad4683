"""Connected components by contraction.

Each round gives every node the neighbour (or itself) with the smallest rank, a hash of its name, and then that one's
choice; edges are renamed by these choices, and loops and repeats go.  The edges that are left shrink from round to
round, whatever the order of names along a chain, so the rounds are few and only the first reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netgap.sources.shared import drop, kept


def _rank(name: str) -> F.Column:
    return F.struct(F.xxhash64(F.col(name), F.lit(77)).alias("h"), F.col(name).alias("v"))


def connected(pairs: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of every node of ``pairs`` (a, b)."""
    edges = kept(pairs.select("a", "b").filter("a is not null and b is not null"), "edges")
    named = None  # node, top: where each node has come to
    while True:
        both = edges.select(F.col("a").alias("node"), _rank("b").alias("r")).union(edges.select("b", _rank("a")))
        near = both.groupBy("node").agg(F.min("r").alias("r"))
        choice = kept(near.select("node", F.least("r", _rank("node")).getField("v").alias("up")), "choice")
        above = choice.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = kept(choice.join(above, "up").select("node", "top"), "parent")
        drop(choice)
        if named is None:
            named = parent
        else:
            old, last = named, parent.select(F.col("node").alias("top"), F.col("top").alias("up"))
            named = kept(named.join(last, "top", "left").select("node", F.coalesce("up", "top").alias("top")), "named")
            drop(old)
        to = parent.select(F.col("node").alias("a"), F.col("top").alias("x"))
        other = parent.select(F.col("node").alias("b"), F.col("top").alias("y"))
        left = edges.join(to, "a").join(other, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        old, edges = edges, kept(left.distinct(), "edges")
        drop(old)
        if parent is not named:
            drop(parent)
        if edges.isEmpty():
            break
    drop(edges)
    least = named.groupBy("top").agg(F.min("node").alias("label"))
    out = kept(named.join(least, "top").select("node", "label"), "labels")
    drop(named)
    return out
