"""A street network derived from the relational tables: a comb of streets from ``part``, islands from ``nation``,
origins from ``customer`` and destinations from ``supplier``.  Arithmetic only, so any engine agrees bit for bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netgap.functions import geometry as G
from netgap.operators.network import Network
from netgap.sources.shared import merged

PITCH = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return merged(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def network(spark: SparkSession, sf_dir: str, islands: bool = True) -> Network:
    part = _table(spark, sf_dir, "part")
    v = part.select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 20").alias("r"), (F.col("p_partkey") % 20).alias("c"), "p_size")
    v = v.select("id", "r", "c", "p_size", (F.col("c") * 80.0 + F.col("p_size") % 7).alias("x"), (F.col("r") * 80.0 + F.col("p_size") % 5).alias("y"))
    b = v.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))

    def street(step: int, kind: str, rule: str) -> DataFrame:
        a = v.filter(rule).withColumn("dst", F.col("id") + step)
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        return a.join(b, "dst").select(F.col("id").alias("src"), "dst", F.sqrt(dx * dx + dy * dy).alias("length_m"), F.lit(kind).alias("link_type"), G.line((F.col("x"), F.col("y")), (F.col("x2"), F.col("y2"))).alias("geom"))

    edges = street(1, "h", "c < 19 and (r % 8 = 0 or p_size % 16 = 0)").unionByName(street(20, "v", "r % 8 <> 7 or p_size % 5 = 0"))
    vertices = v.select("id", "x", "y")
    if islands:
        n = F.col("n_nationkey")
        isl = _table(spark, sf_dir, "nation").select((10000000 + 2 * n).cast("long").alias("s"), (10000001 + 2 * n).cast("long").alias("t"), F.when(n % 2 == 1, -130.0).otherwise(-1000.0).alias("x"), (n * 160.0 + 40.0).alias("y"))
        vertices = vertices.union(isl.select("s", "x", "y")).union(isl.select("t", F.col("x") + 50.0, "y"))
        edges = edges.unionByName(isl.select(F.col("s").alias("src"), F.col("t").alias("dst"), F.lit(50.0).alias("length_m"), F.lit("i").alias("link_type"), G.line((F.col("x"), F.col("y")), (F.col("x") + 50.0, F.col("y"))).alias("geom")))
    return Network(merged(vertices), merged(edges))  # a union does not pass on the hints of its parts


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: k, x, y, geom, w."""
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(k.alias("k"), ((k % 20) * 80.0 + 15.0).alias("x"), (F.expr("c_custkey div 20") * 80.0 + 15.0).alias("y"), (1.0 + F.col("c_nationkey") % 5).alias("w"))
    return c.withColumn("geom", G.point(F.col("x"), F.col("y")))


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers: k, x, y, geom, w."""
    k = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier").select(k.alias("k"), (((k * 7) % 20) * 80.0 + 10.0).alias("x"), (k * 80.0 - 5.0).alias("y"), F.lit(1.0).alias("w"))
    return s.withColumn("geom", G.point(F.col("x"), F.col("y")))


#: The same relations as common table expressions for DuckDB.
SQL = """
with recursive v as (select p_partkey id, p_partkey//20 r, p_partkey%20 c, p_size,
  (p_partkey%20)*80e0 + (p_size%7) x, (p_partkey//20)*80e0 + (p_size%5) y from part),
e0 as (select a.id s, b.id t, a.x x1, a.y y1, b.x x2, b.y y2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) len, 'h' lt
  from v a join v b on b.id = a.id+1 where a.c < 19 and (a.r%8 = 0 or a.p_size%16 = 0)
  union all select a.id, b.id, a.x, a.y, b.x, b.y, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 'v'
  from v a join v b on b.id = a.id+20 where a.r%8 <> 7 or a.p_size%5 = 0),
isl as (select 10000000+2*n_nationkey s, 10000001+2*n_nationkey t,
  case when n_nationkey%2 = 1 then -130e0 else -1000e0 end x1, n_nationkey*160e0+40e0 y1 from nation),
nodes as (select id::bigint id, x, y from v union all select s, x1, y1 from isl union all select t, x1+50e0, y1 from isl),
e as (select s::bigint s, t::bigint t, x1, y1, x2, y2, len, lt from e0
  union all select s, t, x1, y1, x1+50e0, y1, 50e0, 'i' from isl)
"""
