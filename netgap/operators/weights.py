"""Weights of places, spread over the ends of the edges near them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netgap.functions import geometry as G
from netgap.operators.network import Network, box_join
from netgap.sources.shared import kept


def graph_weights(net: Network, places: DataFrame, columns: list[str], distance: float, kind: str = "point", geom: str = "geom") -> DataFrame:
    """id and one column per weight.  Each place is split over both ends of all edges less than ``distance`` away; a
    vertex on two near edges gets two shares; places without a near edge are lost.  ``kind``: point, polygon (rings) or
    multipolygon (array of polygons)."""
    rows = kept(places.select(F.col(geom).alias("_g"), *columns).withColumn("_place", F.monotonically_increasing_id()), "places")  # read twice, numbered once
    g = F.col("_g")
    outline = {"point": F.array(g), "polygon": g[0] if kind == "polygon" else None, "multipolygon": F.flatten(F.flatten(g)) if kind == "multipolygon" else None}[kind]
    e = net.edges.select("src", "dst", F.col("geom").alias("_e"))
    pairs = box_join(rows, e, G.envelope(outline), G.envelope(F.col("_e")), distance, max(float(distance), 1.0))
    if kind == "point":
        d = G.project(F.col("_e"), g)["dist"]
    elif kind == "polygon":
        d = G.line_polygon_distance(F.col("_e"), g)
    else:
        d = F.array_min(F.transform(g, lambda p: G.line_polygon_distance(F.col("_e"), p)))
    near = pairs.filter(d < distance).select("_place", "src", "dst")
    count = near.groupBy("_place").agg((2 * F.count("*")).alias("_n"))
    share = near.join(count, "_place").join(rows.drop("_g"), "_place").select(F.explode(F.array("src", "dst")).alias("id"), *[(F.col(c) / F.col("_n")).alias(c) for c in columns])
    summed = share.groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])
    return net.vertices.select("id").join(summed, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def partition_weights(part: Network, weights: DataFrame) -> DataFrame:
    """The weights of the vertices of a part of the network."""
    return weights.join(part.vertices.select("id"), "id", "left_semi")


def coverage(weights: DataFrame, places: DataFrame, column: str) -> DataFrame:
    """Share of the places' weight that reached the network."""
    return weights.agg(F.sum(column).alias("attached")).crossJoin(places.agg(F.sum(column).alias("total"))).select((F.col("attached") / F.col("total")).alias("coverage"))
