"""Layers: tables of lines with a geometry column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from netgap.functions import geometry as G
from netgap.sources.numbers import numbered


def geometry_column(df: DataFrame, name: str | None = None) -> str:
    """``name`` if given, else ``geom``, else ``geometry``."""
    for c in [name] if name else ["geom", "geometry"]:
        if c in df.columns:
            return c
    raise ValueError("no geometry column")


def lines(*layers: DataFrame, geom: str | None = None) -> DataFrame:
    """seq, geom, link_type of several layers: multi-lines are exploded, elevation is dropped, and lines are numbered in the
    order of layer, row and part."""
    parts = []
    for k, layer in enumerate(layers):
        g = geometry_column(layer, geom)
        kind = layer.schema[g].dataType.simpleString()
        many = layer.withColumn("_g", F.col(g) if kind.startswith("array<array") else F.array(F.col(g)))
        link = F.col("link_type") if "link_type" in layer.columns else F.lit(None).cast("string")
        rows = many.select(F.lit(k).alias("layer"), F.monotonically_increasing_id().alias("row"), link.alias("link_type"), F.posexplode("_g").alias("part", "g"))
        parts.append(rows.select(F.struct("layer", "row", "part").alias("key"), G.remove_elevation(F.col("g")).alias("geom"), "link_type"))
    return numbered(reduce(DataFrame.unionByName, parts), "key", "seq").select("seq", "geom", "link_type")


def from_wkt(df: DataFrame, column: str, out: str = "geom") -> DataFrame:
    """Reads ``LINESTRING`` text, with or without elevation."""
    body = F.regexp_extract(column, r"\(([^()]*)\)", 1)
    pts = F.transform(F.split(body, r"\s*,\s*"), lambda p: G.let(F.split(F.trim(p), r"\s+"), lambda v: G.point(v[0].cast("double"), v[1].cast("double"))))
    return df.withColumn(out, pts)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet (geometry as array of structs), CSV with WKT, or GeoJSON features one a line."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
        return from_wkt(raw, geometry_column(raw))
    if path.endswith((".geojsonl", ".jsonl")):
        schema = "type string, geometry struct<type:string,coordinates:array<array<double>>>, properties map<string,string>"
        raw = spark.read.schema(schema).json(path)
        return raw.select(F.transform("geometry.coordinates", lambda c: G.point(c[0], c[1])).alias("geom"), F.element_at("properties", "link_type").alias("link_type"), "properties")
    return spark.read.parquet(path)
