"""Tables and files for other software."""

from __future__ import annotations

import re
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F

from netgap.functions import geometry as G
from netgap.sources.numbers import numbered
from netgap.operators.network import Network

#: Columns of the TNTP format, in order.
TNTP_COLUMNS = ("init_node", "term_node", "capacity", "length", "free_flow_time", "b", "power", "speed_limit", "toll", "link_type")


def codes(net: Network) -> DataFrame:
    """id, code: dense numbers from 1 in the order of ids."""
    return numbered(net.vertices.select("id"), "id", "code")


def node_table(net: Network) -> DataFrame:
    named = net.vertices.join(codes(net), "id")
    return named.select(F.col("code").alias("index"), F.concat(F.lit("v"), F.col("id")).alias("label"), G.point(F.col("x"), F.col("y")).alias("geom"))


def edge_table(net: Network) -> DataFrame:
    c = codes(net)
    both = net.edges.join(c.withColumnRenamed("id", "src").withColumnRenamed("code", "src_index"), "src").join(c.withColumnRenamed("id", "dst").withColumnRenamed("code", "tgt_index"), "dst")
    return both.select("length_m", "link_type", "geom", F.concat(F.lit("v"), F.col("src")).alias("src_label"), F.concat(F.lit("v"), F.col("dst")).alias("tgt_label"), "src_index", "tgt_index")


def tntp_body(net: Network) -> DataFrame:
    """The ten columns of a TNTP link file; those without a value are null."""
    e = edge_table(net)
    have = {"init_node": F.col("src_index"), "term_node": F.col("tgt_index"), "length": F.col("length_m"), "link_type": F.col("link_type")}
    return e.select(*[have[c].alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in TNTP_COLUMNS])


def tntp_metadata(values: dict[str, object]) -> list[str]:
    out = []
    for k, v in values.items():
        if not re.fullmatch(r"[A-Z ]+", k.upper()):
            raise ValueError(f"invalid metadata key {k}")
        if not isinstance(v, (int, float)) and not re.fullmatch(r"[A-Za-z0-9.]+", str(v)):
            raise ValueError(f"invalid metadata value {v}")
        out.append(f"<{k.upper()}> {v}")
    return [*out, "<END OF METADATA>", ""]


def _lines(df: DataFrame) -> Iterable[str]:
    return (r[0] for r in df.toLocalIterator())


def write_tntp(path: str, net: Network) -> None:
    """A TNTP file on the driver, streamed row by row."""
    n, m = net.vertices.count(), net.edges.count()
    text = tntp_body(net).select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TNTP_COLUMNS]))
    with open(path, "w", encoding="utf-8") as f:
        f.write("~ TNTP file\n")
        f.writelines(x + "\n" for x in tntp_metadata({"Number of zones": n, "Number of nodes": n, "First thru node": 1, "Number of links": m}))
        f.write("~" + "\t".join(TNTP_COLUMNS) + "\t;\n")
        f.writelines(x + "\t;\n" for x in _lines(text))


def graphml_lines(net: Network) -> DataFrame:
    """(part, key, line): node and edge elements of a GraphML file."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    node = net.vertices.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.lit(0).cast("long").alias("key2"), F.format_string('<node id="%d"><data key="x">%s</data><data key="y">%s</data></node>', "id", F.col("x").cast("string"), F.col("y").cast("string")).alias("line"))
    kind = F.when(F.col("link_type").isNotNull(), F.concat(F.lit('<data key="link_type">'), text(F.col("link_type")), F.lit("</data>"))).otherwise("")
    edge = net.edges.select(F.lit(1).alias("part"), F.col("src").alias("key"), F.col("dst").alias("key2"), F.concat(F.format_string('<edge source="%d" target="%d"><data key="length_m">%s</data><data key="geom">', "src", "dst", F.col("length_m").cast("string")), G.wkt(F.col("geom")), F.lit("</data>"), kind, F.lit("</edge>")).alias("line"))
    return node.unionByName(edge)


def write_graphml(path: str, net: Network, pretty: bool = False) -> None:
    keys = [("length_m", "edge", "double"), ("geom", "edge", "string"), ("link_type", "edge", "string"), ("x", "node", "double"), ("y", "node", "double")]
    end = "\n" if pretty else ""
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>' + end)
        f.write('<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">' + end)
        for name, owner, kind in keys:
            f.write(f'<key id="{escape(name)}" for="{owner}" attr.name="{escape(name)}" attr.type="{kind}"/>{end}')
        f.write(f'<graph id="G" edgedefault="directed">{end}')
        f.writelines(x + end for x in _lines(graphml_lines(net).orderBy("part", "key", "key2").select("line")))
        f.write("</graph></graphml>" + end)


def write_layer(df: DataFrame, path: str, kind: str = "parquet", geom: str = "geom") -> None:
    """A layer as Parquet, or as CSV with the geometry in WKT."""
    if kind == "parquet":
        df.write.parquet(path)
    elif kind == "csv":
        df.withColumn(geom, G.wkt(F.col(geom))).write.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def write_raster(df: DataFrame, path: str) -> None:
    """A raster table (row, col, x, y, value)."""
    df.select("row", "col", "x", "y", "value").write.parquet(path)
