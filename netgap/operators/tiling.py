"""Spatial tiles for networks that are too large for one distance table.

All tiles are worked on in one plan: a vertex that lies in several tiles becomes one vertex for each, named id * tiles +
tile, so the tiles are parts of one network that nothing connects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netgap.functions import geometry as G
from netgap.operators import distance, links as L
from netgap.operators.network import Network, extent
from netgap.sources.shared import kept


class Grid:
    """rows x cols tiles over the extent of a network; rows split y, columns split x."""

    def __init__(self, net: Network, rows: int, cols: int) -> None:
        e = extent(net).first()
        if e.min_x is None:
            raise ValueError("the network is empty")
        self.rows, self.cols, self.x, self.y = rows, cols, e.min_x, e.min_y
        self.w, self.h = (e.max_x - e.min_x) / cols, (e.max_y - e.min_y) / rows

    def inside(self, x: Column, y: Column, row: Column, col: Column, buffer: float = 0.0) -> Column:
        low_x, high_x = F.lit(self.x) + F.lit(self.w) * col, F.lit(self.x) + F.lit(self.w) * (col + 1)
        low_y, high_y = F.lit(self.y) + F.lit(self.h) * row, F.lit(self.y) + F.lit(self.h) * (row + 1)
        return x.between(low_x - buffer, high_x + buffer) & y.between(low_y - buffer, high_y + buffer)

    def near(self, points: DataFrame, buffer: float) -> DataFrame:
        """Points (x, y) with tile_row and tile_col, once for each tile whose buffered bounds hold them."""
        out = points
        for name, at, low, step, n in (("tile_row", "y", self.y, self.h, self.rows), ("tile_col", "x", self.x, self.w, self.cols)):
            if step > 0:  # one tile more on both sides, as quotients are rounded; ``inside`` decides
                first, last = (F.floor((F.col(at) + F.lit(s * buffer) - low) / step).cast("int") + s for s in (-1, 1))
                tiles = F.sequence(F.greatest(F.lit(0), first), F.least(F.lit(n - 1), last))
            else:
                tiles = F.sequence(F.lit(0), F.lit(n - 1))
            out = out.withColumn(name, F.explode(tiles))
        return out.filter(self.inside(F.col("x"), F.col("y"), F.col("tile_row"), F.col("tile_col"), buffer))


def partition(net: Network, rows: int, cols: int, buffer: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with tile_row and tile_col.  A tile has the vertices inside its buffered bounds, every edge
    with an end there, and that edge's other end."""
    core = Grid(net, rows, cols).near(net.vertices.select("id", "x", "y"), buffer)
    ends = net.edges.select(F.struct("src", "dst").alias("e"), F.explode(F.array("src", "dst")).alias("id"))
    touched = ends.join(core.select("id", "tile_row", "tile_col"), "id").select("e", "tile_row", "tile_col").distinct()
    edges = net.edges.withColumn("e", F.struct("src", "dst")).join(touched, "e").drop("e")
    outer = edges.select("tile_row", "tile_col", F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = core.select("tile_row", "tile_col", "id").union(outer.select("tile_row", "tile_col", "id")).distinct()
    return net.vertices.join(ids, "id").select("id", "x", "y", "tile_row", "tile_col"), edges


def identify_and_score(net: Network, rows: int, cols: int, buffer: float, decay: L.Decay, cutoff_distance: float, origin_weights: DataFrame, dest_weights: DataFrame, max_link_distance: float = 100, min_net_distance: float = 1000, radius: float = 100, deduplicate: bool = True) -> DataFrame:
    """Links and scores of every tile, merged: each link once, in one direction.

    Distances are searched up to ``cutoff_distance`` in each tile.  No step looks beyond a tile, so what a task holds does
    not grow with the network.
    """
    L.check_bounds(cutoff_distance, min_net_distance, radius if deduplicate else 0)
    n = rows * cols
    vertices, edges = (kept(t, "tiles") for t in partition(net, rows, cols, buffer))
    tile = F.col("tile_row") * cols + F.col("tile_col")
    name = lambda c: (F.col(c) * n + tile).alias(c)
    whole = Network(vertices.select(name("id"), "x", "y"), edges.select(name("src"), name("dst"), "length_m", "link_type", "geom", tile.alias("tile")))
    dist = distance.Search(whole, cutoff_distance)
    found = L.identify(whole, dist, max_link_distance, min_net_distance, on=("tile",))
    if deduplicate:
        found = L.deduplicate(found, whole, dist, radius).drop("ord")
    weigh = lambda w: vertices.join(w, "id").select(name("id"), "w")
    scored = L.score(kept(found, "links"), dist, weigh(origin_weights), weigh(dest_weights), decay, cutoff_distance)
    plain = [F.expr(f"{c} div {n}").alias(c) if c.endswith(("_src", "_tgt")) else F.col(c) for c in (*L.LINK, "score")]
    placed = scored.select(*plain, F.expr(f"int((fr_src % {n}) div {cols})").alias("tile_row"), F.expr(f"int((fr_src % {n}) % {cols})").alias("tile_col"))
    return merge(net, Grid(net, rows, cols), placed)


def merge(net: Network, grid: Grid, links: DataFrame) -> DataFrame:
    """Keeps links (with tile_row, tile_col) with an end inside their own tile, one row for a link and its reverse: the
    first tile in row-major order wins.  Network lengths differ between tiles and are reset to 0."""
    e = net.edges
    a = e.select(F.col("src").alias("fr_src"), F.col("dst").alias("fr_tgt"), F.col("geom").alias("ga"))
    b = e.select(F.col("src").alias("to_src"), F.col("dst").alias("to_tgt"), F.col("geom").alias("gb"))
    both = links.join(a, ["fr_src", "fr_tgt"]).join(b, ["to_src", "to_tgt"])
    both = both.withColumn("p", G.interpolate(F.col("ga"), F.col("fr_from_start").cast("double"))).withColumn("q", G.interpolate(F.col("gb"), F.col("to_from_start").cast("double")))
    own = grid.inside(F.col("p.x"), F.col("p.y"), F.col("tile_row"), F.col("tile_col")) | grid.inside(F.col("q.x"), F.col("q.y"), F.col("tile_row"), F.col("tile_col"))
    place = lambda cols: F.struct(*[F.col(c).alias(k) for c, k in zip(cols, "abcd", strict=True)])
    fr, to = place(L.LINK[:4]), place(L.LINK[4:8])
    keyed = both.filter(own).withColumn("net_m", F.lit(0)).withColumn("key", F.when(fr <= to, F.struct(fr.alias("a"), to.alias("b"))).otherwise(F.struct(to.alias("a"), fr.alias("b"))))
    first = keyed.groupBy("key").agg(F.min(F.struct("tile_row", "tile_col", (fr > to).alias("turned"), *L.LINK, "score")).alias("m"))
    return first.select(*[F.col(f"m.{c}").alias(c) for c in L.LINK], "m.score")
