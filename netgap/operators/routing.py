"""Nearest edges, routes, isochrone surfaces, regional access and diagnostics."""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from netgap.functions import geometry as G
from netgap.operators.distance import KERNEL_ARCS, MOST_RATIO, Graph, Search, net_distance
from netgap.operators.links import Decay
from netgap.operators.network import UNREACHABLE, Network, box_join, degree, extent
from netgap.sources.shared import kept

_BOX = lambda: F.struct(F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))


def closest_edge(net: Network, points: DataFrame, max_dist: float) -> DataFrame:
    """The nearest edge at most ``max_dist`` away of each point (key columns, x, y): src, dst, dist, from_start, from_end.
    Ties go to the edge that sorts first."""
    keys = [c for c in points.columns if c not in ("x", "y")]
    e = net.edges.select("src", "dst", F.col("length_m").alias("len"), F.col("geom").alias("g"))
    near = box_join(points, e, _BOX(), G.envelope(F.col("g")), max_dist, max(2.0 * max_dist, 1.0))
    near = near.withColumn("n", G.project(F.col("g"), G.point(F.col("x"), F.col("y")))).filter(F.col("n.dist") <= max_dist)
    best = near.groupBy(*keys).agg(F.min(F.struct(F.col("n.dist").alias("dist"), "src", "dst", F.col("n.along").alias("along"), "len")).alias("m"))
    return best.select(*keys, "m.src", "m.dst", "m.dist", F.col("m.along").alias("from_start"), (F.col("m.len") - F.col("m.along")).alias("from_end"))


def _shortest_path(net: Network, a: Row, b: Row) -> tuple[float, list[int], int]:
    """Length between two places on different edges, and the vertices of the way, last first.

    A way of length L only meets vertices whose distances in space from its two ends sum to at most L times the ratio of
    space to length, so only these edges are collected; L is doubled until the way found is no longer.
    """
    search = Search(net, 0.0)
    at = {r.id: (r.x, r.y) for r in net.vertices.filter(F.col("id").isin([a.src, a.dst, b.src, b.dst])).collect()}
    ratio = search.ratio if search.ratio <= MOST_RATIO and len(at) == len({a.src, a.dst, b.src, b.dst}) else None
    bound = 100.0
    if ratio:
        bound = max(bound, 2 * max(math.dist(at[u], at[v]) for u in (a.src, a.dst) for v in (b.src, b.dst)) / ratio)
    while True:
        edges = search.edges.select("u", "v", "w", "ux", "uy", "vx", "vy")
        if ratio:
            gap = lambda p, c: F.sqrt((F.col(f"{c}x") - F.lit(at[p][0])) ** 2 + (F.col(f"{c}y") - F.lit(at[p][1])) ** 2)
            near = lambda c: reduce(Column.__or__, [gap(u, c) + gap(v, c) <= F.lit(bound * ratio * (1 + 1e-9)) for u in {a.src, a.dst} for v in {b.src, b.dst}])
            edges = edges.filter(near("u") & near("v"))
        rows = edges.select("u", "v", "w")
        many = rows.count()
        if 2 * many > KERNEL_ARCS:
            raise ValueError("the graph is too large for one route; cut a tile first")
        rows = rows.toArrow()
        g = Graph(*(rows[c].to_numpy() for c in "uvw"), np.array([a.src, a.dst, b.src, b.dst]))
        start, end = (g.index(np.array([p.src, p.dst])).tolist() for p in (a, b))
        heap = [(a.from_start, start[0], -1), (a.from_end, start[1], -1)]
        heapq.heapify(heap)
        came: dict[int, tuple[float, int]] = {}
        while heap:
            d, u, before = heapq.heappop(heap)
            if u in came:
                continue
            came[u] = (d, before)
            for k in range(g.first[u], g.first[u + 1]):
                v = int(g.to[k])
                if v not in came:
                    heapq.heappush(heap, (d + float(g.w[k]), v, u))
        options = [(came[v][0] + off, v) for v, off in ((end[0], b.from_start), (end[1], b.from_end)) if v in came]
        if options and (min(options)[0] <= bound or many == search.count):
            total, last = min(options)
            path = [last]
            while came[path[-1]][1] >= 0:
                path.append(came[path[-1]][1])
            return total, [int(g.nodes[v]) for v in path], int(g.nodes[last])
        if many == search.count:
            raise ValueError("no route between the places")
        bound *= 2


def route(net: Network, origin: tuple[float, float], dest: tuple[float, float], max_snap_dist: float = 100) -> DataFrame:
    """One row: distance (snap legs left out) and geometry of the shortest route.

    Both places are snapped; trips within one edge go along it.  Raises if a place has no edge in range or no route
    exists.
    """
    spark = net.edges.sparkSession
    ends = spark.createDataFrame([(0, *map(float, origin)), (1, *map(float, dest))], "k int, x double, y double")
    snapped = {r.k: r for r in closest_edge(net, ends, max_snap_dist).collect()}
    if len(snapped) < 2:
        raise ValueError("no edge within the snap distance")
    a, b = snapped[0], snapped[1]
    edge = lambda s: net.edges.filter((F.col("src") == s.src) & (F.col("dst") == s.dst))
    schema = f"distance double, geom {G.LINE}"
    if (a.src, a.dst) == (b.src, b.dst):
        low, high = sorted((a.from_start, b.from_start))
        g = G.line_between(F.col("geom"), F.lit(low), F.lit(high)) if high > low else F.array(G.interpolate(F.col("geom"), F.lit(low)))
        return edge(a).select(F.lit(high - low).alias("distance"), (g if a.from_start <= b.from_start else F.reverse(g)).alias("geom"))
    total, path, last = _shortest_path(net, a, b)
    path.reverse()
    steps = [(i, min(u, v), max(u, v), u > v) for i, (u, v) in enumerate(zip(path, path[1:], strict=False), 1)]
    rows = spark.createDataFrame(steps, "i int, src long, dst long, turned boolean").join(net.edges, ["src", "dst"])
    parts = rows.select("i", F.when(F.col("turned"), F.reverse("geom")).otherwise(F.col("geom")).alias("geom"))
    begin = G.line_between(F.col("geom"), F.lit(0.0), F.lit(a.from_start)) if path[0] == a.src else G.line_between(F.col("geom"), F.lit(a.from_start), F.lit(a.from_start + a.from_end))
    final = G.line_between(F.col("geom"), F.lit(0.0), F.lit(b.from_start)) if last == b.src else G.line_between(F.col("geom"), F.lit(b.from_start), F.lit(b.from_start + b.from_end))
    if (a.from_start if path[0] == a.src else a.from_end) > 0:
        parts = parts.union(edge(a).select(F.lit(0), F.reverse(begin) if path[0] == a.src else begin))
    if (b.from_start if last == b.src else b.from_end) > 0:
        parts = parts.union(edge(b).select(F.lit(len(path) + 1), final if last == b.src else F.reverse(final)))
    ordered = parts.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "geom"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda p: p["geom"]))
    joined = F.aggregate(flat, F.array().cast(G.LINE), lambda h, p: F.when((F.size(h) > 0) & (F.element_at(h, -1) == p), h).otherwise(F.concat(h, F.array(p))))
    return ordered.select(F.lit(total).cast("double").alias("distance"), joined.alias("geom")).to(spark.createDataFrame([], schema).schema)


def pixels(spark, min_x: float, min_y: float, max_x: float, max_y: float, resolution: float) -> DataFrame:
    """Grid points (row, col, x, y): x rises with col, y falls with row."""
    cols, rows = int((max_x - min_x) // resolution) + 1, int((max_y - min_y) // resolution) + 1
    grid = spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("row"), (F.col("id") % cols).alias("col"))
    return grid.select("row", "col", (F.lit(float(min_x)) + F.col("col") * float(resolution)).alias("x"), (F.lit(float(max_y)) - F.col("row") * float(resolution)).alias("y"))


def distance_surface(net: Network, dist: DataFrame | Search, origin: tuple[float, float], maxdist: float = 5000, resolution: float = 25, max_snap_dist: float = 100) -> DataFrame:
    """row, col, x, y, value: whole metres from the origin to each pixel, both snap legs included; 65535 if unreached."""
    spark = net.edges.sparkSession
    x, y = map(float, origin)
    start = closest_edge(net, spark.createDataFrame([(0, x, y)], "k int, x double, y double"), maxdist).first()
    if start is None:
        raise ValueError("no edge near the origin")
    grid = pixels(spark, x - maxdist, y - maxdist, x + maxdist, y + maxdist, resolution)
    near = closest_edge(net, grid.select("row", "col", "x", "y"), max_snap_dist)
    legs = [(start.src, start.from_start), (start.dst, start.from_end)]
    if isinstance(dist, Search):
        dist = kept(dist.table(net.vertices.filter(F.col("id").isin(start.src, start.dst))), "dist")
    from_origin = None
    for v, off in legs:
        part = dist.filter(F.col("origin") == v).select("dest", (F.col("d") + F.lit(float(off))).alias("d"))
        from_origin = part if from_origin is None else from_origin.union(part)
    reach = from_origin.groupBy("dest").agg(F.min("d").alias("d"))
    ends = near.select("row", "col", "dist", F.explode(F.array(F.struct(F.col("src").alias("dest"), F.col("from_start").alias("off")), F.struct(F.col("dst").alias("dest"), F.col("from_end").alias("off")))).alias("e"))
    through = ends.select("row", "col", "dist", "e.*").join(reach, "dest").groupBy("row", "col", "dist").agg(F.min(F.col("d") + F.col("off")).alias("d"))
    same = near.filter((F.col("src") == start.src) & (F.col("dst") == start.dst)).select("row", "col", "dist", F.abs(F.col("from_start") - F.lit(float(start.from_start))).alias("d"))
    on_edge = same.select("row", "col")
    best = through.join(on_edge, ["row", "col"], "left_anti").unionByName(same).select("row", "col", F.rint(F.col("d") + F.col("dist") + F.lit(float(start.dist))).alias("v"))
    return grid.join(best, ["row", "col"], "left").select("row", "col", "x", "y", F.coalesce("v", F.lit(float(UNREACHABLE))).alias("value"))


def regional_access(net: Network, dist: DataFrame | Search, link: dict, weights: DataFrame, decay: Decay, cutoff: float, resolution: float = 50, max_snap_dist: float = 100, compat: bool = False) -> DataFrame:
    """row, col, x, y, value: the gain in decayed access of each pixel through one link, both ways summed.

    ``compat`` places the to-end by the from-end's offsets, as older results did.
    """
    turned = {("to" + k[2:] if k.startswith("fr_") else "fr" + k[2:] if k.startswith("to_") else k): v for k, v in link.items()}
    e = extent(net).first()
    grid = pixels(net.edges.sparkSession, e.min_x, e.min_y, e.max_x, e.max_y, resolution)
    pixel = grid
    if isinstance(dist, Search) and dist.bounded:
        # what is over the cutoff from both ends counts for nothing, nor do ways that begin there
        ends = net.vertices.filter(F.col("id").isin([link[k] for k in ("fr_src", "fr_tgt", "to_src", "to_tgt")])).collect()
        within = lambda r: reduce(Column.__or__, [F.sqrt((F.col("x") - F.lit(p.x)) ** 2 + (F.col("y") - F.lit(p.y)) ** 2) <= F.lit(r) for p in ends])
        reach = (cutoff + 1) * max(dist.ratio, 1.0)
        pixel = grid.filter(within(reach))
        dist = kept(dist.table(net.vertices.filter(within(reach + dist.gap))), "dist")
    elif isinstance(dist, Search):
        dist = kept(dist.table(), "dist")
    near = kept(closest_edge(net, pixel, max_snap_dist), "near")
    parts = [_one_way(dist, x, near, weights, decay, cutoff, compat) for x in (link, turned)]
    total = parts[0].unionByName(parts[1]).groupBy("row", "col").agg(F.sum("value").alias("value"))
    return grid.join(total, ["row", "col"], "left").select("row", "col", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def _one_way(dist: DataFrame, link: dict, near: DataFrame, weights: DataFrame, decay: Decay, cutoff: float, compat: bool) -> DataFrame:
    length = link["geo_m"]

    def around(side: str, off: str, name: str) -> DataFrame:
        both = None
        for v, o in ((link[f"{side}_src"], link[f"{off}_from_start"]), (link[f"{side}_tgt"], link[f"{off}_to_end"])):
            part = dist.filter(F.col("dest") == v).select("origin", (F.col("d") + o).alias(name))
            both = part if both is None else both.union(part)
        return both.groupBy("origin").agg(F.min(name).alias(name))

    ends = near.select("row", "col", "dist", F.explode(F.array(F.struct(F.col("src").alias("origin"), F.col("from_start").alias("off")), F.struct(F.col("dst").alias("origin"), F.col("from_end").alias("off")))).alias("e")).select("row", "col", "dist", "e.*")
    to_link = ends.join(around("fr", "fr", "a"), "origin").groupBy("row", "col").agg(F.min(F.col("a") + F.col("off") + F.col("dist")).alias("a")).filter(F.col("a") <= cutoff - length)
    beyond = around("to", "fr" if compat else "to", "b").join(weights.filter("w <> 0").withColumnRenamed("id", "origin"), "origin").filter(F.col("b") <= cutoff - length)
    trips = to_link.crossJoin(beyond.select(F.col("origin").alias("t"), "b", "w"))
    old = ends.join(to_link.select("row", "col"), ["row", "col"], "left_semi").join(dist, "origin").groupBy("row", "col", F.col("dest").alias("t")).agg(F.min(F.col("d") + F.col("off") + F.col("dist")).alias("old"))
    both = trips.join(old, ["row", "col", "t"], "left").withColumn("new", F.col("a") + F.lit(length) + F.col("b"))
    gain = (decay(F.col("new")) - F.when(F.col("old").isNull(), 0.0).otherwise(decay(F.col("old")))) * F.col("w")
    return both.filter("old is null or new < old").groupBy("row", "col").agg(F.sum(gain).alias("value"))


def dead_ends(net: Network) -> DataFrame:
    return net.vertices.join(degree(net).filter("degree = 1").select("id"), "id", "left_semi").select("id", "x", "y")


def disconnected_crossings(net: Network, dist: DataFrame | Search, tolerance: float = 10) -> DataFrame:
    """Points where two edges cross although the network between those places is longer than ``tolerance``."""
    e = net.edges
    a = e.select(F.col("src").alias("fr_src"), F.col("dst").alias("fr_tgt"), F.col("length_m").alias("la"), F.col("geom").alias("ga"))
    b = e.select(F.col("src").alias("to_src"), F.col("dst").alias("to_tgt"), F.col("length_m").alias("lb"), F.col("geom").alias("gb"))
    pairs = box_join(a, b, G.envelope(F.col("ga")), G.envelope(F.col("gb")), 0.0, 250.0).filter(F.struct("fr_src", "fr_tgt") < F.struct("to_src", "to_tgt"))
    hits = F.flatten(F.transform(G.segments(F.col("ga")), lambda s: F.filter(F.transform(G.segments(F.col("gb")), lambda q: G.crossing(s, q, lambda t: G.crossing(q, s, lambda u: F.struct((s["start"] + t * s["d"]).alias("m"), (q["start"] + u * q["d"]).alias("n"), (s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))))), lambda h: h.isNotNull())))
    at = pairs.withColumn("h", F.explode(hits))
    r = lambda c: F.rint(c).cast("int")
    placed = at.select("fr_src", "fr_tgt", r(F.col("h.m")).alias("fr_from_start"), (r(F.col("la")) - r(F.col("h.m"))).alias("fr_to_end"), "to_src", "to_tgt", r(F.col("h.n")).alias("to_from_start"), (r(F.col("lb")) - r(F.col("h.n"))).alias("to_to_end"), F.col("h.x").alias("x"), F.col("h.y").alias("y"))
    far = net_distance(placed, dist).filter(F.coalesce("net_m", F.lit(UNREACHABLE)) > tolerance)
    return far.select("fr_src", "fr_tgt", "to_src", "to_tgt", "x", "y")
