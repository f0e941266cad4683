"""Registered queries: one for each operator, over the derived network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netgap.functions import geometry as G
from netgap.operators import build, distance, links as L, network as N, routing, tiling, weights as W
from netgap.plans.oracles import ORACLES  # noqa: F401
from netgap.sources import osm, sinks, testnet
from netgap.sources.shared import kept

MAXDIST, MAX_LINK, MIN_NET, RADIUS, CUTOFF, BUFFER = 1500, 100, 1000, 100, 1000, 1100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


net = testnet.network


def _dist(n: N.Network) -> distance.Search:
    return distance.Search(n, MAXDIST)


def _links(spark: SparkSession, d: str) -> tuple[N.Network, distance.Search, DataFrame]:
    n = net(spark, d)
    dist = _dist(n)
    return n, dist, L.identify(n, dist, MAX_LINK, MIN_NET)


def _xy(name: str, p: Column, a: str = "") -> list[Column]:
    return [p["x"].alias(f"{name}x{a}"), p["y"].alias(f"{name}y{a}")]


def _ends(g: Column) -> list[Column]:
    return [*_xy("", G.first_point(g), "1"), *_xy("", G.last_point(g), "2")]


@query
def net_vertices(spark, d):
    return sinks.node_table(net(spark, d)).select("index", "label", "geom.x", "geom.y")


@query
def net_edges(spark, d):
    e = sinks.edge_table(net(spark, d))
    return e.select(*[c for c in e.columns if c != "geom"], *_ends(F.col("geom")))


@query
def edge_length(spark, d):
    return net(spark, d).edges.select("src", "dst", G.length(F.col("geom")).alias("length_m"))


@query
def edge_reverse(spark, d):
    return net(spark, d).edges.select("src", "dst", *_ends(G.reverse(F.col("geom"))))


@query
def edge_first_last(spark, d):
    g = F.col("geom")
    return net(spark, d).edges.select("src", "dst", *_xy("first_", G.first_point(g)), *_xy("last_", G.last_point(g)))


@query
def edge_envelope(spark, d):
    return net(spark, d).edges.select("src", "dst", G.envelope(F.col("geom")).alias("b")).select("src", "dst", "b.*")


@query
def edge_wkt(spark, d):
    return net(spark, d).edges.select("src", "dst", G.wkt(F.col("geom")).alias("wkt"))


@query
def edge_break(spark, d):
    return G.break_long(net(spark, d).edges, "geom", 30).select("src", "dst", "piece", *_ends(F.col("geom")))


@query
def edge_interpolate(spark, d):
    return net(spark, d).edges.select("src", "dst", G.interpolate(F.col("geom"), F.col("length_m") * 0.25).alias("p")).select("src", "dst", "p.*")


@query
def point_project(spark, d):
    p = G.first_point(F.col("geom"))
    return net(spark, d).edges.select("src", "dst", G.project(F.col("geom"), G.point(p["x"] + 10.0, p["y"] + 7.0)).alias("n")).select("src", "dst", "n.*")


@query
def degree(spark, d):
    return N.degree(net(spark, d))


@query
def dead_ends(spark, d):
    return routing.dead_ends(net(spark, d))


@query
def extent(spark, d):
    return N.extent(net(spark, d))


@query
def components(spark, d):
    return N.component_sizes(net(spark, d))


@query
def remove_islands(spark, d):
    return N.remove_tiny_islands(net(spark, d), 3).edges.select("src", "dst", "length_m")


@query
def dist_table(spark, d):
    return distance.distance_table(net(spark, d), MAXDIST)


@query
def net_distance(spark, d):
    n = net(spark, d)
    half = F.rint(F.col("length_m") / 2).cast("int")
    side = lambda p: n.edges.select(F.col("src").alias(f"{p}_src"), F.col("dst").alias(f"{p}_tgt"), half.alias(f"{p}_from_start"), (F.rint("length_m").cast("int") - half).alias(f"{p}_to_end"))
    a, b = side("fr"), side("to")
    pairs = a.join(b, F.col("to_src") == F.col("fr_src") + 3).unionByName(a.join(b, (F.col("to_src") == F.col("fr_src")) & (F.col("to_tgt") == F.col("fr_tgt"))))
    return distance.net_distance(pairs, _dist(n)).select(*distance.ENDS, "net_m")


@query
def net_distance_exact(spark, d):
    n, _, found = _links(spark, d)
    return distance.net_distance_exact(n, kept(found, "links")).select(*L.LINK, F.round("net_exact", 6).alias("net_exact"))


@query
def links_identify(spark, d):
    return _links(spark, d)[2]


@query
def links_reverse(spark, d):
    return L.reverse(_links(spark, d)[2])


@query
def links_table(spark, d):
    n, _, found = _links(spark, d)
    t = L.to_table(found, n)
    # infinity is shown as 1e9 here, where results are compared as numbers
    return t.select("fr_src", "fr_tgt", "to_src", "to_tgt", F.when(F.col("network_length_m") == float("inf"), 1e9).otherwise(F.col("network_length_m")).alias("network_length_m"), "geographic_length_m", *_ends(F.col("geom")))


@query
def links_dedupe(spark, d):
    n, dist, found = _links(spark, d)
    return L.deduplicate(found, n, dist, RADIUS).select(*L.LINK)


def _weighted(spark: SparkSession, d: str, n: N.Network) -> tuple[DataFrame, DataFrame]:
    return W.graph_weights(n, testnet.origins(spark, d), ["w"], 20), W.graph_weights(n, testnet.destinations(spark, d), ["w"], 100)


def _scored(spark: SparkSession, d: str, decay: L.Decay) -> DataFrame:
    n, dist, found = _links(spark, d)
    found = kept(found, "links")
    ow, dw = _weighted(spark, d, n)
    return L.score(found, dist, ow, dw, decay, CUTOFF).withColumn("score", F.round("score", 6))


@query
def links_score_step(spark, d):
    return _scored(spark, d, L.step_decay(1000))


@query
def links_score_linear(spark, d):
    return _scored(spark, d, L.linear_decay(1000))


@query
def links_topk(spark, d):
    return L.top(kept(_scored(spark, d, L.step_decay(1000)), "scored"), 5)


@query
def tile_vertices(spark, d):
    return tiling.partition(net(spark, d), 3, 3, BUFFER)[0]


@query
def tile_edges(spark, d):
    return tiling.partition(net(spark, d), 3, 3, BUFFER)[1].drop("geom")


@query
def tile_links_merged(spark, d):
    n = net(spark, d)
    ow, dw = _weighted(spark, d, n)
    out = tiling.identify_and_score(n, 3, 3, BUFFER, L.step_decay(1000), CUTOFF, kept(ow, "ow"), kept(dw, "dw"), MAX_LINK, MIN_NET, RADIUS, deduplicate=False)
    return out.withColumn("score", F.round("score", 6))


@query
def weights_points(spark, d):
    n = net(spark, d)
    return W.graph_weights(n, testnet.origins(spark, d), ["w"], 20).select("id", F.round("w", 9).alias("w"))


@query
def weights_coverage(spark, d):
    o = testnet.origins(spark, d)
    return W.coverage(W.graph_weights(net(spark, d), o, ["w"], 20), o, "w").select(F.round("coverage", 9).alias("coverage"))


@query
def weights_partition(spark, d):
    n = net(spark, d)
    v, e = tiling.partition(n, 3, 3, BUFFER)
    here = "tile_row = 0 and tile_col = 0"
    return W.partition_weights(N.Network(v.filter(here), e.filter(here)), W.graph_weights(n, testnet.origins(spark, d), ["w"], 20)).select("id", F.round("w", 9).alias("w"))


@query
def nearest_edge(spark, d):
    return routing.closest_edge(net(spark, d), testnet.origins(spark, d).select("k", "x", "y"), 100)


@query
def route_distance(spark, d):
    return routing.route(net(spark, d), (20.0, 30.0), (1200.0, 500.0)).select(F.round("distance", 6).alias("distance"))


@query
def distance_surface(spark, d):
    n = net(spark, d)
    return routing.distance_surface(n, _dist(n), (400.0, 300.0), 1000, 50)


@query
def regional_access(spark, d):
    n, dist, found = _links(spark, d)
    link = found.orderBy(*L.LINK).first().asDict()
    _, dw = _weighted(spark, d, n)
    return routing.regional_access(n, dist, link, dw, L.step_decay(1000), CUTOFF)


@query
def crossings(spark, d):
    n = net(spark, d)
    v = n.vertices
    a, b = v.select(F.col("id").alias("src"), "x", "y"), v.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))

    def diagonal(step: int, rule: str) -> DataFrame:
        s = a.filter(rule).withColumn("dst", F.col("src") + step).join(b, "dst")
        g = G.line((F.col("x"), F.col("y")), (F.col("x2"), F.col("y2")))
        return s.select("src", "dst", G.length(g).alias("length_m"), F.lit("bridge").alias("link_type"), g.alias("geom"))

    more = diagonal(21, "src < 10000000 and src % 20 < 19 and src % 3 = 0").unionByName(diagonal(19, "src < 10000000 and src % 20 > 0 and src % 4 = 0"))
    whole = N.Network(v, kept(n.edges.unionByName(more), "edges"))
    return routing.disconnected_crossings(whole, _dist(whole))


@query
def realize_edges(spark, d):
    n, _, found = _links(spark, d)
    return build.realize(n, kept(found.filter("fr_src < to_src"), "links")).edges.select("src", "dst", "length_m", "link_type")


@query
def collapse(spark, d):
    return N.collapse(net(spark, d)).edges.select("src", "dst", F.round("length_m", 6).alias("length_m"), "link_type", F.size("geom").alias("points"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    e = net(spark, d).edges
    return e.select((F.col("src") * 2 + F.when(F.col("dst") == F.col("src") + 1, 0).otherwise(1)).alias("seq"), "geom", "link_type")


@query
def snap_vertices(spark, d):
    e = _lines(spark, d)
    pts = e.select((F.col("seq") * 2).alias("seq"), G.first_point(F.col("geom")).alias("p")).union(e.select(F.col("seq") * 2 + 1, G.last_point(F.col("geom"))))
    return build.snap_vertices(pts.select("seq", "p.x", "p.y"), 1.0)


@query
def build_from_layers(spark, d):
    return build.from_lines(_lines(spark, d), 1e-6, 50).edges.select("src", "dst", "length_m", "link_type")


@query
def node_lines(spark, d):
    g = F.col("geom")
    longer = _lines(spark, d).withColumn("geom", F.array(G.first_point(g), G.point(G.last_point(g)["x"] + 0.1, G.last_point(g)["y"] + 0.1)))
    return build.node_lines(longer, 0.5, 0.5).select("seq", "piece", *_ends(g), "link_type")


@query
def short_edges(spark, d):
    return build.add_short_edges(net(spark, d), 82.0).edges.filter("link_type = 'short'").select("src", "dst", "length_m")


@query
def link_points(spark, d):
    pts = testnet.origins(spark, d).select(F.col("k").alias("seq"), "x", "y")
    return build.link_points(net(spark, d), pts, create=True)[1]


def _tags(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    entries = F.array(F.when(s % 3 == 0, F.struct(F.lit("highway").alias("key"), F.lit("path").alias("value"))), F.when(s % 4 == 1, F.struct(F.lit("access").alias("key"), F.lit("no").alias("value"))), F.when(s % 5 == 2, F.struct(F.lit("foot").alias("key"), F.lit("yes").alias("value"))), F.struct(F.lit("name").alias("key"), F.col("p_partkey").cast("string").alias("value")))
    return testnet._table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("tags"))


@query
def osm_traversable(spark, d):
    return _tags(spark, d).select("id", osm.TagSets()(F.col("tags")).alias("walkable"))


@query
def osm_traversable_rules(spark, d):
    return _tags(spark, d).select("id", osm.Rules()(F.col("tags")).alias("walkable"))


@query
def osm_edges(spark, d):
    v = net(spark, d, islands=False).vertices
    nodes = v.select("id", F.col("x").alias("lon"), F.col("y").alias("lat"))
    row = v.groupBy(F.expr("id div 20").alias("r")).agg(F.array_sort(F.collect_list("id")).alias("nodes")).select(F.col("r").cast("long").alias("id"), "nodes")
    col = v.groupBy((F.col("id") % 20).alias("c")).agg(F.array_sort(F.collect_list("id")).alias("nodes")).select((F.col("c") + 1_000_000).alias("id"), "nodes")
    ways = row.unionByName(col).withColumn("tags", F.create_map(F.lit("highway"), F.lit("path")))
    return osm.from_osm(nodes, ways).edges.select("src", "dst", F.round("length_m", 6).alias("length_m"), "link_type", F.size("geom").alias("points"))


@query
def tntp_body(spark, d):
    return sinks.tntp_body(net(spark, d))


@query
def graphml(spark, d):
    return sinks.graphml_lines(net(spark, d))
