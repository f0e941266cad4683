"""Street-map extracts: traversal rules over tags, and edges from nodes and ways."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from netgap.functions import geometry as G
from netgap.sources.numbers import numbered
from netgap.operators.network import Network, ordered
from netgap.sources.shared import written


def tags(text: str) -> frozenset[tuple[str, str]]:
    return frozenset(tuple(t.split("=", 1)) for t in text.split())


#: The default tags.
WALKABLE = tags(
    "highway=footway highway=cycleway highway=pedestrian highway=track highway=sidewalk highway=service highway=road highway=steps "
    "highway=path highway=crossing highway=residential sidewalk=yes sidewalk=both sidewalk=left sidewalk=right "
    "sidewalk:left=yes sidewalk:right=yes sidewalk:both=yes"
)
NOT_WALKABLE = tags("foot=no access=no")
OVERRIDE = tags("foot=yes foot=designated")


@dataclass(frozen=True)
class TagSets:
    """Traversable if a tag is in ``override``, or one is in ``walkable`` and none in ``barred``.  A tag counts for the
    first set that has it, in the order walkable, barred, override."""

    walkable: frozenset[tuple[str, str]] = WALKABLE
    barred: frozenset[tuple[str, str]] = NOT_WALKABLE
    override: frozenset[tuple[str, str]] = OVERRIDE

    def __call__(self, tag_map: Column) -> Column:
        yes, no = self.walkable, self.barred - self.walkable
        over = self.override - self.barred - self.walkable
        return F.coalesce(_any(tag_map, over) | (_any(tag_map, yes) & ~_any(tag_map, no)), F.lit(False))


@dataclass(frozen=True)
class Rules:
    """The first rule with a matching tag decides, else ``default``."""

    rules: tuple[tuple[frozenset[tuple[str, str]], bool], ...] = field(default=((OVERRIDE, True), (NOT_WALKABLE, False), (WALKABLE, True)))
    default: bool = False

    def __call__(self, tag_map: Column) -> Column:
        out = F
        for found, value in self.rules:
            out = out.when(_any(tag_map, found), value)
        return F.lit(self.default) if out is F else out.otherwise(self.default)


def _any(tag_map: Column, found: frozenset[tuple[str, str]]) -> Column:
    wanted = [f"{k}={v}" for k, v in sorted(found)]
    if not wanted:
        return F.lit(False)
    own = F.transform(F.map_entries(tag_map), lambda t: F.concat(t["key"], F.lit("="), t["value"]))
    return F.coalesce(F.arrays_overlap(own, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def from_osm(nodes: DataFrame, ways: DataFrame, traversable: Callable[[Column], Column] | None = None, project: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> Network:
    """Edges between intersections of traversable ways; vertex ids are node ids.

    ``nodes``: id, lon, lat; ``ways``: id, nodes array, tags map.  A node ends a segment if it ends its way, is met a
    second time (in any way's non-final places), or if the next node closes the loop to its segment's or way's begin.
    The second edge of a vertex pair is split in its middle at a new vertex with a negative id.
    """
    project = project or (lambda lon, lat: (lon, lat))
    use = ways.filter((traversable or TagSets())(F.col("tags")) & (F.size("nodes") > 1)).select("id", "nodes", F.coalesce(F.element_at("tags", "highway"), F.lit("missing")).alias("link_type"))
    use = written(use, "ways")
    n = F.size("nodes")
    places = use.select("id", F.posexplode("nodes").alias("i", "node"), n.alias("n"), F.element_at("nodes", 1).alias("begin"), F.col("nodes").alias("all"))
    places = places.withColumn("closes", (F.col("i") < F.col("n") - 1) & (F.get("all", F.col("i") + 1) == F.col("begin")) & (F.col("i") > 0)).drop("all")
    seen = places.groupBy("node").agg(F.max((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)).alias("end"), F.count(F.when(F.col("i") < F.col("n") - 1, 1)).alias("times"), F.max("closes").alias("closes"))
    cross = seen.filter("end or times > 1 or closes").select("node", F.lit(True).alias("cut"))
    marked = places.join(cross, "node", "left").select("id", "i", "node", "n", F.coalesce("cut", F.lit(False)).alias("cut"))
    listed = marked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "node", "cut"))).alias("p"))

    def cuts(p: Column) -> Column:
        """Positions where segments end: state (begin node, ends so far)."""
        start = F.struct(p[0]["node"].alias("node"), F.array(F.lit(0)).alias("ends"))

        def step(h: Column, s: Column) -> Column:
            last = s["i"] == F.size(p) - 1
            closing = F.coalesce(F.get(p, s["i"] + 1)["node"] == h["node"], F.lit(False))
            stop = s["cut"] | last | closing
            return F.struct(F.when(stop, s["node"]).otherwise(h["node"]).alias("node"), F.when(stop, F.concat(h["ends"], F.array(s["i"]))).otherwise(h["ends"]).alias("ends"))

        return F.aggregate(F.slice(p, F.lit(2), F.size(p) - 1), start, step, lambda h: h["ends"])

    ended = listed.withColumn("e", G.let(F.col("p"), cuts))
    pieces = ended.select("id", "p", F.posexplode(F.zip_with(F.slice("e", F.lit(1), F.size("e") - 1), F.slice("e", F.lit(2), F.size("e") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("piece", "s"))
    parts = pieces.select("id", "piece", F.slice("p", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1).alias("p"))
    x, y = project(F.col("lon").cast("double"), F.col("lat").cast("double"))
    where = nodes.select(F.col("id").alias("node"), x.alias("x"), y.alias("y"))
    located = parts.select("id", "piece", F.posexplode(F.transform("p", lambda p: p["node"])).alias("k", "node")).join(where, "node")
    lines = located.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct("k", "node", G.point(F.col("x"), F.col("y")).alias("pt")))).alias("q"))
    geom = F.transform("q", lambda q: q["pt"])
    edges = lines.join(use.select("id", "link_type"), "id").select(F.struct("id", "piece").alias("seq"), F.element_at("q", 1)["node"].alias("src"), F.element_at("q", -1)["node"].alias("dst"), G.length(geom).alias("length_m"), "link_type", geom.alias("geom"))
    edges = written(ordered(edges), "edges")
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("seq"))
    ranked = written(edges.withColumn("r", rank), "ranked")
    extra = numbered(ranked.filter("r > 1 or src = dst"), "seq", "k").withColumn("new", -F.col("k"))
    middle = F.col("length_m") / 2
    cut = written(extra.withColumn("head", G.line_between(F.col("geom"), F.lit(0.0), middle)).withColumn("tail", G.line_between(F.col("geom"), middle, F.col("length_m"))), "split")
    halves = cut.select("src", F.col("new").alias("dst"), middle.alias("length_m"), "link_type", F.col("head").alias("geom")).union(cut.select("new", "dst", middle, "link_type", "tail"))
    whole = ranked.filter("r = 1 and src <> dst").select("src", "dst", "length_m", "link_type", "geom")
    all_edges = whole.unionByName(ordered(halves).select(*whole.columns))
    used = all_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    vertices = where.join(used, "node", "left_semi").select(F.col("node").alias("id"), "x", "y").union(cut.select("new", F.element_at("tail", 1)["x"], F.element_at("tail", 1)["y"]))
    return Network(vertices, all_edges)
