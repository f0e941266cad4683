"""Bounded network distances: a sparse table (origin, dest, d) of whole metres; an absent row means unreachable."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netgap.operators.network import UNREACHABLE, Network, arcs, component_sizes
from netgap.sources.shared import kept

DIST = "origin long, dest long, d int"
#: Arcs up to which one process takes the graph.
KERNEL_ARCS = 4_000_000
#: Distances held at once by a search (8 bytes each, and 4 of marks), and rows given out at once.
CELLS, ROWS = 2_000_000, 200_000
#: Up to this many times its length an edge may span in space for the network to be searched in blocks.
MOST_RATIO = 8.0


def shortest(adjacency: dict[int, list[tuple[int, float]]], origin: int, limit: float, goals: set[int] | None = None) -> dict[int, float]:
    """Distances from one origin, up to ``limit``, or until all of ``goals`` are reached."""
    left = set(goals) if goals is not None else None
    done: dict[int, float] = {}
    heap = [(0.0, origin)]
    best = {origin: 0.0}
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        if left is not None:
            left.discard(u)
            if not left:
                break
        for v, w in adjacency.get(u, ()):
            e = d + w
            if e <= limit and e < best.get(v, np.inf):
                best[v] = e
                heapq.heappush(heap, (e, v))
    return done


def adjacency_of(edges: DataFrame, limit: int = KERNEL_ARCS) -> dict[int, list[tuple[int, float]]] | None:
    """The graph as lists of arcs, or None if it has more than ``limit`` arcs."""
    if 2 * edges.count() > limit:
        return None
    out: dict[int, list[tuple[int, float]]] = {}
    rows = arcs(edges).toArrow()
    for u, v, w in zip(*(rows[c].to_pylist() for c in ("u", "v", "length_m")), strict=True):
        out.setdefault(u, []).append((v, w))
    return out


def distance_table(net: Network, maxdist: float = 5000, origins: DataFrame | None = None, method: str = "auto", exact: bool = False) -> DataFrame:
    """All pairs within ``maxdist``; lengths add in floating point and are rounded half to even once.

    ``method``: ``kernel`` searches the parts of the network around blocks of origins (``Search``); ``relax`` joins
    frontiers with the arcs until nothing improves; ``auto`` takes the kernel unless places don't bound lengths.
    ``exact`` gives unrounded doubles.
    """
    search = Search(net, maxdist) if method != "relax" else None
    if method == "kernel" and not search.bounded:
        raise ValueError("the places of the vertices don't bound the lengths of the edges")
    starts = (net.vertices if origins is None else origins).select(F.col("id").alias("origin"))
    found = search.reached(starts) if search is not None and search.bounded else _relax(starts, net, maxdist)
    if exact:
        return found
    if maxdist > UNREACHABLE - 1:
        raise ValueError("distances are kept below 65535 m")
    return found.select("origin", "dest", F.rint("d").cast("int").alias("d"))


def reach(first: np.ndarray, to: np.ndarray, w: np.ndarray, starts: np.ndarray, n: int, limit: float) -> np.ndarray:
    """Distances up to ``limit`` (else infinite) from each of ``starts`` to the ``n`` nodes of a graph of arcs, all
    starts at once: rounds over the places that have come nearer.  Sums run from the start on, as in ``shortest``."""
    best = np.full(len(starts) * n, np.inf)
    mark = np.zeros(len(starts) * n, np.int32)
    at = np.arange(len(starts)) * n + starts
    best[at] = 0.0
    while len(at):
        node = at % n
        many = first[node + 1] - first[node]
        end = np.cumsum(many)
        arc = np.arange(end[-1]) + np.repeat(first[node] - end + many, many)
        d = np.repeat(best[at], many) + w[arc]
        goal = np.repeat(at - node, many) + to[arc]
        better = (d <= limit) & (d < best[goal])
        goal, d = goal[better], d[better]
        np.minimum.at(best, goal, d)
        goal = goal[best[goal] == d]
        number = np.arange(len(goal), dtype=np.int32)
        mark[goal] = number
        at = goal[mark[goal] == number]
    return best.reshape(len(starts), n)


class Graph:
    """Edges of one block as arcs; ``nodes`` are their sorted names."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, more: np.ndarray) -> None:
        self.nodes, index = np.unique(np.concatenate([u, v, more]), return_inverse=True)
        a, b = index[: len(u)], index[len(u) : 2 * len(u)]
        tail, head, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        order = np.argsort(tail, kind="stable")
        self.to, self.w = head[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(self.nodes)))])

    def index(self, names: np.ndarray) -> np.ndarray:
        """Positions in ``nodes``; -1 for others."""
        i = np.minimum(np.searchsorted(self.nodes, names), len(self.nodes) - 1)
        return np.where(self.nodes[i] == names, i, -1)

    def reach(self, starts: np.ndarray, limit: float) -> Iterator[tuple[slice, np.ndarray]]:
        """Distances from ``starts`` (positions), a bounded number of them at a time."""
        step = max(1, CELLS // len(self.nodes))
        for i in range(0, len(starts), step):
            yield slice(i, i + step), reach(self.first, self.to, self.w, starts[i : i + step], len(self.nodes), limit)


class Search:
    """Distances up to ``maxdist``, searched block by block where they are asked for.

    Places bound lengths: an edge leads no further than ``ratio`` times its length, so a path of at most ``maxdist`` stays
    within ``maxdist * ratio`` of its origin.  A task has the origins of one grid cell and the edges around it, whatever
    the size of the network.  Where an edge has no place, or is longer in space than any multiple of its length,
    ``bounded`` is false and tables are relaxed instead.
    """

    def __init__(self, net: Network, maxdist: float, other: Search | None = None) -> None:
        self.net, self.maxdist = net, maxdist
        if other is None:
            v = net.vertices
            a, b = (v.select(F.col("id").alias(i), F.col("x").alias(f"{i}x"), F.col("y").alias(f"{i}y")) for i in "uv")
            e = net.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("length_m").alias("w"))
            self.edges = kept(e.join(a, "u", "left").join(b, "v", "left"), "places")
            gap = F.sqrt((F.col("ux") - F.col("vx")) ** 2 + (F.col("uy") - F.col("vy")) ** 2)
            ratio = F.when(gap == 0, 0.0).when(F.col("w") > 0, gap / F.col("w")).otherwise(float("inf"))
            found = self.edges.agg(F.max(F.coalesce(ratio, F.lit(float("inf")))).alias("ratio"), F.max(gap).alias("gap"), F.count("*").alias("n")).first()
            self.ratio, self.gap, self.count = found.ratio or 0.0, found.gap or 0.0, found.n
        else:
            self.edges, self.ratio, self.gap, self.count = other.edges, other.ratio, other.gap, other.count
        self.bounded = self.ratio <= MOST_RATIO and maxdist < float("inf")
        self.pad = maxdist * self.ratio * (1 + 1e-9) if self.bounded else float("inf")

    def to(self, maxdist: float) -> Search:
        """The same network, searched to another bound."""
        return Search(self.net, maxdist, self)

    def table(self, origins: DataFrame | None = None) -> DataFrame:
        """All pairs from ``origins`` (id; all vertices by default): origin, dest, d."""
        starts = (self.net.vertices if origins is None else origins).select(F.col("id").alias("origin"))
        found = self.reached(starts) if self.bounded else _relax(starts, self.net, self.maxdist)
        return found.select("origin", "dest", F.rint("d").cast("int").alias("d"))

    def reached(self, starts: DataFrame) -> DataFrame:
        limit = self.maxdist

        def work(graph: Callable[[np.ndarray], Graph], items: pa.Table, _: pa.Table) -> Iterator[pa.RecordBatch]:
            names = np.unique(items["origin"].to_numpy())
            g = graph(names)
            for part, d in g.reach(g.index(names), limit):
                o, v = np.nonzero(d < np.inf)
                for i in range(0, len(o), ROWS):
                    s = slice(i, i + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(names[part][o[s]]), pa.array(g.nodes[v[s]]), pa.array(d[o[s], v[s]])], ["origin", "dest", "d"])

        return self.blocks(self.placed(starts, "origin"), "origin", work, "origin long, dest long, d double", self.pad)

    def least(self, rows: DataFrame, exact: bool = False) -> DataFrame:
        """k, n: the least of ``d + off + o0`` and ``d + off + o1`` over the ways (k, origin, off, t0, o0, t1, o1) of
        each k that are within reach; d is rounded unless ``exact``."""
        kind = "double" if exact else "int"
        if not self.bounded:
            dist = _relax(rows.select("origin").distinct(), self.net, self.maxdist)
            ways = rows.select("k", "origin", "off", F.explode(F.array(*[F.struct(F.col(f"t{i}").alias("dest"), F.col(f"o{i}").alias("end")) for i in (0, 1)])).alias("e")).select("k", "origin", "off", "e.*")
            d = F.col("d") if exact else F.rint("d").cast("int")
            total = d + (F.col("off") + F.col("end"))
            return ways.join(dist, ["origin", "dest"]).groupBy("k").agg(F.min(total if exact else _in_range(total)).alias("n"))
        limit = self.maxdist

        def work(graph: Callable[[np.ndarray], Graph], items: pa.Table, _: pa.Table) -> Iterator[pa.RecordBatch]:
            of = {c: items[c].to_numpy() for c in ("k", "origin", "off", "t0", "o0", "t1", "o1")}
            names, which = np.unique(of["origin"], return_inverse=True)
            order = np.argsort(which, kind="stable")
            g = graph(names)
            ends = [g.index(of[t]) for t in ("t0", "t1")]
            for part, d in g.reach(g.index(names), limit):
                at = order[np.searchsorted(which[order], part.start) : np.searchsorted(which[order], part.start + len(d))]
                best = np.full(len(at), np.inf)
                for end, o in zip(ends, ("o0", "o1"), strict=True):
                    x = np.where(end[at] < 0, np.inf, d[which[at] - part.start, end[at]])
                    total = (x if exact else np.rint(x)) + (of["off"][at] + of[o][at])
                    if not exact and (total[np.isfinite(total)] > UNREACHABLE).any():
                        raise ValueError("distance overflow")
                    best = np.minimum(best, total)
                hit = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(of["k"][at][hit]), pa.array(best[hit] if exact else best[hit].astype(np.int32))], ["k", "n"])

        found = self.blocks(self.placed(rows, "origin"), "origin", work, f"k long, n {kind}", self.pad)
        return found.groupBy("k").agg(F.min("n").alias("n"))

    def placed(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with the place (x, y) of vertex ``key``."""
        return rows.join(self.net.vertices.select(F.col("id").alias(key), "x", "y"), key)

    def blocks(self, items: DataFrame, key: str, work: Callable, schema: str, pad: float, many: int = 2000, beside: DataFrame | None = None) -> DataFrame:
        """``work(graph, rows, others)`` on the rows of each grid cell by place (x, y); ``graph(more)`` has the edges with
        both ends up to ``pad`` from it, and ``others`` are the rows of ``beside`` (x, y) that near.  Cells with more than
        ``many`` rows are dealt over several blocks by ``key``."""
        items = kept(items, "items")
        side = 2 * pad or 1.0
        cell = lambda c, s: F.floor(F.col(c) / s)
        filled = items.select(cell("x", side).alias("cx"), cell("y", side).alias("cy"), key).distinct().groupBy("cx", "cy").count().agg(F.avg("count")).first()[0] or 1
        side *= max(1.0, (500 / filled) ** 0.5)
        items = items.withColumn("cx", cell("x", side)).withColumn("cy", cell("y", side))
        cells = kept(items.groupBy("cx", "cy").agg(F.ceil(F.count("*") / many).alias("parts")), "cells")
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))

        def around(rows: DataFrame, x: tuple[str, str], y: tuple[str, str], kind: int) -> DataFrame:
            for c, (a, b) in (("cx", x), ("cy", y)):
                low, high = F.floor((F.greatest(a, b) - pad) / side), F.floor((F.least(a, b) + pad) / side)
                rows = rows.filter(low <= high).withColumn(c, F.explode(F.sequence(low, high)))
            return rows.drop(*x, *y).join(cells, ["cx", "cy"]).withColumn("part", part).drop("parts").withColumn("kind", F.lit(kind))

        own = items.join(cells, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts", "x", "y").withColumn("kind", F.lit(2))
        rows = around(self.edges, ("ux", "vx"), ("uy", "vy"), 0)
        if beside is not None:
            rows = rows.unionByName(around(beside.withColumn("x2", F.col("x")).withColumn("y2", F.col("y")), ("x", "x2"), ("y", "y2"), 1), allowMissingColumns=True)
        rows = rows.unionByName(own, allowMissingColumns=True)
        spark = items.sparkSession
        n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.count // 50_000))
        rows = rows.repartition(n, "cx", "cy", "part").sortWithinPartitions("cx", "cy", "part", "kind")

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            one, two = np.searchsorted(whole["kind"].to_numpy(), [1, 2])
            u, v, w = (whole[c].slice(0, one).to_numpy() for c in "uvw")
            if two < whole.num_rows:
                yield from work(lambda more: Graph(u, v, w, more), whole.slice(two), whole.slice(one, two - one))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last = [], None
            for b in batches:
                k = np.stack([b.column(c).to_numpy() for c in ("cx", "cy", "part")])
                edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
                for i, j in zip(edges, edges[1:], strict=False):
                    if i == j:
                        continue
                    now = tuple(k[:, i].tolist())
                    if held and now != last:
                        yield from block(held)
                        held = []
                    held, last = [*held, b.slice(i, j - i)], now
            if held:
                yield from block(held)

        return rows.mapInArrow(run, schema)


def _relax(starts: DataFrame, net: Network, maxdist: float, rounds: int = 10_000) -> DataFrame:
    out = kept(starts.select("origin", F.col("origin").alias("dest"), F.lit(0.0).alias("d")), "reach")
    frontier, links = out, kept(arcs(net.edges), "arcs")
    for _ in range(rounds):
        step = frontier.join(links, frontier.dest == links.u).select("origin", F.col("v").alias("dest"), (F.col("d") + F.col("length_m")).alias("d")).filter(F.col("d") <= maxdist)
        best = step.groupBy("origin", "dest").agg(F.min("d").alias("n"))
        frontier = kept(best.join(out, ["origin", "dest"], "left").filter(F.col("d").isNull() | (F.col("n") < F.col("d"))).select("origin", "dest", F.col("n").alias("d")), "frontier")
        if frontier.isEmpty():
            return out
        out = kept(out.unionByName(frontier).groupBy("origin", "dest").agg(F.min("d").alias("d")), "reach")
    raise RuntimeError("distances did not settle")


def plus(d: Column, y: Column) -> Column:
    """``d + round(y)``; null (unreachable) stays null, and sums over the range of 16 bits raise."""
    return _in_range(d + F.rint(y).cast("int"))


def _in_range(total: Column) -> Column:
    return F.when(total > UNREACHABLE, F.raise_error(F.lit("distance overflow")).cast("int")).otherwise(total)


ENDS = ("fr_src", "fr_tgt", "fr_from_start", "fr_to_end", "to_src", "to_tgt", "to_from_start", "to_to_end")


def net_distance(pairs: DataFrame, dist: DataFrame | Search, out: str = "net_m") -> DataFrame:
    """Network distance between two positions on edges (columns ``ENDS``); null if unreachable.

    ``dist`` is a table, joined once by the four combinations of ends as rows; or a search, which finds only these.
    """
    same = (F.col("fr_src") == F.col("to_src")) & (F.col("fr_tgt") == F.col("to_tgt"))
    turned = (F.col("fr_src") == F.col("to_tgt")) & (F.col("fr_tgt") == F.col("to_src")) & ~same
    value = F.when(turned, F.raise_error(F.lit("an edge and its reverse")).cast("int")).when(same, F.abs(F.col("fr_from_start") - F.col("to_from_start"))).otherwise(F.col("_n"))
    if isinstance(dist, Search):
        keyed = kept(pairs.withColumn("_k", F.monotonically_increasing_id()), "pairs")
        best = dist.least(_ways(keyed)).select(F.col("k").alias("_k"), F.col("n").alias("_n"))
    else:
        keyed = pairs.withColumn("_k", F.struct(*ENDS))
        combos = F.array(*[F.struct(F.col(o).alias("origin"), F.col(t).alias("dest"), (F.col(a) + F.col(b)).alias("off")) for o, a in (("fr_src", "fr_from_start"), ("fr_tgt", "fr_to_end")) for t, b in (("to_src", "to_from_start"), ("to_tgt", "to_to_end"))])
        rows = keyed.select("_k", F.explode(combos).alias("c")).distinct().select("_k", "c.*")
        best = rows.join(dist, ["origin", "dest"]).groupBy("_k").agg(F.min(plus(F.col("d"), F.col("off"))).alias("_n"))
    return keyed.join(best, "_k", "left").withColumn(out, value.cast("int")).drop("_k", "_n")


def _ways(keyed: DataFrame) -> DataFrame:
    """The ways of each pair (numbered ``_k``) as ``Search.least`` wants them, one from each end of its first edge."""
    ends = F.array(*[F.struct(F.col(o).alias("origin"), F.col(a).cast("int").alias("off")) for o, a in (("fr_src", "fr_from_start"), ("fr_tgt", "fr_to_end"))])
    goal = [F.col(c).alias(k) for c, k in (("to_src", "t0"), ("to_tgt", "t1"))] + [F.col(c).cast("int").alias(k) for c, k in (("to_from_start", "o0"), ("to_to_end", "o1"))]
    return keyed.select(F.col("_k").alias("k"), F.explode(ends).alias("e"), *goal).select("k", "e.*", "t0", "o0", "t1", "o1")


def net_distance_exact(net: Network, links: DataFrame, out: str = "net_exact") -> DataFrame:
    """Unbounded network distance of each link, in metres (infinite if disconnected).

    Searched within a bound that is doubled for the links it doesn't settle; of those, links between components drop out.
    """
    keyed = kept(links.withColumn("_k", F.monotonically_increasing_id()), "pairs")
    if not keyed.filter((F.col("fr_src") == F.col("to_src")) & (F.col("fr_tgt") == F.col("to_tgt"))).isEmpty():
        raise ValueError("both ends of a link are on one edge")
    left, done = keyed.select("_k", *ENDS), None
    first = search = Search(net, 2000.0)
    while search.bounded and search.maxdist < 64 * first.maxdist:
        found = search.least(_ways(left), exact=True).filter(F.col("n") <= search.maxdist)
        now = kept(found.select(F.col("k").alias("_k"), F.col("n").alias("_n")), "exact")
        done = now if done is None else done.unionByName(now)
        left = kept(left.join(now, "_k", "left_anti"), "left")
        if left.isEmpty():
            break
        if search is first:
            label = component_sizes(net).select("id", "label")
            a, b = (label.select(F.col("id").alias(c), F.col("label").alias(f"_{c}")) for c in ("fr_src", "to_src"))
            left = kept(left.join(a, "fr_src").join(b, "to_src").filter("_fr_src = _to_src").select("_k", *ENDS), "left")
            if left.isEmpty():
                break
        search = search.to(2 * search.maxdist)
    else:
        now = Search(net, float("inf"), first).least(_ways(left), exact=True).select(F.col("k").alias("_k"), F.col("n").alias("_n"))
        done = now if done is None else done.unionByName(now)
    return keyed.join(done, "_k", "left").withColumn(out, F.coalesce("_n", F.lit(float("inf")))).drop("_k", "_n")
