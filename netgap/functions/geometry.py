"""Geometry as Column expressions.  A line is ``array<struct<x double, y double>>``, a point a struct, a polygon an
array of rings.  Only ``+ - * / sqrt`` are used, so results repeat bit for bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from netgap.functions import batches

LINE = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.transform(F.array(value), body)[0]


def point(x: Column | float, y: Column | float) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _c(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def line(*points: tuple[Column | float, Column | float]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Column, b: Column) -> Column:
    return norm(a["x"] - b["x"], a["y"] - b["y"])


def _pairs(g: Column, of: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), of)


def segments(g: Column) -> Column:
    """(a, b, d, start): ends, length and distance along the line of each segment."""
    pairs = _pairs(g, lambda a, b: F.struct(a.alias("a"), b.alias("b"), distance(a, b).alias("d")))
    return let(pairs, lambda p: F.transform(p, lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["d"].alias("d"), F.aggregate(F.slice(p, F.lit(1), i), F.lit(0.0), lambda t, q: t + q["d"]).alias("start"))))


def length(g: Column) -> Column:
    return F.aggregate(_pairs(g, distance), F.lit(0.0), lambda t, d: t + d)


def reverse(g: Column) -> Column:
    return F.reverse(g)


def first_point(g: Column) -> Column:
    return F.element_at(g, 1)


def last_point(g: Column) -> Column:
    return F.element_at(g, -1)


def envelope(g: Column) -> Column:
    xs, ys = F.transform(g, lambda p: p["x"]), F.transform(g, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def remove_elevation(g: Column) -> Column:
    return F.transform(g, lambda p: point(p["x"], p["y"]))


def wkt(g: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(g, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def interpolate(g: Column, at: Column) -> Column:
    """Point at a distance along the line, clamped to its ends."""

    def inside(segs: Column) -> Column:
        s = F.element_at(F.filter(segs, lambda s: (s["start"] + s["d"] >= at) & (s["d"] > 0)), 1)
        return let(s, lambda s: let((at - s["start"]) / s["d"], lambda t: point(s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"]), s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"]))))

    def by_length(segs: Column) -> Column:
        total = F.aggregate(segs, F.lit(0.0), lambda t, s: t + s["d"])
        return F.when(at <= 0, first_point(g)).when(at >= total, last_point(g)).otherwise(inside(segs))

    return let(segments(g), by_length)


def line_between(g: Column, begin: Column, end: Column, close: float = 1.5e-8) -> Column:
    """The part of the line between two distances; vertices that nearly repeat the point before them are left out."""

    def cut(segs: Column) -> Column:
        inner = F.transform(F.filter(segs, lambda s: (s["start"] + s["d"] > begin) & (s["start"] + s["d"] <= end)), lambda s: s["b"])
        points = F.concat(F.array(interpolate(g, begin)), inner)

        def add(held: Column, p: Column) -> Column:
            last = F.element_at(held, -1)
            near = F.greatest(norm(last["x"], last["y"]), norm(p["x"], p["y"])) * close
            return F.when((F.size(held) > 0) & (distance(last, p) <= near), held).otherwise(F.concat(held, F.array(p)))

        kept = F.aggregate(points, F.slice(points, 1, 1), lambda h, p: F.when(F.size(h) == 0, F.array(p)).otherwise(add(h, p)))
        final = interpolate(g, end)
        return let(kept, lambda k: F.when((F.size(k) > 1) & (distance(F.element_at(k, -1), final) <= norm(final["x"], final["y"]) * close), k).otherwise(F.concat(k, F.array(final))))

    return F.when(begin < end, let(segments(g), cut)).otherwise(F.raise_error(F.lit("line_between needs begin < end")).cast(LINE))


def break_long(df: DataFrame, geom: str, max_length: float, piece: str = "piece") -> DataFrame:
    """Explodes each line longer than ``max_length`` into floor(len / max) + 1 equal pieces (``piece`` counts from 0)."""
    out = df.withColumn("_len", length(F.col(geom))).withColumn("_n", F.when(F.col("_len") > max_length, F.floor(F.col("_len") / max_length) + 1).otherwise(1).cast("int"))
    return batches.broken(out, geom, "_n", "_len", piece)


def _on_segment(p: Column, s: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """``keep(distance, along)`` of the point of segment ``s`` nearest to ``p``."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    return let(
        F.when(s["d"] > 0, F.least(F.greatest(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))).otherwise(0.0),
        lambda t: keep(norm(p["x"] - (s["a"]["x"] + t * dx), p["y"] - (s["a"]["y"] + t * dy)), s["start"] + t * s["d"]),
    )


def project(g: Column, p: Column) -> Column:
    """(dist, along) of the position on the line nearest to the point; the first one on ties."""
    return F.array_min(F.transform(segments(g), lambda s: _on_segment(p, s, lambda d, a: F.struct(d.alias("dist"), a.alias("along")))))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def crossing(s: Column, q: Column, keep: Callable[[Column], Column]) -> Column:
    """``keep(t)``, t the share of ``s``, where two segments properly cross; else null."""
    c1, c2 = _cross(s["a"], s["b"], q["a"]), _cross(s["a"], s["b"], q["b"])
    c3, c4 = _cross(q["a"], q["b"], s["a"]), _cross(q["a"], q["b"], s["b"])
    return F.when((c1 * c2 < 0) & (c3 * c4 < 0), keep(c3 / (c3 - c4)))


def nearest(g: Column, h: Column) -> Column:
    """(dist, i, j, k, along_g, along_h) of the nearest points of two lines.

    Ties go by segment of ``g``, segment of ``h``, then: begin of h, end of h, begin of g, end of g.
    """

    def pair(s: Column, i: Column, q: Column, j: Column) -> Column:
        def found(k: int, d: Column, a: Column, b: Column) -> Column:
            return F.struct(d.alias("dist"), i.alias("i"), j.alias("j"), F.lit(k).alias("k"), a.alias("along_g"), b.alias("along_h"))

        ends = [
            _on_segment(q["a"], s, lambda d, a: found(0, d, a, q["start"])),
            _on_segment(q["b"], s, lambda d, a: found(1, d, a, q["start"] + q["d"])),
            _on_segment(s["a"], q, lambda d, a: found(2, d, s["start"], a)),
            _on_segment(s["b"], q, lambda d, a: found(3, d, s["start"] + s["d"], a)),
        ]
        cross = crossing(s, q, lambda t: crossing(q, s, lambda u: found(-1, F.lit(0.0), s["start"] + t * s["d"], q["start"] + u * q["d"])))
        return F.array_min(F.array(*ends, cross))

    return let(segments(h), lambda qs: F.array_min(F.flatten(F.transform(segments(g), lambda s, i: F.transform(qs, lambda q, j: pair(s, i, q, j))))))


def rings_contain(rings: Column, p: Column) -> Column:
    """Even-odd test of a point against the rings of a polygon."""
    hits = F.transform(rings, lambda r: F.size(F.filter(segments(r), lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]))))
    return F.aggregate(hits, F.lit(0), lambda a, n: a + n) % 2 == 1


def line_polygon_distance(g: Column, rings: Column) -> Column:
    """0 if the line starts inside; else the least distance to a ring."""
    return F.when(rings_contain(rings, first_point(g)), 0.0).otherwise(F.array_min(F.transform(rings, lambda r: nearest(g, r)["dist"])))


def approximately(a: Column, b: Column, relative: float = 1.5e-8, absolute: float = 0.0) -> Column:
    """Whether two numbers are equal up to the larger of both tolerances."""
    return (a == b) | (F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b))))


def same_line(g: Column, h: Column, relative: float = 1.5e-8, absolute: float = 0.0) -> Column:
    """Whether two lines have equally many points, at approximately the same places (the tolerance is one of distance)."""

    def close(p: Column, q: Column) -> Column:
        far = norm(p["x"] - q["x"], p["y"] - q["y"])
        return far <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(norm(p["x"], p["y"]), norm(q["x"], q["y"])))

    return (F.size(g) == F.size(h)) & F.forall(F.zip_with(g, h, lambda p, q: F.coalesce(close(p, q), F.lit(False))), lambda x: x)


def same_edge(a: Column, b: Column, relative: float = 1.5e-8, absolute: float = 0.0) -> Column:
    """Whether two edges (length_m, link_type, geom) are approximately equal; missing link types equal each other."""
    return approximately(a["length_m"], b["length_m"], relative, absolute) & a["link_type"].eqNullSafe(b["link_type"]) & same_line(a["geom"], b["geom"], relative, absolute)
