"""Geometry expressions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from netgap.functions import geometry as G


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, c):
    return one.select(c.alias("v")).first().v


def pts(v):
    return [(p.x, p.y) for p in v]


def test_scalars(one):
    g = G.line((0, 0), (3, 4), (3, 10))
    assert value(one, G.length(g)) == 11
    assert value(one, G.wkt(g)) == "LINESTRING (0.0 0.0, 3.0 4.0, 3.0 10.0)"
    assert pts(value(one, G.reverse(g))) == [(3, 10), (3, 4), (0, 0)]
    assert tuple(value(one, G.envelope(g))) == (0, 0, 3, 10)
    for at, want in ((-1, (0, 0)), (2.5, (1.5, 2)), (5, (3, 4)), (8, (3, 7)), (99, (3, 10))):
        assert tuple(value(one, G.interpolate(g, F.lit(float(at))))) == want


def test_line_between(one):
    g = G.line((0, 0), (3, 4), (3, 10))
    assert pts(value(one, G.line_between(g, F.lit(2.5), F.lit(8.0)))) == [(1.5, 2), (3, 4), (3, 7)]
    assert pts(value(one, G.line_between(g, F.lit(0.0), F.lit(5.0)))) == [(0, 0), (3, 4)]
    assert pts(value(one, G.line_between(g, F.lit(5.0), F.lit(11.0)))) == [(3, 4), (3, 10)]
    with pytest.raises(Exception):
        value(one, G.line_between(g, F.lit(3.0), F.lit(3.0)))


@pytest.mark.parametrize(("points", "limit", "pieces", "size"), [([(0, 0), (475, 0)], 250, 2, 237.5), ([(0, 0), (200, 200)], 250, 2, 141.4213562373095), ([(0, 0), (90, 0), (90, 90), (180, 90), (180, 180)], 100, 4, 90), ([(0, 0), (10, 0)], 250, 1, 10), ([(0, 0), (500, 0)], 250, 3, 500 / 3)])
def test_break_long(one, points, limit, pieces, size):
    found = G.break_long(one.withColumn("g", G.line(*points)), "g", limit).select(G.length(F.col("g")).alias("n")).collect()
    assert len(found) == pieces and all(abs(r.n - size) < 1e-9 for r in found)


def test_project_and_nearest(one):
    g = G.line((0, 0), (10, 0), (10, 10))
    assert tuple(value(one, G.project(g, G.point(12, 4)))) == (2, 14)
    assert tuple(value(one, G.project(g, G.point(-3, -4)))) == (5, 0)
    n = value(one, G.nearest(G.line((0, 0), (10, 0)), G.line((0, 2), (5, 2), (6, 1))))
    assert (n.dist, n.along_g, n.along_h) == (1, 6, 5 + 2**0.5)
    x = value(one, G.nearest(G.line((0, 0), (2, 2)), G.line((0, 2), (2, 0))))
    assert x.dist == 0 and abs(x.along_g - 2**0.5) < 1e-12


def test_polygon(one):
    ring = F.array(G.line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)))
    assert value(one, G.line_polygon_distance(G.line((1, 1), (2, 2)), ring)) == 0
    assert value(one, G.line_polygon_distance(G.line((7, 0), (7, 4)), ring)) == 3
