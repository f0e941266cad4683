"""Steps that must not gather the network in the driver or in one process, against plain versions of them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from netgap.functions import batches, geometry as G
from netgap.operators import build, distance, links as L, network as N, routing, weights as W
from netgap.plans import catalogue
from netgap.sources import testnet

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def apart(monkeypatch):
    """Any attempt to gather the graph fails."""

    def no(*_, **__):
        raise AssertionError("the graph was gathered")

    monkeypatch.setattr(distance, "adjacency_of", no)
    monkeypatch.setattr(routing, "adjacency_of", no, raising=False)


def grid(spark, seed, share=0.7, side=7, shake=0.0, pitch=60):
    rng = random.Random(seed)
    at = {(x, y): (x * pitch + rng.uniform(-shake, shake), y * pitch + rng.uniform(-shake, shake)) for x in range(side) for y in range(side)}
    some = [(at[x, y], at[x + 1, y]) for x, y in itertools.product(range(side - 1), range(side)) if rng.random() < share]
    some += [(at[x, y], at[x, y + 1]) for x, y in itertools.product(range(side), range(side - 1)) if rng.random() < share]
    rows = [(i, list(g), None) for i, g in enumerate(some)]
    return build.from_lines(spark.createDataFrame(rows, f"seq long, geom {G.LINE}, link_type string"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_distances_in_blocks(spark, apart):
    g = grid(spark, 3, shake=9)
    assert rows_of(distance.distance_table(g, 170)) == rows_of(distance.distance_table(g, 170, method="relax"))
    some = g.vertices.filter("id % 5 = 0")
    assert rows_of(distance.distance_table(g, 170, some, exact=True)) == rows_of(distance.distance_table(g, 170, some, method="relax", exact=True))


def test_places_that_do_not_bound_lengths(spark):
    """Edges of length 0 between vertices that are apart: tables are relaxed."""
    g = grid(spark, 3)
    odd = N.Network(g.vertices, g.edges.withColumn("length_m", F.when(F.col("src") % 3 == 0, 0.0).otherwise(F.col("length_m"))))
    assert not distance.Search(odd, 170).bounded
    assert rows_of(distance.distance_table(odd, 170)) == rows_of(distance.distance_table(odd, 170, method="relax"))


def test_links_without_a_table(spark, apart):
    g = grid(spark, 4, 0.5)
    table, search = distance.distance_table(g, 400).cache(), distance.Search(g, 400)
    found = L.identify(g, search, 70, 200).cache()
    assert found.count() and rows_of(found) == rows_of(L.identify(g, table, 70, 200))
    assert rows_of(L.deduplicate(found, g, search, 90)) == rows_of(L.deduplicate(found, g, table, 90))
    w = g.vertices.select("id", (F.col("id") % 4).cast("double").alias("w"))
    for decay in (L.step_decay(300), L.linear_decay(300)):
        got, want = (rows_of(L.score(found, d, w, w.filter("id % 3 > 0"), decay, 300).withColumn("score", F.round("score", 5))) for d in (search, table))
        assert got == want and any(r[-1] for r in got)


def test_covers_in_blocks(spark, monkeypatch):
    """Only covers become rows, not the pairs of places that may be one; ends of long edges, far from a link, don't matter."""
    g = grid(spark, 9, 0.6, side=6, shake=12)
    far = build.from_lines(spark.createDataFrame([(0, [(0.0, -40.0), (900.0, -40.0)], None), (1, [(0.0, -40.0), (0.0, -90.0)], None)], f"seq long, geom {G.LINE}, link_type string"))
    shift = lambda e: e.withColumn("src", F.col("src") + 1000).withColumn("dst", F.col("dst") + 1000)
    g = N.Network(g.vertices.union(far.vertices.withColumn("id", F.col("id") + 1000)).cache(), g.edges.unionByName(shift(far.edges).select(g.edges.columns)).cache())
    table, search = distance.distance_table(g, 300).cache(), distance.Search(g, 300)
    links = L._ranked(L.identify(g, table, 70, 150).withColumn("ord", F.struct(*L.LINK[:8])), "ord").withColumn("link_id", F.col("ord")).cache()
    want = {r: rows_of(L.covered(links, g, table, r).filter("i < j")) for r in (60, 90.4)}

    def no(*_, **__):
        raise AssertionError("pairs of places became rows")

    monkeypatch.setattr(L, "net_distance", no)
    for cells in (distance.CELLS, 50):
        monkeypatch.setattr(L, "CELLS", cells)
        for r, rows in want.items():
            assert rows and rows_of(L.covered(links, g, search, r).filter("i < j")) == rows


def test_chains_of_links_take_few_rounds(spark, monkeypatch):
    rng = random.Random(2)
    n = 120
    cover = [(i, i + 1) for i in range(n - 1)] + [(i, i + rng.randrange(2, 5)) for i in range(n - 5) if rng.random() < 0.2]
    lead = {}
    for j in range(n):
        lead[j] = next((i for i, k in sorted(cover) if k == j and lead[i] == i), j)
    geo = [rng.randrange(9) for _ in range(n)]
    best = {min((geo[j], j) for j in lead if lead[j] == i)[1] for i in set(lead.values())}
    monkeypatch.setattr(L, "covered", lambda *_: spark.createDataFrame(cover, "i long, j long"))
    monkeypatch.setattr(L, "PAIRS", 50, raising=False)
    made, kept = [], L.kept
    monkeypatch.setattr(L, "kept", lambda df, name: (made.append(name), kept(df, name))[1])
    got = L.deduplicate(spark.createDataFrame(list(enumerate(geo)), "ord long, geo_m int"), None, None, 1)
    assert {r.ord for r in got.collect()} == best
    assert len(made) <= 8


def test_nearest_of_batches(spark):
    rng = random.Random(5)
    line = lambda n: [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(n)]
    rows = [(i, line(rng.randrange(1, 5)), line(rng.randrange(1, 5))) for i in range(400)]
    d = spark.createDataFrame(rows, f"i long, g {G.LINE}, h {G.LINE}").repartition(3)
    n = d.select("i", G.nearest(F.col("g"), F.col("h")).alias("n")).filter("n.dist <= 3").select("i", "n.dist", "n.along_g", "n.along_h")
    assert rows_of(batches.with_nearest(d, "g", "h", 3)) == rows_of(n)


def test_short_edges_equal_sequential(spark, monkeypatch):
    g = grid(spark, 6, 0.4, side=6, shake=25)
    got = build.add_short_edges(g, 90.0)
    monkeypatch.setattr(distance, "MOST_RATIO", -1.0)
    want = build.add_short_edges(g, 90.0)
    short = lambda n: rows_of(n.edges.filter("link_type = 'short'").select("src", "dst", "length_m"))
    assert short(got) and short(got) == short(want)


def test_short_edges_gather_nothing(spark, apart):
    assert catalogue.QUERIES["short_edges"](spark, SMALL).count()


def test_routes_gather_what_is_near(spark, apart):
    assert catalogue.QUERIES["route_distance"](spark, SMALL).count() == 1


def test_access_without_a_table(spark, apart):
    n = testnet.network(spark, SMALL)
    search, table = distance.Search(n, 1500), distance.distance_table(n, 1500).cache()
    link = L.identify(n, search, 100, 1000).orderBy(*L.LINK).first().asDict()
    w = n.vertices.select("id", F.lit(1.0).alias("w"))
    got, want = (rows_of(routing.regional_access(n, d, link, w, L.step_decay(1000), 1000)) for d in (search, table))
    assert got == want and any(r[-1] for r in got)
    got, want = (rows_of(routing.distance_surface(n, d, (400.0, 300.0), 1000, 50)) for d in (search, table))
    assert got == want


def test_packed_tables_are_not_broadcast(spark):
    """Files of regular numbers are far smaller than their rows, so their size is no reason to broadcast them."""
    n = testnet.network(spark, SMALL)
    for d in (n.edges, W.graph_weights(n, testnet.origins(spark, SMALL), ["w"], 20)):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_network_tables_are_not_broadcast(spark):
    """Nor are the unions that a network is made of: joins with them were broadcast one by one, all held by the driver."""
    n = testnet.network(spark, SMALL)
    for d in (n.vertices.join(n.edges.withColumnRenamed("src", "id"), "id"), n.edges.join(n.vertices.withColumnRenamed("id", "dst"), "dst", "left")):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()


def test_realize_is_a_small_plan(spark):
    g = grid(spark, 4, 0.5)
    found = L.identify(g, distance.Search(g, 400), 70, 200).filter("fr_src < to_src").cache()
    edges = build.realize(g, found).edges
    assert edges.filter("link_type = 'candidate'").count()
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2


def test_links_are_searched_once(spark):
    g = grid(spark, 4, 0.5)
    assert "MapInArrow" not in L.identify(g, distance.Search(g, 400), 70, 200)._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_frames(monkeypatch):
    """No group becomes a frame of its own."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def no(*_, **__):
        raise AssertionError("a frame for each group")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", no)


def test_points_are_linked_in_batches(spark, no_frames):
    line = build.from_lines(spark.createDataFrame([(0, [(0.0, 0.0), (100.0, 0.0)], None), (1, [(0.0, 50.0), (0.0, 90.0)], None)], f"seq long, geom {G.LINE}, link_type string"))
    at = [50.0, 0.4, 50.3, 99.5, 20.0, 49.2, 48.5]
    points = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(at)] + [(7, 1.0, 70.0), (8, 900.0, 900.0)], "seq long, x double, y double")
    got = {r.seq: (r.id, r.vtype) for r in build.link_points(line, points)[1].collect()}
    a, b = line.edges.orderBy("length_m").collect()[1][:2]
    top = line.vertices.agg(F.max("id")).first()[0]
    new = [(top + i, "split") for i in range(1, 5)]
    assert got == {0: new[0], 1: (a, "node"), 2: new[0], 3: (b, "node"), 4: new[1], 5: new[0], 6: new[2], 7: new[3], 8: (None, None)}


def test_points_are_snapped_in_batches(spark, no_frames):
    points = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate((0, 2, 1, 9, 9.5, 0))], "seq long, x double, y double")
    assert rows_of(build.snap_vertices(points, 1.0)) == [(0, 1), (1, 2), (2, 1), (3, 3), (4, 3), (5, 1)]


def test_collapse_walks_in_batches(spark, no_frames):
    assert catalogue.QUERIES["collapse"](spark, SMALL).count()


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_keys_over_batches(spark, size):
    def work(b):
        at = batches.starts(b, ("k", "l"))
        return batches.pa.RecordBatch.from_pydict({"k": [b["k"][i].as_py() for i in at[:-1]], "l": [b["l"][i].as_py() for i in at[:-1]], "v": [b["v"][i:j].to_pylist() for i, j in itertools.pairwise(at)]})

    rng = random.Random(size)
    d = spark.createDataFrame([(rng.randrange(9), rng.randrange(3), i) for i in range(300)], "k long, l long, v long")
    want = d.groupBy("k", "l").agg(F.sort_array(F.collect_list("v")).alias("v"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert rows_of(batches.by_key(d, ("k", "l"), ("v",), work, "k long, l long, v array<long>")) == rows_of(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lines_broken_in_batches(spark):
    rng = random.Random(8)
    line = lambda n: [(float(rng.randrange(4)) + rng.choice((0, 1e-9)), float(rng.randrange(4))) for _ in range(n)]
    rows = [(i, "a", line(rng.randrange(0, 7))) for i in range(300)] + [(300, None, None)]
    d = spark.createDataFrame(rows, f"i long, t string, geom {G.LINE}").repartition(3)
    n = F.when(G.length(F.col("geom")) > 1.3, F.floor(G.length(F.col("geom")) / 1.3) + 1).otherwise(1).cast("int")
    want = d.withColumn("n", n).withColumn("len", G.length(F.col("geom"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = G.line_between(F.col("geom"), F.col("len") * F.col("piece") / F.col("n"), F.col("len") * (F.col("piece") + 1) / F.col("n"))
    want = want.withColumn("geom", F.when(F.col("n") == 1, F.col("geom")).otherwise(part)).drop("n", "len")
    got = G.break_long(d, "geom", 1.3)
    text = lambda df: sorted(map(repr, df.select("i", "piece", "t", "geom").collect()))
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert text(got) == text(want)
