"""Operators on small fixtures made by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayrisk.functions import columns as C
from wayrisk.functions import geometry as G
from wayrisk.operators import hazard, joins, lookup, macro, network, od, routing, spatial, stats
from wayrisk.sources import tables as S


def one(df):
    return df.collect()[0][0]


def test_order_pair_of_two_negatives(spark):
    df = spark.createDataFrame([(-5.0, -2.0), (-2.0, 3.0), (4.0, 1.0)], "min_a double, max_a double")
    assert [tuple(r) for r in C.order_all_pairs(df).collect()] == [(-2.0, -5.0), (-2.0, 3.0), (1.0, 4.0)]


def test_one_probability_gives_the_product(spark):
    facts = spark.createDataFrame([("a", 0.1, 0.5, 1.0, 250.0, 1.0), ("b", 0.1, 0.5, 1.0, 250.0, 1.0), ("b", 0.3, 0.5, 2.0, 500.0, 1.0)], "id string, probability double, min_depth double, max_depth double, exposure double, edge_length double")
    got = {r.id: r for r in hazard.scenario_weights(facts, ["id"], 500).collect()}
    assert got["a"].risk_wt == pytest.approx(0.05) and got["b"].risk_wt == pytest.approx(0.2 * 0.75)
    assert got["b"].max_flood_depth == 2.0 and got["b"].dam_wt == pytest.approx(0.2 * 375)


def test_change_without_base_year(spark):
    df = spark.createDataFrame([("a", "b", 2016, 2.0), ("a", "m", 2050, 3.0), ("c", "m", 2050, 4.0), ("d", "b", 2016, 1.0), ("e", "m", 2050, 0.0)], "id string, climate_scenario string, year int, v double")
    got = {(r.id, r.climate_scenario): (r.current, r.future, r.change) for r in hazard.climate_change(df, ["id"], "v").collect()}
    assert got == {("a", "m"): (2.0, 3.0, 50.0), ("c", "m"): (0.0, 4.0, 1e9)}


def test_significant_figures(spark):
    df = spark.createDataFrame([(0.0,), (1234.0,), (0.0251,), (-77.0,)], "x double")
    assert [r[0] for r in df.select(C.round_significant(F.col("x"), 1)).collect()] == pytest.approx([0, 1000, 0.03, -80])


def test_discount_sums(spark):
    d = spark.range(1).select(C.discount_sums(0.1, 0.05, 2016, 2033, 8).alias("d")).select("d.*").first()
    assert d.plain == pytest.approx(sum(1.1**-k for k in range(17)))
    assert d.growing == pytest.approx(sum((1.05 / 1.1) ** k for k in range(17)))
    assert d.periodic == pytest.approx(1.1**-8 + 1.1**-16)


def test_one_to_many_needs_unique_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        joins.one_to_many(a, spark.createDataFrame([(1, 2)], "k int, w int"), ["k"]).collect()


def test_nearer_direction(spark):
    f = spark.createDataFrame([("r", 1.0, 9.0), ("r", 2.0, 8.0)], "route string, start double, d double")
    b = spark.createDataFrame([("r", 1.0, 1.5), ("r", 2.0, 2.5)], "route string, start double, d double")
    assert sorted(r.d for r in lookup.nearer_direction(f, b, "route", "start", "d").collect()) == [1.5, 2.5]


def test_files_and_sweeps(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 0.02), (2, 20, 0.02)], "id int, duration int, growth double")
    S.write_results(df, str(tmp_path / "r"), ["duration", "growth"])
    assert S.read_results(spark, str(tmp_path / "r")).where("duration = 20").select("id").collect()[0][0] == 2
    (tmp_path / "t.csv").write_text("﻿name,tons\nñ,2.5\n", encoding="utf-8")
    assert tuple(S.read_csv(spark, str(tmp_path / "t.csv"), "name string, tons double").first()) == ("ñ", 2.5)
    hits = spark.createDataFrame([("f", 1)], "file_name string, n int")
    assert S.with_scenarios(hits, spark.createDataFrame([("f", "river")], "file_name string, hazard_type string")).first().hazard_type == "river"


def ring(*xy):
    return [{"x": float(a), "y": float(b)} for a, b in (*xy, xy[0])]


def test_geodesic_degree_of_the_equator():
    km = G.geodesic_km(*(np.array([v]) for v in (0.0, 0.0, 1.0, 0.0)))
    assert km[0] == pytest.approx(111.319, abs=1e-3)
    assert G.geodesic_km(*(np.array([v]) for v in (0.0, 0.0, 0.0, 1.0)))[0] == pytest.approx(110.574, abs=1e-3)
    assert G.geodesic_km(*(np.array([v]) for v in (5.0, 5.0, 5.0, 5.0)))[0] == 0


def test_polygon_predicates_and_clips(spark):
    notched = ring((0, 0), (10, 0), (10, 10), (5, 5), (0, 10))
    schema = "ring array<struct<x double, y double>>, x double, y double"
    df = spark.createDataFrame([(notched, 5.0, 8.0), (notched, 1.0, 1.0), (notched, 10.0, 5.0), (notched, 5.0, 5.0)], schema)
    assert [r[0] for r in df.select(G.in_polygon(F.col("ring"), F.col("x"), F.col("y"))).collect()] == [False, True, True, True]
    xy = np.array([(p["x"], p["y"]) for p in notched])
    assert G.inside_length(np.array([[-5.0, 8.0], [15.0, 8.0]]), xy) == pytest.approx(4.0)
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    assert G.overlap(square, square + 1) == pytest.approx(9.0) and G.overlap(square, square + 9) == 0
    assert one(df.limit(1).select(G.ring_area(F.col("ring")))) == pytest.approx(75.0)


def test_overlap_of_any_rings():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float)
    notched = np.array([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)], float)
    for a, b in ((square, notched), (notched, square), (square[::-1], notched), (square, notched[::-1]), (notched, notched)):
        assert G.overlap(a, b) == pytest.approx(75.0)
    rng = np.random.default_rng(5)
    gx, gy = (g.ravel() for g in np.meshgrid(*[(np.arange(240) + 0.5) / 10] * 2))

    def star(at):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(2, 8, 9)
        p = np.array([at + r * np.cos(angle), at + r * np.sin(angle)]).T
        return np.vstack([p, p[:1]])

    def inside(r):
        odd = np.zeros(len(gx), bool)
        for (ax, ay), (bx, by) in zip(r[:-1], r[1:], strict=True):
            odd ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
        return odd

    for _ in range(25):
        a, b = star(11), star(13)
        want = (inside(a) & inside(b)).sum() / 100
        assert G.overlap(a, b) == pytest.approx(want, abs=2.0) and G.overlap(b, a) == pytest.approx(G.overlap(a, b))


def test_polygons_with_holes_and_parts(spark):
    holed = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    parts = "MULTIPOLYGON (((0 0, 0 10, 10 10, 10 0, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 0, 30 0, 30 10, 20 10, 20 0)))"
    df = S.read_geometry(spark.createDataFrame([(1, holed), (2, parts), (3, None), (4, "POLYGON EMPTY")], "poly_id long, wkt string")).withColumnRenamed("points", "ring").cache()
    assert [r[0] for r in df.orderBy("poly_id").select(G.ring_area(F.col("ring"))).collect()] == [96.0, 196.0]
    assert [r[0]["x"] for r in df.orderBy("poly_id").select(G.centroid(F.col("ring"))).collect()] == pytest.approx([5.0, (96 * 5 + 100 * 25) / 196])
    # The centre and a place on the hole's border; places on the sides that join the rings, in and between the parts.
    at = {(5.0, 5.0): (False, False), (4.0, 5.0): (True, True), (2.0, 2.0): (True, True), (15.0, 0.0): (False, False), (5.0, 0.0): (True, True), (25.0, 5.0): (False, True), (20.0, 0.0): (False, True)}
    for (x, y), want in at.items():
        assert tuple(r[0] for r in df.orderBy("poly_id").select(G.in_polygon(F.col("ring"), F.lit(x), F.lit(y))).collect()) == want, (x, y)
    rows = {r.poly_id: np.array([(p.x, p.y) for p in r.ring]) for r in df.collect()}
    line, clip = np.array([(-5.0, 5.0), (35.0, 5.0)]), np.array([(5, 0), (25, 0), (25, 10), (5, 10), (5, 0)], float)
    assert [G.inside_length(line, rows[k]) for k in (1, 2)] == pytest.approx([8.0, 18.0])
    assert [G.overlap(rows[k], clip) for k in (1, 2)] == pytest.approx([48.0, 98.0]) == [G.overlap(clip, rows[k]) for k in (1, 2)]
    assert G.overlap(rows[1], rows[2]) == pytest.approx(96.0)
    assert [len(r[0]) for r in df.orderBy("poly_id").select(G.outlines(F.col("ring"))).collect()] == [2, 3]


def test_nearest_polygon_is_by_border(spark):
    rings = [(1, ring((0, 0), (100, 0), (100, 100), (0, 100))), (2, ring((112, 45), (114, 45), (114, 47), (112, 47)))]
    polygons = spark.createDataFrame(rings, "poly_id long, ring array<struct<x double, y double>>")
    points = spark.createDataFrame([(1, 104.0, 46.0), (2, 111.0, 46.0), (3, 50.0, 50.0), (4, None, 1.0), (5, -900.0, 0.0)], "point_id long, x double, y double")
    assert dict(map(tuple, spatial.containing_or_nearest(points, polygons, 10.0).collect())) == {1: 1, 2: 2, 3: 1, 5: 1}


def test_merging_and_cutting_lines():
    parts = [np.array([[0, 0], [1, 0]], float), np.array([[2, 0], [1, 0]], float), np.array([[5, 5], [6, 6]], float)]
    assert sorted(len(p) for p in G.merge_chain(parts)) == [2, 3]
    pieces = G.cut_at(np.array([[0, 0], [4, 0], [4, 4]], float), np.array([2.0, 6.0]))
    assert [len(p) for p in pieces] == [2, 3, 2] and pieces[1].tolist() == [[2, 0], [4, 0], [4, 2]]


def test_utm_of_the_central_meridian(spark):
    x, y = spark.range(1).select(G.to_utm(F.lit(-63.0), F.lit(0.0)).alias("p")).select("p.x", "p.y").first()
    assert (x, y) == pytest.approx((500000.0, 10000000.0))


def test_dijkstra_masks_and_ties(spark):
    edges = spark.createDataFrame([("a", "b", "e1", 1.0), ("b", "c", "e2", 1.0), ("a", "c", "e3", 2.0), ("c", "d", "e4", 1.0)], "from_node string, to_node string, edge_id string, cost double")
    g = routing.Graph.of(edges, "cost")
    a, d = g.index["a"], g.index["d"]
    assert g.path(g.tree(a), d) == ["e1", "e2", "e4"] or g.path(g.tree(a), d) == ["e3", "e4"]
    shut = frozenset(i for i, e in enumerate(g.ids.tolist()) if e == "e4")
    assert not math.isfinite(g.tree(a, shut)[0][d])
    pairs = spark.createDataFrame([("a", "d", 5.0), ("a", "zz", 1.0)], "origin_id string, destination_id string, tons double")
    paths = routing.shortest_paths(pairs, edges)
    got = {r.destination_id: r for r in paths.collect()}
    assert got["d"].cost == 3.0 and got["zz"].path is None and not got["zz"].reachable
    cut = routing.failures(spark.createDataFrame([("s1", "e4"), ("s2", "e3"), ("s2", "e2")], "scenario_id string, edge_id string"), paths.where("reachable"), edges)
    assert {r.scenario_id: r.no_access for r in cut.collect()} == {"s1": 1, "s2": 1}


def test_chain_merge_and_components(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 1.0), ("e2", "b", "c", 2.0), ("e3", "c", "d", 4.0), ("e4", "c", "e", 8.0)], "edge_id string, from_node string, to_node string, length double")
    got = {r.chain: (r.edges, r.length, r.ends) for r in network.merge_chains(edges, []).collect()}
    assert got == {"e1": (2, 3.0, ["a", "c"]), "e3": (1, 4.0, ["c", "d"]), "e4": (1, 8.0, ["c", "e"])}
    long = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(100, 101)], "a int, b int")
    comp = {r.node: r.component for r in network.connected_components(long, "a", "b").collect()}
    assert set(comp.values()) == {1, 100} and comp[12] == 1


def test_balance_with_negative_cells(spark):
    cells = spark.createDataFrame([("r1", "c1", 4.0), ("r1", "c2", -1.0), ("r2", "c1", 2.0), ("r2", "c2", 6.0)], "row string, col string, value double")
    rows = spark.createDataFrame([("r1", 4.0), ("r2", 9.0)], "row string, total double")
    cols = spark.createDataFrame([("c1", 7.0), ("c2", 6.0)], "col string, total double")
    got = {(r.row, r.col): r.value for r in macro.balance(cells, rows, cols, 1e-7).collect()}
    assert got["r1", "c1"] + got["r1", "c2"] == pytest.approx(4.0) and got["r2", "c1"] + got["r2", "c2"] == pytest.approx(9.0)
    assert got["r1", "c1"] + got["r2", "c1"] == pytest.approx(7.0) and got["r1", "c2"] < 0


def test_nearest_far_away_and_missing_regions(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 990.0, 990.0, "b")], "point_id int, x double, y double, region string")
    n = spark.createDataFrame([(7, 500.0, 500.0, "a"), (8, 3.0, 4.0, "a")], "node_id int, x double, y double, region string")
    got = {r.point_id: (r.node_id, r.distance) for r in spatial.nearest_node(p, n, 1.0).collect()}
    assert got == {1: (8, 5.0), 2: (7, pytest.approx(490 * math.sqrt(2)))}
    assert {r.point_id: r.node_id for r in spatial.nearest_node(p, n, 1.0, region="region").collect()} == {1: 8, 2: None}


def test_flow_total_is_tons_times_path_length(spark):
    paths = spark.createDataFrame([(["a", "b", "c"], 2.0), (["b"], 5.0), (None, 9.0)], "path array<string>, tons double")
    assert one(routing.edge_flows(paths, "path", ["tons"]).agg(F.sum("tons"))) == 2 * 3 + 5
    assert one(stats.differing_share(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), "a", "b")) == 50


def test_mismatch_report(spark):
    df = spark.createDataFrame([("a", "b", 10.0, 15.0), ("a", "b", 12.0, 30.0), ("a", "c", 10.0, 11.0)], "origin string, destination string, kms double, routed_km double")
    assert [tuple(r) for r in od.mismatch_report(df).collect()] == [("a", "b", 10.0, 15.0)]


def test_closest_candidates_tries_all_pairs(spark):
    edges = spark.createDataFrame([(1, 1, 9, 8.0), (2, 2, 9, 7.0), (3, 3, 9, 1.0), (4, 3, 150, 2.0)], "edge_id long, from_node long, to_node long, cost double")
    stations = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)], "place string, origin_id long")
    records = spark.createDataFrame([(1, "a", 10.0, 9), (2, "a", 2.0, 150), (3, "b", 9.0, 9), (3, "b", 9.0, 150), (4, "b", 9.0, 77)], "record long, place string, kms double, destination_id long")
    got = {r.record: (r.origin_id, r.destination_id, r.routed_km, r.mismatch) for r in routing.closest_candidates(records, stations, edges, "record").collect()}
    assert got == {1: (3, 9, 1.0, True), 2: (3, 150, 2.0, False), 3: (2, 9, 7.0, True)}


def test_relaxation_ends_only_when_no_cost_falls(spark):
    chain = [(i, i + 1, 1.0) for i in range(14)] + [(0, 14, 20.0)]
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(chain)], "edge_id long, from_node long, to_node long, cost double")
    origin = spark.createDataFrame([(0,)], "origin_id long")
    with pytest.raises(RuntimeError):
        routing.relaxed_costs(origin, edges, most_rounds=5).collect()
    assert {r.node: r.cost for r in routing.relaxed_costs(origin, edges).collect()} == {i: float(i) for i in range(15)}
    with pytest.raises(ValueError):
        routing.relaxed_costs(origin, edges.withColumn("cost", -F.col("cost")))


def test_balance_never_returns_an_unbalanced_table(spark):
    # One cell is missing, so that more than two rounds are needed.
    cells = spark.createDataFrame([("r1", "c1", 1.0), ("r2", "c1", 1.0), ("r2", "c2", 1.0)], "row string, col string, value double")
    rows = spark.createDataFrame([("r1", 1.0), ("r2", 1.2)], "row string, total double")
    cols = spark.createDataFrame([("c1", 1.2), ("c2", 1.0)], "col string, total double")
    with pytest.raises(RuntimeError):
        macro.balance(cells, rows, cols, 1e-6, most_rounds=2)
    sums = {r.row: r.t for r in macro.balance(cells, rows, cols, 1e-6).groupBy("row").agg(F.sum("value").alias("t")).collect()}
    assert sums == {"r1": pytest.approx(1.0, abs=1e-4), "r2": pytest.approx(1.2, abs=1e-4)}


def test_nearest_leaves_out_what_has_no_place_and_reaches_any_distance(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 9e5, 0.0)], "point_id long, x double, y double")
    nodes = spark.createDataFrame([(7, 3.0, 4.0), (8, None, None), (9, nan, 0.0)], "node_id long, x double, y double")
    assert sorted((r.point_id, r.node_id) for r in spatial.nearest_node(points, nodes, 1.0).collect()) == [(1, 7), (4, 7)]
    assert spatial.nearest_node(points, nodes.where("node_id > 7"), 1.0).count() == 0
    a = points.withColumn("r", F.lit("a"))
    by = spatial.nearest_node(a, nodes.withColumn("r", F.lit("a")), 1.0, region="r").collect()
    assert sorted((r.point_id, r.node_id) for r in by if r.node_id) == [(1, 7), (4, 7)] and len(by) == 4
    line = "array(named_struct('x', 10.0D, 'y', -5.0D), named_struct('x', 10.0D, 'y', 5.0D)) AS points"
    lines = spark.range(1).selectExpr("5L AS edge_id", line, "'n' AS name")
    got = {r.point_id: r.distance for r in spatial.nearest_line(points, lines, 1.0).collect()}
    assert got == {1: 10.0, 4: 9e5 - 10}
    assert spatial.nearest_line(points, lines, 1.0, 5.0).count() == 0 and spatial.nearest_line(points, lines.limit(0), 1.0).count() == 0
    named = points.withColumn("name", F.when(F.col("point_id") == 1, "n").otherwise("m"))
    assert [r.point_id for r in spatial.nearest_line(named, lines, 1.0, same="name").collect()] == [1]
