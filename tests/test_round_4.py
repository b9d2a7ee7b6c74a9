"""Work that must stay bounded on larger tables (findings of round 4)."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayrisk.operators import joins, od, routing, spatial
from wayrisk.queries import QUERIES


def some_graph(seed: int, nodes: int, edges: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    ends = rng.integers(0, nodes, (edges, 2))
    return pd.DataFrame({"edge_id": [f"e{i}" for i in range(edges)], "from_node": [f"n{a}" for a in ends[:, 0]], "to_node": [f"n{b}" for b in ends[:, 1]], "cost": rng.integers(0, 400, edges) / 64})


def test_an_arc_is_looked_at_about_once(spark):
    """costs of one origin do not go over all arcs round by round, and are those of Dijkstra's method."""
    k = np.arange(4000)
    chain = routing.Arcs(np.concatenate([k, k + 1]), np.concatenate([k + 1, k]), np.tile(1 + k % 3, 2).astype(float), 4001)
    began = time.process_time()
    assert chain.costs(0).tolist() == [0.0, *np.cumsum(1.0 + k % 3)]
    assert time.process_time() - began < 2
    g = routing.Graph.of(spark.createDataFrame(some_graph(1, 300, 1200)), "cost")
    node = np.repeat(np.arange(len(g.nodes)), np.diff(g.at))
    arcs = routing.Arcs(node, g.to, g.cost, len(g.nodes))
    for o in range(0, len(g.nodes), 17):
        assert arcs.costs(o).tolist() == g.tree(o).cost
    alone = routing.Arcs(np.array([0, 1]), np.array([1, 0]), np.zeros(2), 3)
    assert alone.costs(0).tolist() == [0.0, 0.0, np.inf] and alone.costs(2).tolist() == [np.inf, np.inf, 0.0]


def test_the_place_on_a_line_is_computed_once_a_pair(spark):
    """conditions on hits do not repeat the place's expression until the code is too long to be compiled."""
    points = spark.createDataFrame([(k, k / 8, k % 5 / 2) for k in range(50)], "point_id int, x double, y double")
    lines = spark.createDataFrame([(1, [(0.0, 1.0), (8.0, 1.0)]), (2, [(0.0, 0.0), (1.0, 1.0), (9.0, 0.0)])], "edge_id int, points array<struct<x:double,y:double>>")
    out = spatial.within_reach(points, lines, 4.0, 1.5).where("distance > 0.25 and along > 1 and px + py > 2")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("greatest(0.0, least(1.0"), plan.count("ShuffledHashJoin")) == (2, 2)
    hits = {(r.point_id, r.edge_id): (r.px, r.along) for r in out.where("edge_id = 1").collect()}
    assert hits == {(k, 1): (k / 8, k / 8) for k in range(50) if 0.25 < abs(k % 5 / 2 - 1) <= 1.5 and 1 < k / 8}


def test_a_graph_reaches_the_driver_as_numbers(spark, monkeypatch):
    """the graph of 6 GB stays below the bound, no row of it is a Python object on the driver, and trees and repairs grow in arrays."""
    assert routing.MOST_EDGES >= 7_500_000
    rows = some_graph(4, 400, 1500)
    rows.loc[3, "edge_id"], rows.loc[4, "from_node"] = "é", "n一 long"
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)
    g = routing.Graph.of(spark.createDataFrame(rows), "cost", ("cost",))
    assert g.ids.tolist() == sorted(rows.edge_id) and g.nodes.tolist() == sorted({*rows.from_node, *rows.to_node})
    assert g.index.find(["n1", "absent", "n一 long"]).tolist() == [g.nodes.tolist().index("n1"), -1, len(g.nodes) - 1]
    settled = []
    monkeypatch.setattr(routing.Graph, "_settle", lambda self, heap, *a, own=routing.Graph._settle: settled.append(len(heap)) or own(self, heap, *a))
    tree = g.tree(g.index["n7"])
    assert not settled
    far = max(range(len(g.nodes)), key=lambda v: tree.hops[v])
    assert tree.cost[far] == sum(g.sums["cost"][e] for e in tree.steps(far)) and tree.hops[far] == len(tree.steps(far)) > 4
    now = tree.without(frozenset(tree.steps(far)[-1:]))
    leaf = [v for v in range(len(g.nodes)) if tree.before[v] >= 0 and v not in tree.before][0]
    settled.clear()
    tree.without(frozenset([tree.by[leaf]]))
    assert not settled and now.cost[far] >= tree.cost[far]


def test_pairs_on_several_closed_edges_are_given_once_without_a_shuffle_of_their_own(spark):
    """the pairs that a scenario cuts are made distinct where they are rerouted."""
    edges = spark.createDataFrame([("e1", "a", "b", 1.0), ("e2", "b", "c", 1.0), ("e3", "a", "c", 9.0)], "edge_id string, from_node string, to_node string, cost double")
    paths = spark.createDataFrame([("a", "c", 2.0, ["e1", "e2"], 2.0), ("a", "b", 5.0, ["e1"], 1.0)], "origin_id string, destination_id string, tons double, path array<string>, cost double").checkpoint()
    scenarios = spark.createDataFrame([("s", "e1"), ("s", "e2"), ("t", "e2")], "scenario_id string, edge_id string")
    out = routing.failures(scenarios, paths, edges)
    assert sorted((r.scenario_id, r.destination_id, r.no_access, r.new_cost, r.tons) for r in out.collect()) == [("s", "b", 1, None, 5.0), ("s", "c", 0, 9.0, 2.0), ("t", "c", 0, 9.0, 2.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scenario_id#" not in plan or plan.count("first(") == 0


def test_a_task_makes_pairs_of_few_keys(spark):
    """F8: a task's pairs are those of a range of keys, so that files repeat the values of few keys."""
    a = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 5).alias("n"))
    b = spark.range(50).select(F.col("id").alias("j"), (F.col("id") % 5).alias("n"))
    out = joins.link_pairs(a, b, ["n"], lambda x, y: x["k"] > y["j"]).select("k", "j", F.spark_partition_id().alias("p")).collect()
    assert {(r.k, r.j) for r in out} == {(k, j) for k in range(600) for j in range(50) if k % 5 == j % 5 and k > j}
    low, high = ({r.k % 5 for r in out if r.p == p} for p in (0, 1))
    assert low and high and max(low) <= min(high)
    one = od.expand_to_nodes(spark.createDataFrame([(1, 2, 8.0)], "origin_zone int, destination_zone int, tons double"), spark.createDataFrame([(1, 7, 0.5)], "zone int, node_id long, share double"), spark.range(40).select(F.lit(2).alias("zone"), F.col("id").alias("node_id"), F.lit(0.25).alias("share")))
    assert one.select(F.spark_partition_id()).distinct().count() == 2


def test_zone_pairs_are_rounded_without_decimals(spark):
    """each of very many rows is rounded by arithmetic."""
    out = QUERIES["j25_w7_zone_expansion"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "round(" not in plan and "FLOOR" in plan.upper()


def test_shares_compute_an_area_once(spark):
    """the areas of pairs are computed once, and cells in more than one task however few bytes they have."""
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    polygons = spark.createDataFrame([(1, square(0.0, 0.0, 4.0)), (2, square(3.0, 3.0, 6.0))], "poly_id long, ring array<struct<x:double,y:double>>")
    nodes = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0), (3, 100.0, 100.0)], "node_id long, x double, y double")
    out = spatial.voronoi_shares(polygons, nodes, 5.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [overlap_area(") == 1
    assert "REPARTITION_BY_NUM" in plan.split("FlatMapGroupsInPandas")[1].split("Exchange ")[1].splitlines()[0]
    got = {(r.poly_id, r.node_id): r.share for r in out.collect()}
    assert got.keys() == {(1, 1), (1, 2), (2, 2)} and all(abs(got[k] - v) < 1e-9 for k, v in {(1, 1): 0.5, (1, 2): 0.5, (2, 2): 1.0}.items())
