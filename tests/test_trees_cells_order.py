"""Trees by joins and their repair, Voronoi cells, crossed tiles, range-ordered work and q-gram lookups against brute force."""

import bisect
import contextlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayrisk.functions import geometry as G
from wayrisk.operators import lookup, network, ordered, relaxation, routing, spatial

EDGES = "edge_id string, from_node string, to_node string, cost double, length double, mode string"


def graph(seed: int, n: int, m: int):
    """Costs of few values, so that many paths tie; a part is cut off; loops and parallel edges occur."""
    rng = random.Random(seed)
    rows = [(f"e{i:03}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", float(rng.choice([0, 1, 1, 2, 3])), float(rng.randrange(9)), rng.choice(["rail", "road"])) for i in range(m)]
    return rows + [("z1", "x1", "x2", 1.0, 1.0, "rail"), ("z2", "x2", "x3", 1.0, 1.0, "road")]


def brute_tree(rows, origin, closed=()):
    """(cost, hops, edge, node before) of each node, by relaxing until nothing falls."""
    arcs = [(u, v, e, c) for e, a, b, c, *_ in rows if e not in closed for u, v in ((a, b), (b, a))]
    best = {origin: (0.0, 0, "", "")}
    changed = True
    while changed:
        changed = False
        for u, v, e, c in arcs:
            if u in best:
                new = (best[u][0] + c, best[u][1] + 1, e, u)
                if v not in best or new < best[v]:
                    best[v], changed = new, True
    return best


def brute_path(tree, node):
    if node not in tree:
        return None
    out = []
    while tree[node][1]:
        out.append(tree[node][2])
        node = tree[node][3]
    return out[::-1]


def network_of(spark, rows):
    return spark.createDataFrame(rows, EDGES)


@pytest.mark.parametrize("bound", [2_000_000, 10])
def test_paths_equal_brute_force_by_both_engines(spark, monkeypatch, bound):
    monkeypatch.setattr(routing, "MOST_EDGES", bound)
    rows = graph(1, 25, 60)
    useless = [("q1", None, "n2", 0.0, 1.0, "r"), ("q2", "n1", "n2", None, 1.0, "r"), ("q3", "n1", "n2", math.nan, 1.0, "r"), (None, "n1", "n2", 0.0, 1.0, "r")]
    pairs = [(o, d, 1.0) for o in ("n1", "n2", "x1", "nowhere") for d in [f"n{i}" for i in range(25)] + ["x3", "nowhere"]]
    found = routing.shortest_paths(spark.createDataFrame(pairs, "origin_id string, destination_id string, tons double"), network_of(spark, rows + useless)).collect()
    assert len(found) == len(pairs)
    trees = {o: brute_tree(rows, o) for o in ("n1", "n2", "x1")}
    for r in found:
        want = brute_path(trees.get(r.origin_id, {}), r.destination_id)
        assert r.path == want and r.reachable == (want is not None)
        assert r.cost == (None if want is None else trees[r.origin_id][r.destination_id][0])


@pytest.mark.parametrize("bound", [2_000_000, 10])
def test_failures_equal_brute_force_by_both_engines(spark, monkeypatch, bound):
    rows = graph(2, 22, 30)
    edges = network_of(spark, rows)
    pairs = [(o, f"n{i}", float(i + 1)) for o in ("n0", "n5", "n9") for i in range(22)]
    paths = routing.shortest_paths(spark.createDataFrame(pairs, "origin_id string, destination_id string, tons double"), edges).where("reachable").checkpoint()
    paths = routing.with_path_sums(paths, edges, ["length"], ["origin_id", "destination_id"]).checkpoint()
    closed = {f"s{i:02}": {f"e{(7 * i + k) % 30:03}" for k in range(1 + i % 4)} for i in range(20)} | {"x": {"z1"}, "none": {"missing"}}
    scenarios = spark.createDataFrame([(s, e) for s, x in closed.items() for e in x], "scenario_id string, edge_id string")
    monkeypatch.setattr(routing, "MOST_EDGES", bound)
    got = {(r.scenario_id, r.origin_id, r.destination_id): r for r in routing.failures(scenarios, paths, edges, keep_paths=True, sums=("length",)).collect()}
    length = {r[0]: r[4] for r in rows}
    want = {}
    for s, shut in closed.items():
        for o in ("n0", "n5", "n9"):
            before, after = brute_tree(rows, o), brute_tree(rows, o, shut)
            for d in {d for _, d, _ in pairs}:
                old = brute_path(before, d)
                if old and set(old) & shut:
                    new = brute_path(after, d)
                    want[s, o, d] = (0, after[d][0], new, sum(length[e] for e in new)) if new is not None else (1, None, None, None)
    assert {k: (r.no_access, r.new_cost, r.new_path, r.new_length) for k, r in got.items()} == want
    assert any(x[0] for x in want.values()) and any(not x[0] for x in want.values())
    assert all(r.tons == int(r.destination_id[1:]) + 1 and r.old_length == sum(length[e] for e in brute_path(brute_tree(rows, r.origin_id), r.destination_id)) for r in got.values())


def test_repair_settles_only_what_hangs_below(spark):
    rows = [r for r in graph(3, 60, 150) if r[3] > 0]
    g = routing.Graph.of(network_of(spark, rows), "cost")
    tree = g.tree(g.index["n0"])
    below = defaultdict(int)
    for v in range(len(g.nodes)):
        for e in tree.steps(v):
            below[e] += 1
    for e in range(len(g.ids)):
        tree.settled = 0
        now = tree.without(frozenset([e]))
        want = brute_tree(rows, "n0", {g.ids[e]})
        assert tree.settled == below[e] < len(g.nodes) - 1
        for v, name in enumerate(g.nodes.tolist()):
            assert (now.cost[v] if math.isfinite(now.cost[v]) else None) == (want[name][0] if name in want else None)
            assert [g.ids[k] for k in now.steps(v)] == (brute_path(want, name) or [])
    assert sum(below.values()) < len(g.ids) * len(g.nodes) / 10


def test_relaxation_refuses_negative_costs_and_bounds(spark):
    edges = network_of(spark, graph(4, 9, 12))
    with pytest.raises(ValueError):
        relaxation.arcs_of(edges.withColumn("cost", F.lit(-1.0)), "cost")
    arcs = relaxation.arcs_of(edges, "cost")
    with pytest.raises(RuntimeError):
        relaxation.trees(spark.createDataFrame([("t", "x1")], "tree string, node string"), arcs, most_rounds=1)
    both = relaxation.trees(spark.createDataFrame([("t", "x1"), ("t", "x3")], "tree string, node string"), arcs)
    assert {r.node: r["at"].cost for r in both.collect()} == {"x1": 0.0, "x2": 1.0, "x3": 0.0}


@pytest.mark.parametrize("bound", [2_000_000, 10])
def test_nearest_stations_by_both_ways(spark, monkeypatch, bound):
    monkeypatch.setattr(routing, "MOST_EDGES", bound)
    rows = [r for r in graph(5, 30, 70) if r[3] > 0]
    stations = {"a": ["n1", "n2", "n3", "n4"], "b": ["n5"], "c": ["x1", "n6"], "d": ["nowhere"]}
    asked = [(p, f"n{i}") for p in stations for i in range(30)] + [("c", "x3"), ("b", "nowhere")]
    got = routing.nearest_stations(spark.createDataFrame([(p, o) for p, x in stations.items() for o in x], "place string, origin_id string"), spark.createDataFrame(asked, "place string, destination_id string"), network_of(spark, rows))
    trees = {o: brute_tree(rows, o) for x in stations.values() for o in x}
    want = {}
    for p, d in asked:
        best = [(trees[o][d][0], o) for o in stations[p] if o != d and d in trees[o] and o != "nowhere"]
        if best:
            want[p, d] = min(best)
    assert {(r.place, r.destination_id): (r.routed_km, r.origin_id) for r in got.collect()} == want


@pytest.mark.parametrize("bound", [2_000_000, 10])
def test_modal_failures_equal_brute_force(spark, monkeypatch, bound):
    rows = graph(6, 14, 60)
    own = [(m, e, a, b, c) for e, a, b, c, _, m in rows]
    links = [(f"l{i}", "rail", f"n{i}", "road", f"n{i}", 0.5) for i in range(0, 14, 3)]
    layers = routing.layered(spark.createDataFrame(own, "mode string, edge_id string, from_node string, to_node string, cost double"), spark.createDataFrame(links, "edge_id string, from_mode string, from_node string, to_mode string, to_node string, cost double")).checkpoint()
    flat = [(f"{m}:{e}", f"{m}:{a}", f"{m}:{b}", c, 0.0, m) for m, e, a, b, c in own] + [(f"link:{e}", f"{m}:{a}", f"{k}:{b}", c, 0.0, "link") for e, m, a, k, b, c in links]
    assert {(r.edge_id, r.from_node, r.to_node, r.cost, r["mode"]) for r in layers.collect()} == {(*r[:4], r[5]) for r in flat}
    rail = [r for r in flat if r[5] == "rail"]
    closed = {r[0]: {r[0]} for r in rail} | {"rail": {r[0] for r in flat if r[5] != "road"}}
    scenarios = spark.createDataFrame([(r[0], r[0]) for r in rail], "scenario_id string, edge_id string").unionByName(routing.mode_closures(layers).where("scenario_id = 'rail'"))
    pairs = [("rail:n0", f"rail:n{i}", 1.0 + i) for i in range(1, 14)]
    monkeypatch.setattr(routing, "MOST_EDGES", bound)
    got = routing.modal_failures(scenarios, spark.createDataFrame(pairs, "origin_id string, destination_id string, tons double"), layers, "rail")
    before, mode, want = brute_tree(rail, "rail:n0"), {r[0]: r[5] for r in flat}, {}
    for s, shut in closed.items():
        after = brute_tree(flat, "rail:n0", shut)
        for _, d, _ in pairs:
            old = brute_path(before, d)
            if old and set(old) & shut:
                new = brute_path(after, d)
                want[s, d] = (int(new is None), None if new is None else after[d][0], new, sorted({mode[e] for e in new or ()}), any(mode[e] != "rail" for e in new or ()))
    assert {(r.scenario_id, r.destination_id): (r.no_access, r.new_cost, r.new_path, r.modes, r.changed) for r in got.collect()} == want
    assert any(x[4] for x in want.values()) and any(x[0] for x in want.values())


# --- cells and tiles


def clipped(ring, own, others):
    for o in others:
        ring = G.nearer(ring, own, o) if len(ring) else ring
    return ring


@pytest.mark.parametrize("most", [256, 4])
def test_voronoi_shares_equal_half_planes_of_all_nodes(spark, most):
    rng = np.random.default_rng(most)
    xy = np.concatenate([rng.uniform(0, 100, (60, 2)), rng.uniform(40, 42, (50, 2)), [[300.0, 300.0]]])
    nodes = [(i, *map(float, p)) for i, p in enumerate(xy)] + [(900, *map(float, xy[3])), (901, math.nan, 1.0), (902, None, 2.0)]
    shapes = [[(38, 38), (60, 38), (60, 60), (38, 60)], [(0, 0), (100, 10), (50, 90)], [(200, 200), (230, 200), (230, 230), (200, 230)], [(39, 39), (45, 39), (45, 45), (42, 41), (39, 45)], [(10.25, 10.25), (10.5, 10.25), (10.5, 10.5), (10.25, 10.5)]]
    rings = [(i, [{"x": float(x), "y": float(y)} for x, y in s + s[:1]]) for i, s in enumerate(shapes)]
    got = defaultdict(dict)
    for r in spatial.voronoi_shares(spark.createDataFrame(rings, "poly_id int, ring array<struct<x:double,y:double>>"), spark.createDataFrame(nodes, "node_id int, x double, y double"), 25.0, most).collect():
        got[r.poly_id][r.node_id] = r.share
    box = np.array([(-1e3, -1e3), (2e3, -1e3), (2e3, 2e3), (-1e3, 2e3)])
    for i, s in enumerate(shapes):
        ring, want = np.array(s + s[:1], float), {}
        area = abs(G._signed_area(ring))
        for j, own in enumerate(xy):
            cell = clipped(box, own, np.delete(xy, j, 0))
            part = G.overlap(ring, np.vstack([cell, cell[:1]])) / area if len(cell) > 2 else 0.0
            if part > 1e-12:
                want[j] = part
        assert sum(got[i].values()) == pytest.approx(1, abs=1e-9)
        assert {k for k, v in got[i].items() if v > 1e-9} == {k for k, v in want.items() if v > 1e-9}
        assert all(got[i][k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if v > 1e-9)
    assert len(got[0]) > 16


def test_a_segment_gets_the_tiles_that_it_crosses(spark):
    rng = random.Random(0)
    segs = [(0, 0.0, 0.0, 1000.0, 1000.0), (1, 5.0, 5.0, 5.0, 5.0), (2, 0.0, 10.0, 1000.0, 10.0), (3, 70.0, 900.0, 70.0, -20.0)]
    segs += [(4 + i, *(rng.uniform(-200, 200) for _ in range(4))) for i in range(30)]
    df = spark.createDataFrame(segs, "k int, ax double, ay double, bx double, by double")
    for pad in (0.0, 7.0):
        got = defaultdict(set)
        for r in spatial.with_crossed_tiles(df, 50.0, pad).collect():
            assert (r.tx, r.ty) not in got[r.k]
            got[r.k].add((r.tx, r.ty))
        for k, ax, ay, bx, by in segs:
            for _ in range(200):
                t, a = rng.random(), rng.uniform(0, 2 * math.pi)
                x, y = ax + t * (bx - ax) + pad * math.cos(a), ay + t * (by - ay) + pad * math.sin(a)
                assert (math.floor(x / 50), math.floor(y / 50)) in got[k]
        assert len(got[0]) <= (66 if pad == 0 else 85) and len(got[2]) <= 46  # of 441 tiles in the box of the first


def point_to_line(x, y, pts):
    best, at = (math.inf, 0.0), 0.0
    for (ax, ay), (bx, by) in zip(pts[:-1], pts[1:], strict=True):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
        d = math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)
        if d < best[0]:
            best = (d, at + t * math.sqrt(n))
        at += math.sqrt(n)
    return best


def test_reach_and_links_of_bent_lines(spark):
    rng = random.Random(5)
    lines = {i: [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.choice([2, 3, 5]))] for i in range(12)}
    points = {i: (rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)}
    on = {100 + i: tuple((a + b) / 2 for a, b in zip(lines[i][0], lines[i][1], strict=True)) for i in range(3)}  # nodes on lines
    ends = {200 + i: lines[i][0] for i in range(12)} | {300 + i: lines[i][-1] for i in range(12)}
    every = points | on | ends
    edges = spark.createDataFrame([(i, str(200 + i), str(300 + i), [{"x": x, "y": y} for x, y in p], "r") for i, p in lines.items()], "edge_id int, from_node string, to_node string, points array<struct<x:double,y:double>>, road string")
    nodes = spark.createDataFrame([(i, *p) for i, p in every.items()], "node_id int, x double, y double")
    near = {(r.point_id, r.edge_id): (r.distance, r.along) for r in spatial.within_reach(nodes.withColumnRenamed("node_id", "point_id"), edges, 10.0, 6.0).collect()}
    want = {(p, e): point_to_line(*xy, pts) for p, xy in every.items() for e, pts in lines.items()}
    want = {k: v for k, v in want.items() if v[0] <= 6.0}
    assert near.keys() == want.keys() and all(near[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())

    new, pieces, links = network.link_nodes(nodes, edges, 10.0, 6.0)
    new, pieces, links = new.collect(), pieces.withColumn("n", G.line_length(F.col("points"))).collect(), links.withColumn("n", G.line_length(F.col("points"))).collect()
    size = {e: sum(math.dist(a, b) for a, b in zip(p[:-1], p[1:], strict=True)) for e, p in lines.items()}
    stops, want_links, at_ends = defaultdict(set), {}, 0
    for (p, e), (d, along) in want.items():
        inner = 1e-9 < along < size[e] - 1e-9
        if d > 1e-9:
            to = f"link_{p}_{e}" if inner else str((200 if along <= 1e-9 else 300) + e)
            at_ends += not inner
            want_links[str(p), to] = d
        else:
            to = str(p)
        if inner:
            stops[e].add((along, to))
    assert at_ends and {(r.from_node, r.to_node): pytest.approx(r.n) for r in links} == want_links and all(r.n > 1e-9 for r in links)
    assert {r.node_id for r in new} == {to for x in stops.values() for _, to in x if to.startswith("link")}
    got = defaultdict(set)
    for r in pieces:
        got[int(r.edge_id.split("_")[0])].add((r.from_node, r.to_node, round(r.n, 6)))
        assert r.road == "r"
    for e in lines:
        cuts = [(0.0, str(200 + e)), *sorted(stops[e]), (size[e], str(300 + e))]
        assert got[e] == {(a[1], b[1], round(b[0] - a[0], 6)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def test_line_surgery_of_nulls(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 0.0}], [1.0])], "k int, points array<struct<x:double,y:double>>, stops array<double>")
    got = {r.k: (r.p, r.m) for r in df.select("k", G.split_line("points", "stops").alias("p"), G.merge_parts(F.when(F.col("k") == 2, F.array("points"))).alias("m")).collect()}
    assert got[1] == (None, None) and len(got[2][0]) == 2 and len(got[2][1]) == 1


# --- order


@contextlib.contextmanager
def several_ranges(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.randrange(6), float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, part string, v int, x double")
    with several_ranges(spark, 7):
        out = ordered.running(df, ["part"], [F.desc("v"), F.col("id")], {"s": F.col("x")}, rank="r", total="n")
        got = {r.id: (r.r, r.s, r.n) for r in out.collect()}
        # The rows of the large part are in several ranges.
        assert ordered.in_ranges(df, F.struct("part"), F.desc("v"), F.col("id")).where("part = 'hot'").select("_p").distinct().count() > 3
    want = {}
    for p in {r[1] for r in rows}:
        own, s = sorted((r for r in rows if r[1] == p), key=lambda r: (-r[2], r[0])), 0.0
        for k, r in enumerate(own):
            s += r[3]
            want[r[0]] = (k + 1, s, len(own))
    assert got == want
    assert ordered.running(df.limit(0), ["part"], [F.col("id")]).count() == 0


@pytest.mark.parametrize("steps", [[(1.0, "a"), (2.0, "b"), (2.0, "c"), (5.5, "d"), (None, "n")], [], [(3.0, "only")]])
def test_as_of_equals_brute_force(spark, steps):
    rng = random.Random(len(steps))
    xs = [rng.choice([0.5, 1.0, 2.0, 2.0, 2.0, 3.0, 7.0, None]) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    table = spark.createDataFrame(steps, "at double, name string")
    order = sorted((a, n) for a, n in steps if a is not None)

    def want(x):
        k = bisect.bisect_right([a for a, _ in order], x) if x is not None else 0
        return order[k - 1][1] if k else None

    with several_ranges(spark, 5):
        got = {r.i: r.name for r in ordered.as_of(df, "x", table, "at", ["name"]).collect()}
    assert got == {i: want(x) for i, x in enumerate(xs)}
    assert {r.i: r.name for r in lookup.floor_lookup(df, "x", table, "at", ["name"]).collect()} == got


def test_nearest_k_equals_brute_force(spark):
    rng = random.Random(8)
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice("abc")) for i in range(50)] + [(99, None, 1.0, "a"), (98, 5.0, 5.0, "none")]
    nodes = [(i, float(rng.randrange(40)), float(rng.randrange(40)), rng.choice("ab")) for i in range(40)] + [(77, 900.0, 900.0, "c"), (78, math.nan, 0.0, "c")]
    p, n = spark.createDataFrame(points, "point_id int, x double, y double, r string"), spark.createDataFrame(nodes, "node_id int, x double, y double, r string")
    for region in ("r", None):
        want = {}
        for i, x, y, r in points:
            if x is not None:
                best = sorted((math.hypot(x - a, y - b), j) for j, a, b, s in nodes if not math.isnan(a) and (region is None or r == s))[:3]
                want |= {(i, k + 1): (j, pytest.approx(d)) for k, (d, j) in enumerate(best)}
        assert {(r.point_id, r.k): (r.node_id, r.distance) for r in spatial.nearest_k(p, n, 3, 4.0, region=region).collect()} == want


def test_contained_names_equal_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i, make(rng.randrange(12))) for i in range(120)] + [(500, None), (501, ""), (502, "aaaaaaaaaa")]
    names = [(i, make(rng.choice([1, 2, 3, 4, 6]))) for i in range(60)] + [(90, None), (91, "aaaa"), (92, "zzz")]
    t, n = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(names, "j int, n string")
    want = {(i, j) for i, a in texts for j, b in names if a is not None and b is not None and b in a}
    assert {tuple(r) for r in lookup.contained(t, "i", "t", n, "j", "n").collect()} == want
    assert {tuple(r) for r in lookup.contained(t, "i", "t", spark.createDataFrame([(1, "")], "j int, n string"), "j", "n").collect()} == {(i, 1) for i, a in texts if a is not None}
    assert lookup.contained(t, "i", "t", n.limit(0), "j", "n").count() == 0
    plan = lookup.contained(t, "i", "t", n, "j", "n")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
