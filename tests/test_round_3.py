"""Work that must not be held in one place, and results that must not depend on it."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayrisk.functions import geometry as G
from wayrisk.operators import joins, lookup, network, od, routing, spatial, stats


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_index_of_texts_is_broadcast(spark, tmp_path, monkeypatch):
    """a small file of texts explodes to many grams; neither these nor the texts or results go through the driver."""
    spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("text "), "id").alias("line")).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    rules = spark.createDataFrame([(1, "t 19", 5.0), (2, "99", 7.0), (3, "", 9.0)], "seq int, line string, cost double")
    want = {k: 5.0 if str(k).startswith("19") else 7.0 if "99" in str(k) else 9.0 for k in range(2000)}
    for most in (lookup.MOST_SENT, 0):
        monkeypatch.setattr(lookup, "MOST_SENT", most)
        out = lookup.first_contained(t, "k", "line", rules, "line", ["cost"])
        assert {r.k: r.cost for r in out.collect()} == want
        assert "SortMergeJoin" in plan_of(out)


def test_boxes_count_points_without_their_pairs(spark):
    """3,000 points in each of 2,000 boxes are counted, not paired."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 60, (2, 3000)) / 2
    x0, y0 = rng.integers(-4, 60, (2, 2000)) / 2
    w, h = rng.integers(0, 30, (2, 2000)) / 2
    want = [int(((x >= a) & (x <= a + c) & (y >= b) & (y <= b + d)).sum()) for a, b, c, d in zip(x0, y0, w, h, strict=True)]
    assert stats.count_in_boxes(x, y, x0, x0 + w, y0, y0 + h).tolist() == want
    assert stats.count_in_boxes(x[:0], y[:0], x0, x0 + w, y0, y0 + h).tolist() == [0] * 2000
    p = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    b = spark.createDataFrame(pd.DataFrame({"box_id": range(2000), "x0": x0, "x1": x0 + w, "y0": y0, "y1": y0 + h}))
    assert [r.n for r in stats.points_in_boxes(p, b, 7.0).orderBy("box_id").collect()] == want


def test_cells_fit_their_nodes(spark):
    """cells shrink with the nodes, so that no point meets most of them."""
    rng = np.random.default_rng(5)
    p, n = rng.uniform(0, 100, (200, 2)), rng.uniform(0, 100, (800, 2))
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(200), "x": p[:, 0], "y": p[:, 1]}))
    nodes = spark.createDataFrame(pd.DataFrame({"node_id": range(800), "x": n[:, 0], "y": n[:, 1]}))
    assert spatial._fitted(nodes, "x", "y", 100.0, []) < 10
    assert spatial._fitted(nodes.limit(0), "x", "y", 100.0, []) == 100.0
    d = np.hypot(*(p[:, None] - n[None]).transpose(2, 0, 1))
    assert {r.point_id: r.node_id for r in spatial.nearest_node(points, nodes, 100.0).collect()} == dict(enumerate(d.argmin(1)))


def test_lines_are_met_near_by(spark):
    """tiles and first distances follow points and lines."""
    rng = np.random.default_rng(6)
    p, a = rng.uniform(0, 100, (300, 2)), rng.uniform(0, 100, (100, 2, 2))
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(300), "x": p[:, 0], "y": p[:, 1]}))
    lines = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in s]) for i, s in enumerate(a)], "edge_id int, points array<struct<x:double,y:double>>")
    assert spatial._apart(points, 100.0) < 10 and spatial._between(spatial.segments_of(lines), 100.0) < 5
    v = a[:, 1] - a[:, 0]
    t = np.clip(((p[:, None] - a[:, 0]) * v).sum(2) / (v * v).sum(1), 0, 1)
    d = np.linalg.norm(p[:, None] - a[:, 0] - t[..., None] * v, axis=2)
    for reach in (None, 0.5, 0.0):
        want = {i: k for i, k in enumerate(d.argmin(1)) if reach is None or d[i, k] <= reach}
        assert {r.point_id: r.edge_id for r in spatial.nearest_line(points, lines, 100.0, reach).collect()} == want


def test_points_stop_at_their_first_polygon(spark):
    """Rectangles are told from other rings, and neither way loses a border."""
    rng = np.random.default_rng(7)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 20, (200, 2)))] + [(900, None, 1.0)]
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(0, 18, (2, 60)), *rng.integers(1, 5, (2, 60)), strict=True))]
    rings = [(i, [(a, b), (c, b), (c, d), (a, d), (a, b)]) for i, a, b, c, d in boxes] + [(-1, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)])]
    p = spark.createDataFrame(points, "point_id int, x double, y double")
    r = spark.createDataFrame(rings, "poly_id int, ring array<struct<x:double,y:double>>")
    pairs = {(i, k) for i, x, y in points[:-1] for k, a, b, c, d in boxes if a <= x <= c and b <= y <= d} | {(i, -1) for i, x, y in points[:-1] if x + y <= 4}
    first = {i: min(k for j, k in pairs if j == i) for i, _ in pairs}
    out = spatial.containing_polygon(p, r, 5.0)
    assert {tuple(x) for x in out.collect()} == pairs and "HashAggregate" not in plan_of(out)
    assert {x.point_id for x in spatial.points_hit(p, r, 5.0).collect()} == set(first)
    near = {x.point_id: x.poly_id for x in spatial.containing_or_nearest(p, r, 5.0).collect()}
    assert set(near) == set(range(200)) and {i: near[i] for i in first} == first
    squares = r.where("poly_id >= 0")
    assert {x.point_id: x.poly_id for x in spatial.containing_box(p, squares, 5.0).collect()} == {i: min(k for j, k in pairs if j == i and k >= 0) for i, k in pairs if k >= 0}


def test_equal_ranges_are_looked_up_once(spark):
    """300 equal ranges and 300 equal edges meet once, not 90,000 times."""
    edges = spark.createDataFrame([(i, ["a", "b"], 2.0, 3.0) for i in range(300)] + [(900, ["c"], 1.0, 2.0)], "edge_id int, road array<string>, lo double, hi double")
    table = spark.createDataFrame([(300 - i, "b" if i % 2 else "a", 0.0, 5.0, float(i)) for i in range(300)], "seq int, road string, s double, e double, w double")
    out = lookup.first_in_range(edges, table, "road", "lo", "hi", "s", "e", ["w"])
    assert {r.edge_id: r.w for r in out.collect()} == {i: 299.0 for i in range(300)} | {900: None}
    assert plan_of(out).count("HashAggregate") + plan_of(out).count("SortAggregate") >= 6


def test_costs_are_relaxed_without_a_shuffle_of_their_rows(spark, monkeypatch):
    """costs of all pairs come from tasks that hold some origins each; the joins give the same rows."""
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(1, 2000, 150) / 64, strict=True)] + [(70, 71, 1.0), (0, None, 1.0), (0, 72, None), (0, 73, float("nan")), (0, 1, float("inf"))]
    edges = spark.createDataFrame(rows, "from_node long, to_node long, cost double")
    origins = spark.createDataFrame([(i,) for i in [*range(60), 70, 99, None]], "origin_id long")
    got = routing.relaxed_costs(origins, edges)
    assert "Exchange hashpartitioning(origin_id#" not in plan_of(got).split("MapInPandas")[0] and "Join" not in plan_of(got)
    here = {tuple(r) for r in got.collect()}
    monkeypatch.setattr(routing, "MOST_EDGES", 0)
    there = {tuple(r) for r in routing.relaxed_costs(origins, edges).collect()}
    assert here == there and {(99, 99, 0.0), (None, None, 0.0), (70, 71, 1.0)} <= here and len(here) > 2000


def test_overlaps_of_a_batch_are_cut_at_once():
    """20,000 pairs of rings take a fraction of a second, with the areas that they have one by one."""
    rng, rings, clips = np.random.default_rng(5), [], []
    for k in range(20000):
        x, y, w, h = rng.integers(0, 8, 4).tolist()
        rings.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)][:: 1 if k % 2 else -1] if k % 9 else [(0, 0), (8, 1), (3, 3), (1, 8), (0, 0)])
        angles = np.sort(rng.uniform(0, 6.28, rng.integers(3, 9)))
        clip = [(4 + 4 * np.cos(t), 4 + 4 * np.sin(t)) for t in angles]
        clips.append((clip + clip[:1])[:: 1 if k % 3 else -1] if k % 11 else [(0, 0), (8, 0), (2, 2), (0, 8), (0, 0)])
    rings[5], clips[6], rings[7], clips[8] = [], [], [(1, 1), (2, 2), (1, 1)], [(0, 0), (0, 0)]
    flat = lambda lines: (np.array([p for r in lines for p in r], float).reshape(-1, 2), np.cumsum([0] + [len(r) for r in lines]))
    began = time.process_time()
    areas, right = G.convex_overlaps(flat(rings), flat(clips))
    assert time.process_time() - began < 3
    want = [G.overlap(np.array(r, float).reshape(-1, 2), np.array(c, float).reshape(-1, 2)) for r, c in zip(rings, clips, strict=True)]
    assert np.allclose(areas[right], np.array(want)[right], rtol=0, atol=1e-9)
    assert [k for k in np.flatnonzero(~right) if k % 11] == [] and (~right).sum() > 1500
    none = G.convex_overlaps(flat([]), flat([]))
    assert len(none[0]) == 0


def some_lines(spark, n: int, seed: int):
    """Lines of one to three segments between grid points, and their points."""
    rng = np.random.default_rng(seed)
    lines = [[(float(x), float(y)) for x, y in rng.integers(0, 40, (2 if k % 3 else rng.integers(3, 5), 2))] for k in range(n)]
    return lines, spark.createDataFrame([(k, p) for k, p in enumerate(lines)], "edge_id int, points array<struct<x:double,y:double>>")


def test_crossings_are_not_shuffled(spark):
    """a crossing is a row of its tile; none is lost at borders, and longer edges give equal points once."""
    lines, df = some_lines(spark, 60, 33)
    want = set()
    for i, p in enumerate(lines):
        for j in range(i + 1, len(lines)):
            for (ax, ay), (bx, by) in zip(p, p[1:]):
                for (cx, cy), (dx, dy) in zip(lines[j], lines[j][1:]):
                    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
                    if det:
                        u, v = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                        if 0 <= u <= 1 and 0 <= v <= 1:
                            want.add((i, j, ax + u * (bx - ax), ay + u * (by - ay)))
    out = network.crossings(df, 5.0)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 300
    assert "hashpartitioning(a#" not in plan_of(out)


def test_hits_of_single_segments_are_not_grouped(spark):
    """a line of one segment meets a point once, so only longer lines are grouped; both have the least distance."""
    lines, df = some_lines(spark, 50, 22)
    rng = np.random.default_rng(2)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 40, (60, 2)))]
    p = spark.createDataFrame(points, "point_id int, x double, y double")
    want = {}
    for i, x, y in points:
        for k, line in enumerate(lines):
            for a, b in zip(np.array(line), np.array(line)[1:]):
                v = b - a
                t = min(max(((np.array([x, y]) - a) @ v) / (v @ v), 0), 1) if v @ v else 0.0
                d = float(np.hypot(*(a + t * v - (x, y))))
                if d <= 3:
                    want[i, k] = min(d, want.get((i, k), 9.0))
    out = spatial.within_reach(p, df, 20.0, 3.0)
    got = {(r.point_id, r.edge_id): r.distance for r in out.collect()}
    assert out.count() == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    first, rest = plan_of(out).split("ShuffledHashJoin")[:2]  # the branch of single segments comes first
    assert "Union" in first and "Aggregate" not in first.split("Union")[1] and "ShuffledHashJoin" not in rest


def test_pieces_are_rows(spark):
    """stops of a line are not held in one array or worker; pieces and their ends are those of cut_at."""
    lines, df = some_lines(spark, 40, 20)
    rng = np.random.default_rng(20)
    nodes = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 40, (200, 2)))]
    n = spark.createDataFrame(nodes, "node_id int, x double, y double")
    near = spatial.within_reach(n.withColumnRenamed("node_id", "point_id"), df, 20.0, 1.0).collect()
    out = network.split_at_nodes(df, n, 20.0, 1.0)
    got = {(r.edge_id, r.part): [tuple(p) for p in r.points] for r in out.collect()}
    want = {}
    for k, line in enumerate(lines):
        stops = np.array([r.along for r in near if r.edge_id == k])
        for i, piece in enumerate(G.cut_at(np.array(line), stops)):
            want[k, i] = piece
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want) and len(want) > 200
    assert "Python" not in plan_of(out)
    assert all(got[k, 0][0] == line[0] and got[k, max(i for j, i in got if j == k)][-1] == line[-1] for k, line in enumerate(lines))


def test_ranges_look_from_the_ends(spark):
    """Markers in the middle of a long edge are not met, and the ranges are those of all markers."""
    lines, df = some_lines(spark, 40, 21)
    rng = np.random.default_rng(21)
    rows = [(k, float(x), float(y), float(k % 7)) for k, (x, y) in enumerate(rng.integers(0, 80, (150, 2)) / 2)]
    m = spark.createDataFrame(rows, "marker_id int, x double, y double, reading double")
    far = spark.createDataFrame([(99, [(0.0, 100.0), (500.0, 100.0)]), (98, [(0.0, None), (1.0, 1.0)])], df.schema)
    row = spark.createDataFrame([(1000 + k, 0.5 * k, 101.0, float(k)) for k in range(1, 990)], m.schema)
    edges, markers = df.unionByName(far), m.unionByName(row)
    near = spatial.within_reach(markers.withColumnRenamed("marker_id", "point_id"), edges, 20.0, 2.0).join(markers.select(F.col("marker_id").alias("point_id"), "reading"), "point_id").collect()
    size = {k: sum(np.hypot(*(np.array(q) - p)) for p, q in zip(np.array(line), line[1:])) for k, line in enumerate(lines)} | {99: 500.0}
    want = {}
    for k in {r.edge_id for r in near}:
        mine = sorted((r.along, r.reading) for r in near if r.edge_id == k)
        sign = 1 if mine[-1][1] >= mine[0][1] else -1
        a, b = mine[0][1] - sign * mine[0][0] / 1000, mine[-1][1] + sign * (size[k] - mine[-1][0]) / 1000
        want[k] = tuple(0.0 if x < 1e-3 else x for x in (min(a, b), max(a, b)))
    got = {r.edge_id: (r.prog_min, r.prog_max) for r in network.marker_ranges(edges, markers, 20.0, 2.0).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and len(want) > 30
    part = spatial.segments_of(far.where("edge_id = 99")).withColumn("_n", F.lit(500.0))
    assert network.markers_at_ends(row.withColumnRenamed("marker_id", "point_id"), part, 20.0, 2.0, 2.0).count() < 60


def test_cascades_are_found_for_classes(spark, monkeypatch):
    """Records with the same texts are looked up once; an id with several rows still takes one level."""
    records = spark.createDataFrame([(k, f"st {k % 4}", k % 2) for k in range(200)] + [(500, "st 1", 0), (500, "st 7", 9)], "record int, name string, line int")
    nodes = spark.createDataFrame([(10, "st 1", 1), (11, "st 12", 0), (12, "st 3", 0), (13, "st 13", 7)], "node int, name string, line int")
    sizes, own = [], lookup._cascade
    monkeypatch.setattr(lookup, "_cascade", lambda r, *a: sizes.append(r.count()) or own(r, *a))
    got = [tuple(r) for r in lookup.cascade(records, "record", nodes, [([("name", "name"), ("line", "line")], None), ([], ("name", "name", lookup.INSIDE))], "node").collect()]
    want = {(k, 10, 1) for k in range(200) if k % 4 == 1} | {(k, n, 2) for k in range(200) for n in (12, 13) if k % 4 == 3 and n == 12} | {(500, n, 2) for n in (10, 11, 13)}
    assert sorted(got) == sorted(want) and sizes == [6]


def test_pairs_of_one_key_are_made_in_all_tasks(spark, monkeypatch):
    """all rows under one key are dealt to tasks; a side too large to be sent is joined by its key."""
    a = spark.range(0, 40, 1, 1).select(F.col("id").alias("k"), F.lit(1).alias("n"), F.col("id").alias("x"))
    b = spark.range(30).select(F.col("id").alias("j"), F.lit(1).alias("n"), F.col("id").alias("y"))
    flows = spark.createDataFrame([(1, 2, 8.0), (2, 2, 0.0)], "origin_zone int, destination_zone int, tons double")
    o = spark.range(0, 9, 1, 1).select(F.lit(1).alias("zone"), F.col("id").alias("node_id"), F.lit(0.5).alias("share"))
    d = spark.range(0, 40, 1, 1).select(F.lit(2).alias("zone"), F.col("id").alias("node_id"), F.lit(0.25).alias("share"))
    for most in (joins.MOST_SENT, 3):
        monkeypatch.setattr(joins, "MOST_SENT", most)
        pairs = joins.link_pairs(a, b, ["n"], lambda p, q: p["x"] > q["y"]).select("k", "j")
        assert {tuple(r) for r in pairs.collect()} == {(k, j) for k in range(40) for j in range(30) if k > j}
        nodes = od.expand_to_nodes(flows, o, d).select("origin_id", "destination_id", "tons")
        assert {tuple(r) for r in nodes.collect()} == {(i, j, 1.0) for i in range(9) for j in range(40) if i != j}
        if most > 3:
            for out in (pairs, nodes):
                assert out.select(F.spark_partition_id()).distinct().count() == 2


def test_boxes_of_squares_are_plain_columns(spark):
    """rectangles are tested by their sides alone, rings only where they are no rectangles."""
    square = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]
    rings = [(1, square(0.0, 0.0, 4.0)), (2, square(2.0, 2.0, 4.0)), (3, [(0.0, 0.0), (6.0, 0.0), (0.0, 6.0), (0.0, 0.0)]), (4, None), (5, square(20.0, 20.0, 1.0))]
    polygons = spark.createDataFrame(rings, "poly_id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 5.0), (4, 0.0, 6.0), (5, float("nan"), 1.0), (6, 2.0, 2.0), (7, 9.0, 9.0)], "point_id long, x double, y double")
    out = spatial.containing_polygon(points, polygons, 50.0)
    joins_ = [line for line in plan_of(out).splitlines() if "ShuffledHashJoin" in line]
    assert len(joins_) == 2 and sum("ring" in line for line in joins_) == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (3, 2), (4, 3), (6, 1), (6, 2), (6, 3)]
    assert sorted(r.point_id for r in spatial.points_hit(points, polygons, 50.0).collect()) == [1, 2, 3, 4, 6]


def test_a_worker_holds_a_graph_as_arrays(spark):
    """no list or dictionary of all edges or nodes, and a heap of what may still be nearest only."""
    import heapq
    import pickle
    import tracemalloc

    rng = np.random.default_rng(8)
    ends, cost = rng.integers(0, 500, (40_000, 2)), rng.integers(1, 50, 40_000).astype(float)
    rows = pd.DataFrame({"edge_id": [f"e{i}" for i in range(40_000)], "from_node": [f"n{a}" for a in ends[:, 0]], "to_node": [f"n{b}" for b in ends[:, 1]], "cost": cost})
    g = pickle.loads(pickle.dumps(routing.Graph.of(spark.createDataFrame(rows), "cost")))
    assert (g.index["n17"], g.index.get("n500"), g.index.get("a much longer name"), "n3" in g.index) == (g.nodes.tolist().index("n17"), None, None, True)
    assert [g.ids[k] for k in g.number.of(["e5", "none", "e39999", "e400000"])] == ["e5", "e39999"]
    origins = [g.index[f"n{k}"] for k in range(60)]
    trees = [g.tree(o).cost for o in origins]
    tracemalloc.start()
    g.tree(origins[0])
    pushes, push = [], heapq.heappush
    heapq.heappush = lambda h, x: (pushes.append(1), push(h, x))
    try:
        near = g.nearest_two(origins)
    finally:
        heapq.heappush = push
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    assert len(pushes) < 10_000
    for v in range(0, 500, 7):
        assert near[v] == sorted((t[v], k) for k, t in enumerate(trees))[:2]


def test_links_are_not_written_before_they_are_final(spark, monkeypatch):
    """of many links only those to ends and shared places are held aside; the others go through one exchange, by edge."""
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 100, (400, 2))
    nodes = spark.createDataFrame([(f"p{i}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "node_id string, x double, y double")
    lines = [(k, f"d{k}", f"e{k}", [(0.0, 5.0 * k), (100.0, 5.0 * k)]) for k in range(20)]
    edges = spark.createDataFrame(lines, "edge_id long, from_node string, to_node string, points array<struct<x:double,y:double>>")
    held, write = [], type(nodes).checkpoint

    def counted(df, *a, **k):
        out = write(df, *a, **k)
        held.append(out.count())
        return out

    monkeypatch.setattr(type(nodes), "checkpoint", counted)
    new, pieces, links = network.link_nodes(nodes, edges, 50.0, 20.0)
    monkeypatch.undo()
    hits = sum(abs(y - 5.0 * k) <= 20 for _, y in xy for k in range(20))
    assert (new.count(), links.count(), pieces.count()) == (hits, hits, hits + 20)
    assert max(held) < hits / 4
