"""Geometry, spatial-join and network-building queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayrisk.functions import geometry as G
from wayrisk.operators import network, spatial
from wayrisk.queries.base import BOXES, DEPOTS, EDGES, PLACES, Tables, boxes, depots, places, query, road_edges


def squares(t: Tables):
    b = boxes(t)
    return b.select("poly_id", G.rectangle_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring"), "x0", "y0", "x1", "y1", "price")


def streets(t: Tables):
    """Depots joined to their successor by key, as lines of one segment."""
    d = depots(t)
    nxt = d.select((F.col("node_id") - 1).alias("node_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return d.join(nxt, "node_id").select(F.col("node_id").alias("edge_id"), F.array(G.point(F.col("x"), F.col("y")), G.point(F.col("x2"), F.col("y2"))).alias("points"), F.col("region"), F.concat(F.lit("r"), F.col("region")).alias("name"))


STREETS = DEPOTS + """, streets AS (SELECT a.node_id AS edge_id, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, a.region FROM depots a JOIN depots b ON b.node_id = a.node_id + 1)"""
NEAR = """CASE WHEN (xb - xa) * (xb - xa) + (yb - ya) * (yb - ya) > 0 THEN greatest(0, least(1, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / ((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)))) ELSE 0 END"""


@query(f"""WITH {STREETS} SELECT edge_id, round(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)), 6) AS length, round(xa, 1) AS xa, round(xb, 1) AS xb, round((xa + xb) / 2, 6) AS mid FROM streets""")
def g2_g6_lines(t: Tables):
    """Length, ends, rounding and the middle of lines."""
    n = G.line_length(F.col("points"))
    df = streets(t).withColumns({"n": n, "r": G.rounded(F.col("points"), 1), "m": G.interpolate(F.col("points"), n / 2)})
    e = G.endpoints(F.col("r"))
    return df.select("edge_id", F.round("n", 6).alias("length"), e[0]["x"].alias("xa"), e[1]["x"].alias("xb"), F.round("m.x", 6).alias("mid"))


@query()
def g1_geodesic(t: Tables):
    """G1: geodesic and great-circle km of streets taken as degrees/10."""
    lon = F.transform("points", lambda p: G.point(p["x"] / 10 - 60, p["y"] / 20 - 50))
    return streets(t).select("edge_id", G.geodesic_length_km(lon).alias("geodesic"), G.haversine_km(lon).alias("sphere"))


@query(f"""WITH {BOXES} SELECT poly_id, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy FROM boxes""")
def g12_areas(t: Tables):
    """Areas and centroids."""
    r = F.col("ring")
    return squares(t).select("poly_id", F.round(G.ring_area(r), 6).alias("area"), F.round(G.centroid(r)["x"], 4).alias("cx"), F.round(G.centroid(r)["y"], 4).alias("cy"))


@query(f"""WITH {PLACES} SELECT point_id, round(x / 100 - 64, 4)::DOUBLE AS lon, round(y / 100 - 40, 4)::DOUBLE AS lat FROM places""")
def g14_projection(t: Tables):
    """To UTM zone 20 south and back."""
    m = G.to_utm(F.col("x") / 100 - 64, F.col("y") / 100 - 40)
    df = places(t).withColumn("m", m).withColumn("b", G.from_utm(F.col("m.x"), F.col("m.y")))
    return df.select("point_id", F.round("b.x", 4).alias("lon"), F.round("b.y", 4).alias("lat"))


def raster(t: Tables):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    cells = t.lineitem.groupBy(F.floor(k / 100).alias("row"), (k % 100).alias("col")).agg(F.max("l_quantity").alias("q"))
    return cells.select(F.lit("a").alias("raster"), "row", "col", F.when(F.col("q") < 5, F.lit(float("nan"))).otherwise(F.col("q") - 10).alias("value"))


@query("""WITH c AS (SELECT (l_orderkey * 8 + l_linenumber) // 100 AS row, (l_orderkey * 8 + l_linenumber) % 100 AS col, CASE WHEN max(l_quantity) < 10 THEN 0 ELSE max(l_quantity) - 10 END AS v FROM lineitem GROUP BY 1, 2),
    b AS (SELECT row, col, CASE WHEN v < 15 THEN 'low' ELSE 'high' END AS band FROM c WHERE v >= 1), g AS (SELECT *, col - row_number() OVER (PARTITION BY band, row ORDER BY col) AS g FROM b)
    SELECT 'a' AS raster, band, row, min(col) AS first, max(col) AS last FROM g GROUP BY band, row, g""")
def g17_g19_w6_runs(t: Tables):
    """Raster cells cleaned, banded and joined to runs."""
    return G.row_runs(G.band_cells(G.clean_cells(raster(t)), [(1, 15, "low"), (15, 999, "high")]))


@query("""WITH c AS (SELECT (l_orderkey * 8 + l_linenumber) // 100 AS row, (l_orderkey * 8 + l_linenumber) % 100 AS col, CASE WHEN max(l_quantity) < 10 THEN 0 ELSE max(l_quantity) - 10 END AS v FROM lineitem GROUP BY 1, 2) SELECT count(*) AS cells FROM c WHERE v >= 1""")
def g17_rectangles(t: Tables):
    """Rectangles of equal runs; their cells add up."""
    r = G.rectangles(G.row_runs(G.band_cells(G.clean_cells(raster(t)), [(1, 15, "low"), (15, 999, "high")])))
    return r.agg(F.sum((F.col("bottom") - F.col("top") + 1) * (F.col("last") - F.col("first") + 1)).alias("cells"))


@query("""SELECT l_orderkey AS row, l_linenumber AS col, l_quantity AS value FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity = 7""")
def g18_colours(t: Tables):
    """Cells whose three bands match a colour."""
    c = t.lineitem.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value"), (F.col("l_returnflag") == "R").cast("int").alias("band1"), (F.col("l_linestatus") == "O").cast("int").alias("band2"), F.col("l_quantity").alias("band3"))
    return G.colour_cells(c, (1, 1, 7)).select("row", "col", "value")


@query(f"""WITH {PLACES}, {DEPOTS}, d AS (SELECT point_id, node_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM places p, depots q), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, node_id) AS k FROM d)
    SELECT point_id, node_id, round(d, 6) AS distance FROM k WHERE k = 1""")
def j12_nearest(t: Tables):
    """Nearest depot of each place."""
    return spatial.nearest_node(places(t), depots(t), 50.0).select("point_id", "node_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {PLACES}, {DEPOTS}, d AS (SELECT point_id, node_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM places p LEFT JOIN depots q ON p.region = q.region), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, node_id) AS k FROM d)
    SELECT point_id, node_id, round(d, 6) AS distance FROM k WHERE k = 1""")
def j13_nearest_in_region(t: Tables):
    """J13."""
    return spatial.nearest_node(places(t), depots(t), 50.0, region="region").select("point_id", "node_id", F.round("distance", 6).alias("distance"))


LINE_D = PLACES + ", " + STREETS + f""", q AS (SELECT point_id, edge_id, x, y, xa + {NEAR} * (xb - xa) AS px, ya + {NEAR} * (yb - ya) AS py FROM places, streets), ld AS (SELECT point_id, edge_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM q)"""


@query(f"""WITH {LINE_D}, k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, edge_id) AS k FROM ld) SELECT point_id, edge_id, round(d, 6) AS distance FROM k WHERE k = 1""")
def j14_nearest_line(t: Tables):
    """Nearest street of each place."""
    return spatial.nearest_line(places(t), streets(t), 50.0).select("point_id", "edge_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {LINE_D} SELECT point_id, edge_id, round(d, 6) AS distance FROM ld WHERE d <= 5""")
def j22_g13_within_reach(t: Tables):
    """Streets within a distance of each place."""
    return spatial.within_reach(places(t), streets(t), 50.0, 5.0).select("point_id", "edge_id", F.round("distance", 6).alias("distance"))


INSIDE = PLACES + ", " + BOXES + """, ins AS (SELECT point_id, poly_id FROM places JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""


@query(f"""WITH {INSIDE} SELECT point_id, poly_id FROM ins""")
def j21_g10_point_in_polygon(t: Tables):
    """Squares that hold each place."""
    return spatial.containing_polygon(places(t), squares(t), 50.0)


@query(f"""WITH {INSIDE} SELECT point_id, min(poly_id) AS poly_id FROM ins GROUP BY 1""")
def j16_containing_box(t: Tables):
    """J16."""
    return spatial.containing_box(places(t), squares(t), 50.0)


@query(f"""WITH {INSIDE} SELECT DISTINCT point_id FROM ins""")
def j20_points_hit(t: Tables):
    """Places that any square holds."""
    return spatial.points_hit(places(t), squares(t), 50.0).select("point_id")


@query(f"""WITH {INSIDE}, h AS (SELECT point_id, min(poly_id) AS poly_id FROM ins GROUP BY 1), d AS (SELECT point_id, poly_id, sqrt(greatest(x0 - x, x - x1, 0) ** 2 + greatest(y0 - y, y - y1, 0) ** 2) AS d FROM places, boxes WHERE point_id NOT IN (SELECT point_id FROM h)),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, poly_id) AS k FROM d) SELECT point_id, poly_id FROM h UNION ALL SELECT point_id, poly_id FROM k WHERE k = 1""")
def j15_containing_or_nearest(t: Tables):
    """The square that holds a place, else the nearest."""
    return spatial.containing_or_nearest(places(t), squares(t), 50.0)


@query(f"""WITH {BOXES}, {DEPOTS}, h AS (SELECT poly_id, min(node_id) AS node_id FROM boxes JOIN depots ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1),
    d AS (SELECT poly_id, node_id, sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2) AS d FROM boxes, depots WHERE poly_id NOT IN (SELECT poly_id FROM h)), k AS (SELECT *, row_number() OVER (PARTITION BY poly_id ORDER BY d, node_id) AS k FROM d)
    SELECT poly_id, node_id FROM h UNION ALL SELECT poly_id, node_id FROM k WHERE k = 1""")
def j18_first_inside_or_nearest(t: Tables):
    """The first depot in a square, else the nearest."""
    return spatial.first_inside_or_nearest(squares(t), depots(t), 50.0)


PROVINCES = """prov AS (SELECT n_nationkey AS pid, n_nationkey % 5 * 200.0 AS px0, n_nationkey // 5 * 200.0 AS py0 FROM nation)"""


def provinces(t: Tables):
    k = F.col("n_nationkey")
    x, y = (k % 5) * 200.0, F.floor(k / 5) * 200.0
    return t.nation.select(k.cast("long").alias("poly_id"), G.rectangle_ring(x, y, x + 200, y + 200).alias("ring"))


@query(f"""WITH {BOXES}, {PROVINCES} SELECT poly_id AS zone_id, min(pid)::BIGINT AS poly_id FROM boxes JOIN prov ON (x0 + x1) / 2 BETWEEN px0 AND px0 + 200 AND (y0 + y1) / 2 BETWEEN py0 AND py0 + 200 GROUP BY 1""")
def j17_zone_province(t: Tables):
    """The province that holds each zone's centroid."""
    return spatial.zones_to_provinces(squares(t).withColumnRenamed("poly_id", "zone_id"), provinces(t), 100.0)


@query(f"""WITH {STREETS}, {PROVINCES}, c AS (SELECT edge_id, pid, xa, ya, xb - xa AS dx, yb - ya AS dy, px0, py0 FROM streets, prov),
    r AS (SELECT edge_id, pid, dx, dy, greatest(0, least((px0 - xa) / dx, (px0 + 200 - xa) / dx), least((py0 - ya) / dy, (py0 + 200 - ya) / dy)) AS t0, least(1, greatest((px0 - xa) / dx, (px0 + 200 - xa) / dx), greatest((py0 - ya) / dy, (py0 + 200 - ya) / dy)) AS t1 FROM c WHERE dx <> 0 AND dy <> 0)
    SELECT edge_id, pid::BIGINT AS poly_id, round((t1 - t0) * sqrt(dx * dx + dy * dy), 4) AS length FROM r WHERE t1 - t0 > 1e-9""")
def j19_g11_line_clip(t: Tables):
    """Streets clipped to provinces."""
    hits = spatial.line_hits(streets(t), provinces(t), 100.0).where("length > 1e-6")
    return hits.select("edge_id", "poly_id", F.round("length", 4).alias("length"))


@query(f"""WITH {BOXES}, {PROVINCES}, o AS (SELECT pid, price * greatest(0, least(x1, px0 + 200) - greatest(x0, px0)) * greatest(0, least(y1, py0 + 200) - greatest(y0, py0)) / ((x1 - x0) * (y1 - y0)) AS v FROM boxes, prov WHERE x0 <= px0 + 200 AND px0 <= x1 AND y0 <= py0 + 200 AND py0 <= y1)
    SELECT pid::BIGINT AS dst_id, round(sum(v), 3) AS price FROM o GROUP BY 1""")
def j23_g12_area_transfer(t: Tables):
    """Values of squares dealt to provinces by area."""
    out = spatial.area_transfer(squares(t).withColumnRenamed("poly_id", "src_id"), provinces(t).withColumnRenamed("poly_id", "dst_id"), "price", 100.0)
    return out.select("dst_id", F.round("price", 3).alias("price"))


@query(f"""WITH {BOXES}, {PROVINCES}, o AS (SELECT pid, price * greatest(0, least(x1, px0 + 200) - greatest(x0, px0)) * greatest(0, least(y1, py0 + 200) - greatest(y0, py0)) / ((x1 - x0) * (y1 - y0)) AS v FROM boxes, prov WHERE poly_id % 5 = pid % 5 AND x0 <= px0 + 200 AND px0 <= x1 AND y0 <= py0 + 200 AND py0 <= y1)
    SELECT pid::BIGINT AS dst_id, round(sum(v), 3) AS price FROM o GROUP BY 1""")
def j24_area_transfer_in_region(t: Tables):
    """The same within a common region."""
    src = squares(t).withColumnRenamed("poly_id", "src_id").withColumn("region", F.col("src_id") % 5)
    dst = provinces(t).withColumnRenamed("poly_id", "dst_id").withColumn("region", F.col("dst_id") % 5)
    return spatial.area_transfer(src, dst, "price", 100.0, "region").select("dst_id", F.round("price", 3).alias("price"))


@query("""SELECT 'node_' || (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) AS node_id, c_custkey AS k FROM customer""")
def n1_ids(t: Tables):
    """Ascending ids in a stable order."""
    return network.with_ids(t.customer.select(F.col("c_custkey").alias("k"), "c_acctbal"), "node_id", "node", 4, "c_acctbal", "k").select("node_id", "k")


@query(f"""WITH {STREETS} SELECT edge_id, edge_id AS from_node, edge_id + 1 AS to_node FROM streets""")
def n2_topology(t: Tables):
    """End nodes of each street."""
    return network.topology(streets(t), depots(t), 50.0).select("edge_id", "from_node", "to_node")


@query()
def n3_n4_n5_snap_split_link(t: Tables):
    """Places snapped to streets, streets split at them, and links from places to streets."""
    nodes = places(t).select(F.col("point_id").alias("node_id"), "x", "y")
    near = network.snapped(nodes, streets(t), 50.0, 2.0)
    pieces = network.split_at_nodes(streets(t), near, 50.0, 1e-6).groupBy("edge_id").agg(F.count("*").alias("n"), F.round(F.sum(G.line_length(F.col("points"))), 6).alias("length"))
    near = spatial.within_reach(nodes.withColumnRenamed("node_id", "point_id"), streets(t), 50.0, 2.0)
    links = near.groupBy("edge_id").agg(F.count("*").alias("links"))
    return pieces.join(links, "edge_id", "left").fillna(0, subset=["links"])


HITS = STREETS + """, m AS (SELECT point_id, x, y, edge_id, xa, ya, xb, yb, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS n, """ + NEAR + """ AS t FROM places, streets),
    h AS (SELECT *, xa + t * (xb - xa) AS px, ya + t * (yb - ya) AS py, t * n AS along FROM m), hits AS MATERIALIZED (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM h)"""


@query(f"""WITH {PLACES}, {HITS}, b AS (SELECT point_id, arg_min(px, (d, edge_id)) AS px, arg_min(py, (d, edge_id)) AS py FROM hits WHERE d <= 2 GROUP BY 1)
    SELECT p.point_id AS node_id, round(coalesce(px, p.x), 6) AS x, round(coalesce(py, p.y), 6) AS y FROM places p LEFT JOIN b ON p.point_id = b.point_id""")
def n3_snapped(t: Tables):
    """Places moved to the nearest street within 2."""
    nodes = places(t).select(F.col("point_id").alias("node_id"), "x", "y")
    return network.snapped(nodes, streets(t), 50.0, 2.0).select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {PLACES}, {HITS}, c AS (SELECT edge_id, round(along, 9) AS along, n FROM hits WHERE d <= 0.5 AND along > 1e-9 AND along < n - 1e-9 UNION SELECT edge_id, 0, n FROM hits UNION SELECT edge_id, round(n, 9), n FROM hits),
    q AS (SELECT edge_id, row_number() OVER w - 1 AS part, lead(along) OVER w - along AS length FROM c WINDOW w AS (PARTITION BY edge_id ORDER BY along)) SELECT edge_id, part::INTEGER AS part, round(length, 6) AS length FROM q WHERE length IS NOT NULL""")
def n4_split(t: Tables):
    """Streets cut where places lie within 0.5 of them."""
    nodes = places(t).select(F.col("point_id").alias("node_id"), "x", "y")
    return network.split_at_nodes(streets(t), nodes, 50.0, 0.5).select("edge_id", F.col("part").cast("int").alias("part"), F.round(G.line_length(F.col("points")), 6).alias("length"))


@query(f"""WITH {PLACES}, {HITS}, l AS (SELECT *, CASE WHEN along <= 1e-9 THEN 'd' || edge_id WHEN along >= n - 1e-9 THEN 'd' || (edge_id + 1) ELSE 'link_p' || point_id || '_' || edge_id END AS node FROM hits WHERE d <= 2 AND d > 1e-9),
    k AS (SELECT DISTINCT 'p' || point_id AS from_node, node AS to_node, min('link_p' || point_id || '_' || edge_id) OVER (PARTITION BY point_id, node) AS edge_id, d FROM l),
    s AS (SELECT edge_id, along, node FROM l WHERE node LIKE 'link%' UNION SELECT edge_id, along, 'p' || point_id FROM hits WHERE d <= 1e-9 AND along > 1e-9 AND along < n - 1e-9 UNION SELECT edge_id, 0, 'd' || edge_id FROM hits UNION SELECT edge_id, n, 'd' || (edge_id + 1) FROM hits),
    q AS (SELECT edge_id, row_number() OVER w AS part, count(*) OVER (PARTITION BY edge_id) AS c, node AS from_node, lead(node) OVER w AS to_node, lead(along) OVER w - along AS length FROM s WINDOW w AS (PARTITION BY edge_id ORDER BY along, node))
    SELECT CASE WHEN c = 2 THEN edge_id::VARCHAR ELSE edge_id || '_' || part END AS edge_id, from_node, to_node, round(length, 6) AS length FROM q WHERE to_node IS NOT NULL UNION ALL SELECT edge_id, from_node, to_node, round(min(d), 6) FROM k GROUP BY 1, 2, 3""")
def n5_linked(t: Tables):
    """Streets cut where links from places within 2 meet them, and the links."""
    nodes = places(t).select(F.concat(F.lit("p"), "point_id").alias("node_id"), "x", "y")
    lines = streets(t).select("edge_id", F.concat(F.lit("d"), "edge_id").alias("from_node"), F.concat(F.lit("d"), F.col("edge_id") + 1).alias("to_node"), "points")
    _, pieces, links = network.link_nodes(nodes, lines, 50.0, 2.0)
    return pieces.unionByName(links).select("edge_id", "from_node", "to_node", F.round(G.line_length(F.col("points")), 6).alias("length"))


@query(f"""WITH {STREETS}, c AS (SELECT p.edge_id AS a, q.edge_id AS b, (p.xb - p.xa) * (q.yb - q.ya) - (p.yb - p.ya) * (q.xb - q.xa) AS det, p.xa, p.ya, p.xb - p.xa AS dx, p.yb - p.ya AS dy, q.xa - p.xa AS wx, q.ya - p.ya AS wy, q.xb - q.xa AS ex, q.yb - q.ya AS ey FROM streets p JOIN streets q ON p.edge_id + 1 < q.edge_id),
    u AS (SELECT *, (wx * ey - wy * ex) / det AS u, (wx * dy - wy * dx) / det AS v FROM c WHERE abs(det) > 1e-9 * (abs(dx) + abs(dy)) * (abs(ex) + abs(ey))) SELECT a, b, round(xa + u * dx, 4) AS x, round(ya + u * dy, 4) AS y FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1""")
def n6_crossings(t: Tables):
    """Where streets that do not share an end cross."""
    return network.crossings(streets(t), 100.0).where("a + 1 < b").select("a", "b", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {EDGES} SELECT n AS node_id, count(*) AS degree FROM (SELECT from_node AS n FROM edges UNION ALL SELECT to_node FROM edges WHERE from_node <> to_node) GROUP BY 1""")
def n7_degrees(t: Tables):
    """N7."""
    return network.degrees(road_edges(t))


@query("""SELECT c_custkey AS node, coalesce((SELECT min(a.c_custkey) FROM customer a WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment), c_custkey) AS component FROM customer b
    WHERE (SELECT count(*) FROM customer a WHERE a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment) > 1""")
def n20_components(t: Tables):
    """Components of customers linked to the next of the same nation and segment."""
    from pyspark.sql import Window

    nxt = F.lead("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey"))
    pairs = t.customer.select(F.col("c_custkey").alias("a"), nxt.alias("b")).where("b is not null")
    return network.connected_components(pairs, "a", "b")


@query("""SELECT min(s_suppkey) AS chain, count(*) AS edges, sum(s_nationkey)::DOUBLE AS length, min_by(s_name, s_suppkey) AS name FROM supplier GROUP BY s_suppkey // 7""")
def n8_merge_chains(t: Tables):
    """Chains of up to seven suppliers' edges, whose inner nodes have degree 2."""
    k = F.col("s_suppkey")
    edges = t.supplier.select(k.alias("edge_id"), (k + F.floor(k / 7)).alias("from_node"), (k + F.floor(k / 7) + 1).alias("to_node"), F.col("s_nationkey").cast("double").alias("length"), F.col("s_name").alias("name"))
    return network.merge_chains(edges, ["name"]).select("chain", "edges", "length", "name")


@query("""WITH e AS (SELECT p_partkey AS k, p_brand, least(p_partkey % 97, p_partkey % 89) AS a, greatest(p_partkey % 97, p_partkey % 89) AS b FROM part) SELECT min(k) AS edge_id, p_brand AS name FROM e GROUP BY p_brand, a, b""")
def n9_distinct_links(t: Tables):
    """One edge for each name and unordered pair of ends."""
    k = F.col("p_partkey")
    edges = t.part.select(k.alias("edge_id"), F.col("p_brand").alias("name"), (k % 97).alias("from_node"), (k % 89).alias("to_node"))
    return network.distinct_links(edges, "name").select("edge_id", "name")


@query(f"""WITH {STREETS} SELECT edge_id, 'r' || region AS names FROM streets""")
def n9_merged_names(t: Tables):
    """Names of streets that lie on one another (here only on themselves)."""
    return network.merged_names(streets(t), 50.0, 1e-9).select("edge_id", "names")


@query(f"""WITH {LINE_D}, k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, edge_id) AS k FROM ld) SELECT p.point_id AS node_id, s.region::INTEGER AS region FROM places p LEFT JOIN k ON p.point_id = k.point_id AND k = 1 LEFT JOIN streets s ON k.edge_id = s.edge_id""")
def n10_class_of_nearest(t: Tables):
    """N10."""
    return network.class_of_nearest(places(t).select(F.col("point_id").alias("node_id"), "x", "y"), streets(t), 50.0, "region").select("node_id", "region")


@query(f"""WITH {PLACES}, {DEPOTS}, d AS (SELECT point_id, node_id, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM places p, depots q), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, node_id) AS k FROM d)
    SELECT point_id AS from_node, node_id AS to_node, 'road' AS from_mode, 'port' AS to_mode, round(d, 6) AS length, 0.0::DOUBLE AS min_gcost, 0.0::DOUBLE AS max_gcost FROM k WHERE k = 1 AND d < 40""")
def n11_modal_links(t: Tables):
    """N11."""
    out = network.modal_links(places(t).withColumnRenamed("point_id", "node_id"), depots(t), "road", "port", 50.0, 40.0)
    return out.withColumn("length", F.round("length", 6))


@query(f"""WITH {EDGES}, e AS (SELECT from_node AS n, brand FROM edges UNION SELECT to_node, brand FROM edges) SELECT n AS node_id, string_agg(brand, '/' ORDER BY brand) AS brand FROM e GROUP BY n""")
def n12_node_labels(t: Tables):
    """N12."""
    return network.node_labels(road_edges(t), ["brand"])


@query(f"""WITH {EDGES}, e AS (SELECT from_node AS n, length FROM edges UNION ALL SELECT to_node, length FROM edges WHERE from_node <> to_node) SELECT n AS node_id, s_name AS name, sum(length) AS length FROM e JOIN supplier ON n = s_suppkey GROUP BY 1, 2""")
def n26_throughput(t: Tables):
    """N26."""
    return network.node_throughput(road_edges(t), t.supplier.select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name")), "name", ["length"])


@query()
def n27_marker_ranges(t: Tables):
    """Km ranges of streets from places as markers."""
    markers = places(t).select(F.col("point_id").alias("marker_id"), "x", "y", F.col("point_id").cast("double").alias("reading"))
    return network.marker_ranges(streets(t), markers, 50.0, 5.0)


@query("""SELECT l_partkey AS id, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS l_tax, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1""")
def n28_n29_overlaps(t: Tables):
    """Length-weighted means and joined texts of overlapping pieces."""
    rows = t.lineitem.withColumnRenamed("l_partkey", "id")
    mean = network.weighted_mean(rows, "id", "l_tax", "l_quantity").withColumn("l_tax", F.round("l_tax", 9))
    return mean.join(network.joined_text(rows, "id", "l_returnflag"), "id")


@query()
def g15_shares(t: Tables):
    """How much of each square lies in the Voronoi cell of each depot."""
    return spatial.voronoi_shares(squares(t), depots(t), 50.0)


@query()
def g16_sub_lines(t: Tables):
    """The part of a street around its middle, with a vertex added there."""
    n = G.line_length(F.col("points"))
    m = G.interpolate(F.col("points"), n / 2)
    df = streets(t).withColumn("m", m).withColumn("points", G.add_vertex(F.col("points"), F.col("m.x"), F.col("m.y")))
    part = G.sub_line(F.col("points"), n / 2, F.lit(10.0))
    return df.select("edge_id", F.size("points").alias("vertices"), F.round(G.line_length(part), 6).alias("length"))
