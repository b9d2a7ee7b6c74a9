"""Line surgery, geodesics, overlaps, files and sweeps over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayrisk.functions import geometry as G
from wayrisk.operators import network, od, stats
from wayrisk.queries.base import PLACES, Tables, depots, places, query
from wayrisk.queries.hazards import COSTS, asset_costs
from wayrisk.queries.networks import HITS, STREETS, raster, streets
from wayrisk.sources import tables as S


def vincenty_sql(rounds: int = 12) -> str:
    """Table `km` (edge_id, km): inverse geodesic distances on WGS84 of `deg` (edge_id, lona, lata, lonb, latb)."""
    f, a = "(1 / 298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    out = f"v0 AS (SELECT edge_id, radians(lonb - lona) AS span, radians(lonb - lona) AS lam, atan((1 - {f}) * tan(radians(lata))) AS u, atan((1 - {f}) * tan(radians(latb))) AS w FROM deg)"
    terms = f"""sin(lam) AS sl, cos(lam) AS cl, sqrt(pow(cos(w) * sl, 2) + pow(cos(u) * sin(w) - sin(u) * cos(w) * cl, 2)) AS ss, sin(u) * sin(w) + cos(u) * cos(w) * cl AS cs, atan2(ss, cs) AS sigma,
        CASE WHEN ss > 0 THEN cos(u) * cos(w) * sl / ss ELSE 0 END AS sa, 1 - sa * sa AS c2, CASE WHEN c2 > 0 THEN cs - 2 * sin(u) * sin(w) / c2 ELSE 0 END AS cm"""
    for i in range(rounds):
        out += f""", v{i + 1} AS (SELECT edge_id, span, u, w, new AS lam FROM (SELECT edge_id, span, u, w, {terms}, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS c,
            span + (1 - c) * {f} * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS new FROM v{i}))"""
    return out + f""", km AS (SELECT edge_id, b * big * (sigma - part) / 1000 AS km FROM (SELECT edge_id, {terms}, {a} * (1 - {f}) AS b, c2 * (pow({a}, 2) - b * b) / (b * b) AS e2,
        1 + e2 / 16384 * (4096 + e2 * (-768 + e2 * (320 - 175 * e2))) AS big, e2 / 1024 * (256 + e2 * (-128 + e2 * (74 - 47 * e2))) AS small,
        small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))) AS part FROM v{rounds}))"""


@query(f"""WITH {STREETS}, deg AS (SELECT edge_id, xa / 10 - 60 AS lona, ya / 20 - 50 AS lata, xb / 10 - 60 AS lonb, yb / 20 - 50 AS latb FROM streets), {vincenty_sql()}
    SELECT deg.edge_id, round(km, 6) AS geodesic, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(latb - lata) / 2), 2) + cos(radians(lata)) * cos(radians(latb)) * pow(sin(radians(lonb - lona) / 2), 2)))), 6)::DOUBLE AS sphere FROM deg JOIN km ON deg.edge_id = km.edge_id""")
def g1_lengths(t: Tables):
    """G1: geodesic and great-circle km of streets taken as degrees."""
    lon = F.transform("points", lambda p: G.point(p["x"] / 10 - 60, p["y"] / 20 - 50))
    return streets(t).select("edge_id", F.round(G.geodesic_length_km(lon), 6).alias("geodesic"), F.round(G.haversine_km(lon), 6).alias("sphere"))


def halves(t: Tables):
    """Streets in two parts, the second one running backwards; every second street has a gap between them."""
    a, b = F.col("points")[0], F.col("points")[1]
    mid = G.point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    far = F.when(F.col("edge_id") % 2 == 0, 5.0).otherwise(0.0)
    return streets(t).select("edge_id", F.array(F.array(a, mid), F.array(b, G.point(mid["x"] + far, mid["y"]))).alias("parts"))


@query(f"""WITH {STREETS} SELECT edge_id, 0 AS part, round(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) / 2, 6) AS length FROM streets UNION ALL
    SELECT edge_id, 1, round(sqrt(pow(xb - (xa + xb) / 2 - CASE WHEN edge_id % 2 = 0 THEN 5 ELSE 0 END, 2) + pow((yb - ya) / 2, 2)), 6) FROM streets""")
def g5_parts(t: Tables):
    """A row for each part of a line of several parts."""
    return G.explode_parts(halves(t)).select("edge_id", "part", F.round(G.line_length(F.col("points")), 6).alias("length"))


@query(f"""WITH {STREETS} SELECT edge_id, CASE WHEN edge_id % 2 = 0 THEN 2 ELSE 1 END AS lines, CASE WHEN edge_id % 2 = 0 THEN 4 ELSE 3 END AS vertices,
    round(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) / 2 + sqrt(pow(xb - (xa + xb) / 2 - CASE WHEN edge_id % 2 = 0 THEN 5 ELSE 0 END, 2) + pow((yb - ya) / 2, 2)), 6) AS length FROM streets""")
def g9_merged_parts(t: Tables):
    """Parts that touch as one line; those with a gap stay two."""
    merged = halves(t).select("edge_id", G.merge_parts("parts").alias("m"))
    total = F.aggregate(F.transform("m", G.line_length), F.lit(0.0), lambda s, x: s + x)
    return merged.select("edge_id", F.size("m").alias("lines"), F.aggregate(F.transform("m", F.size), F.lit(0), lambda s, x: s + x).alias("vertices"), F.round(total, 6).alias("length"))


@query("""SELECT min(c_custkey) AS edge_id, (c_custkey % 37)::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer GROUP BY 2, 3""")
def g7_distinct_geometries(t: Tables):
    """Of lines with equal coordinates the one with the smallest id."""
    x, y = (F.col("c_custkey") % 37).cast("double"), F.col("c_nationkey").cast("double")
    lines = t.customer.select(F.col("c_custkey").alias("edge_id"), F.array(G.point(x, y), G.point(y, x)).alias("points"))
    return G.drop_same_geometry(lines, "points", "edge_id").select("edge_id", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))


@query(f"""WITH {STREETS} SELECT edge_id, 3 AS vertices, round(xa + (xb - xa) / 3, 6) AS x, round(ya + (yb - ya) / 3, 6) AS y FROM streets WHERE xa <> xb OR ya <> yb""")
def g8_added_vertex(t: Tables):
    """A vertex for a point beside the street, a third of the way along it."""
    a, b = F.col("points")[0], F.col("points")[1]
    x, y = a["x"] + (b["x"] - a["x"]) / 3 - (b["y"] - a["y"]) / 50, a["y"] + (b["y"] - a["y"]) / 3 + (b["x"] - a["x"]) / 50
    added = streets(t).select("edge_id", G.add_vertex(F.col("points"), x, y).alias("p"))
    return added.select("edge_id", F.size("p").alias("vertices"), F.round(F.col("p")[1]["x"], 6).alias("x"), F.round(F.col("p")[1]["y"], 6).alias("y"))


@query(f"""WITH {STREETS}, n AS (SELECT *, sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) AS n FROM streets), k AS (SELECT *, greatest(0, n / 4 - 40) AS lo, least(n, n / 4 + 40) AS hi FROM n WHERE n > 0)
    SELECT edge_id, round(hi - lo, 6) AS length, round(xa + lo / n * (xb - xa), 6) AS x0, round(xa + hi / n * (xb - xa), 6) AS x1 FROM k""")
def g16_bridges(t: Tables):
    """The 80 of a street around its first quarter, clamped to its ends."""
    part = G.sub_line(F.col("points"), G.line_length(F.col("points")) / 4, F.lit(80.0))
    cut = streets(t).where(G.line_length(F.col("points")) > 0).select("edge_id", part.alias("p"))
    return cut.select("edge_id", F.round(G.line_length(F.col("p")), 6).alias("length"), F.round(F.element_at("p", 1)["x"], 6).alias("x0"), F.round(F.element_at("p", -1)["x"], 6).alias("x1"))


@query("""WITH c AS (SELECT (l_orderkey * 8 + l_linenumber) // 100 AS row, (l_orderkey * 8 + l_linenumber) % 100 AS col, CASE WHEN max(l_quantity) < 10 THEN 0 ELSE max(l_quantity) - 10 END AS v FROM lineitem GROUP BY 1, 2),
    b AS (SELECT row, col, CASE WHEN v < 15 THEN 'low' ELSE 'high' END AS band FROM c WHERE v >= 1), g AS (SELECT *, col - row_number() OVER (PARTITION BY band, row ORDER BY col) AS g FROM b),
    r AS (SELECT band, row, min(col) AS first, max(col) AS last FROM g GROUP BY band, row, g), h AS (SELECT *, row - row_number() OVER (PARTITION BY band, first, last ORDER BY row) AS h FROM r)
    SELECT band, first, last, min(row) AS top, max(row) AS bottom FROM h GROUP BY band, first, last, h""")
def g17_rectangle_rows(t: Tables):
    """The rectangles themselves: equal runs of consecutive raster rows."""
    return G.rectangles(G.row_runs(G.band_cells(G.clean_cells(raster(t)), [(1, 15, "low"), (15, 999, "high")]))).select("band", "first", "last", "top", "bottom")


@query(f"""WITH {STREETS}, e AS (SELECT edge_id, 0 AS side, xa AS x, ya AS y FROM streets UNION ALL SELECT edge_id, 1, xb, yb FROM streets), n AS (SELECT * FROM depots WHERE node_id % 3 > 0),
    k AS (SELECT edge_id, side, arg_min(n.node_id, (sqrt((e.x - n.x) * (e.x - n.x) + (e.y - n.y) * (e.y - n.y)), n.node_id)) AS node FROM e, n GROUP BY 1, 2)
    SELECT edge_id, max(CASE WHEN side = 0 THEN node END) AS from_node, max(CASE WHEN side = 1 THEN node END) AS to_node FROM k GROUP BY 1""")
def n2_nearest_ends(t: Tables):
    """Ends on a node take it, the others (every third node is missing) the nearest one."""
    return network.topology(streets(t), depots(t).where("node_id % 3 > 0"), 50.0).select("edge_id", "from_node", "to_node")


@query(f"""WITH {STREETS} SELECT edge_id, CASE WHEN edge_id % 2 = 0 THEN 'p' || region || ',' ELSE '' END || 'r' || region AS names FROM streets""")
def n9_parallel_names(t: Tables):
    """Names of streets and of lines that run beside every second one of them, over a part of it."""
    a, b = F.col("points")[0], F.col("points")[1]
    third = lambda i: G.point(a["x"] + (b["x"] - a["x"]) * i / 3, a["y"] + (b["y"] - a["y"]) * i / 3 + 1e-4)
    own = streets(t).select("edge_id", "points", "name")
    beside = streets(t).where("edge_id % 2 = 0").select((-1 - F.col("edge_id")).alias("edge_id"), F.array(third(1), third(2)).alias("points"), F.concat(F.lit("p"), "region").alias("name"))
    return network.merged_names(own.unionByName(beside), 50.0, 1e-3).where("edge_id >= 0").select("edge_id", "names")


@query(f"""WITH {PLACES}, {HITS}, e AS (SELECT edge_id, n, arg_min(point_id, (along, point_id)) AS lo, min(along) AS la, arg_max(point_id, (along, point_id)) AS hi, max(along) AS ha FROM hits WHERE d <= 5 GROUP BY 1, 2),
    r AS (SELECT edge_id, lo - CASE WHEN hi >= lo THEN 1 ELSE -1 END * la / 1000 AS a, hi + CASE WHEN hi >= lo THEN 1 ELSE -1 END * (n - ha) / 1000 AS b FROM e)
    SELECT edge_id, round(CASE WHEN least(a, b) < 1e-3 THEN 0 ELSE least(a, b) END, 6)::DOUBLE AS prog_min, round(CASE WHEN greatest(a, b) < 1e-3 THEN 0 ELSE greatest(a, b) END, 6)::DOUBLE AS prog_max FROM r""")
def n27_ranges_of_places(t: Tables):
    """Km ranges of streets from the places within 5 of them."""
    markers = places(t).select(F.col("point_id").alias("marker_id"), "x", "y", F.col("point_id").cast("double").alias("reading"))
    out = network.marker_ranges(streets(t), markers, 50.0, 5.0)
    return out.select("edge_id", F.round("prog_min", 6).alias("prog_min"), F.round("prog_max", 6).alias("prog_max"))


@query("""SELECT l_suppkey AS origin, l_partkey % 50 AS destination, min(l_quantity) AS kms, min(l_extendedprice / 1024) AS routed_km FROM lineitem WHERE abs(l_extendedprice / 1024 - l_quantity) > 0.2 * l_quantity GROUP BY 1, 2""")
def a28_mismatches(t: Tables):
    """Station pairs whose routed distance is off the reported one."""
    return od.mismatch_report(t.lineitem.select(F.col("l_suppkey").alias("origin"), (F.col("l_partkey") % 50).alias("destination"), F.col("l_quantity").alias("kms"), (F.col("l_extendedprice") / 1024).alias("routed_km")))


@query("""SELECT l_returnflag AS mode, l_linenumber::INTEGER AS duration, l_suppkey AS edge_id, sum(l_quantity) AS tons FROM lineitem GROUP BY 1, 2, 3""")
def s2_s7_sweep(t: Tables):
    """Results written as one data set whose folders carry mode and duration, and read back as one table."""
    path = S.shared_path(t.spark, "sweep")
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("duration"), F.col("l_suppkey").alias("edge_id")).agg(F.sum("l_quantity").alias("tons"))
    S.write_results(rows, path, ["mode", "duration"])
    return S.read_results(t.spark, path).select("mode", "duration", "edge_id", "tons")


@query("""SELECT p_partkey AS edge_id, 'é ' || p_name AS name, p_retailprice AS length FROM part""")
def s1_headed_csv(t: Tables):
    """A headed CSV with a byte-order mark and accented text."""
    path = S.shared_path(t.spark, "csv")
    t.part.select(F.col("p_partkey").alias("\ufeffedge_id"), F.concat(F.lit("é "), "p_name").alias("name"), F.col("p_retailprice").alias("length")).write.csv(path, header=True, encoding="UTF-8")
    return S.read_csv(t.spark, path, "edge_id long, name string, length double")


@query("""SELECT l_partkey AS edge_id, l_quantity AS exposed, (l_linenumber * 10)::INTEGER AS return_period, (l_suppkey % 3) || 'm' AS min_depth, (l_suppkey % 3 + 1) || 'm' AS max_depth FROM lineitem""")
def s4_hazard_files(t: Tables):
    """Scenario attributes of hazard hits from the names of the files that hold them."""
    path, k = S.shared_path(t.spark, "hazards"), F.col("l_suppkey") % 3
    name = F.concat(F.lit("FU_1in"), F.col("l_linenumber") * 10, F.lit("_"), k, F.lit("m-"), k + 1, F.lit("m.csv"))
    S.write_results(t.lineitem.select(F.col("l_partkey").alias("edge_id"), F.col("l_quantity").alias("exposed"), name.alias("file")), path, ["file"], as_csv=True)
    return S.read_hazards(t.spark, path, "edge_id long, exposed double")


@query(f"""WITH {COSTS}, g AS (SELECT unnest(range(30)) * 0.002 AS growth), gd AS (SELECT growth, sum(pow(1 + growth, k) / pow(1.12, k)) AS gr FROM g, y GROUP BY 1), du AS (SELECT unnest(range(1, 11)) * 10 AS duration),
    r AS (SELECT id, exposed, duration, growth, (plain * price * 1000 + price * 1 * duration * gr) / total AS lo, (plain * price * 1000 + price * 3 * duration * gr) / total AS hi FROM co, gd, du)
    SELECT duration::INTEGER AS duration, round(growth, 4)::DOUBLE AS growth, sum((hi > 1)::BIGINT)::BIGINT AS max_over, sum((lo > 1)::BIGINT)::BIGINT AS min_over, round(sum(lo), 3)::DOUBLE AS ratios FROM r GROUP BY 1, 2""")
def p32_whole_grid(t: Tables):
    """The whole grid of 10 durations and 30 growth rates over all assets."""
    assets = asset_costs(t).select("id", (F.col("price") * 1000).alias("ead"), F.col("price").alias("min_eael_per_day"), (3 * F.col("price")).alias("max_eael_per_day"), F.col("c.total").alias("total"))
    out = stats.sweep(assets, [10 * k for k in range(1, 11)], [k * 0.002 for k in range(30)], 0.12, 2016, 2051)
    over = lambda c: F.sum((F.col(c) > 1).cast("long"))
    return out.groupBy("duration", "growth").agg(over("max_bc_ratio").alias("max_over"), over("min_bc_ratio").alias("min_over"), F.round(F.sum("min_bc_ratio"), 3).alias("ratios")).withColumn("growth", F.round("growth", 4))
