"""Path, flow and failure queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayrisk.operators import joins, routing, stats
from wayrisk.queries.base import EDGES, Tables, path_table, query, road_edges

FLOWS = """f AS (SELECT l_suppkey AS edge_id, sum(tons) AS lo, sum(tons * CASE WHEN o % 2 = 0 THEN 0.5 ELSE 1.5 END)::DOUBLE AS hi FROM (SELECT l_suppkey, l_orderkey AS o, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS tons FROM lineitem) GROUP BY 1)"""


def flows(t: Tables):
    k = F.col("l_orderkey")
    paths = path_table(t).select(F.col("path").alias("min_edge_path"), F.col("path").alias("max_edge_path"), F.col("tons").alias("min_tons"), (F.col("tons") * F.when(k % 2 == 0, 0.5).otherwise(1.5)).alias("max_tons"))
    edges = t.supplier.select(F.col("s_suppkey").alias("edge_id"), F.col("s_nationkey").alias("mode"))
    return routing.min_max_edge_flows(paths, edges, ["tons"])


@query(f"""WITH {FLOWS} SELECT s_suppkey AS edge_id, s_nationkey AS mode, least(coalesce(lo, 0), coalesce(hi, 0))::DOUBLE AS min_tons, greatest(coalesce(lo, 0), coalesce(hi, 0))::DOUBLE AS max_tons FROM supplier LEFT JOIN f ON s_suppkey = edge_id""")
def n15_edge_flows(t: Tables):
    """Flows of all orders' paths summed on the suppliers that they run over."""
    return flows(t)


@query(f"""WITH {FLOWS}, a AS (SELECT s_suppkey AS edge_id, s_nationkey AS mode, least(coalesce(lo, 0), coalesce(hi, 0))::DOUBLE AS min_tons, greatest(coalesce(lo, 0), coalesce(hi, 0))::DOUBLE AS max_tons FROM supplier LEFT JOIN f ON s_suppkey = edge_id)
    SELECT *, row_number() OVER (PARTITION BY mode ORDER BY max_tons DESC, edge_id)::INTEGER AS rank FROM a""")
def flow_ranking(t: Tables):
    """Flagship: path table to edge flows to ranked flows of each mode."""
    return stats.ranked(flows(t), ["mode"], "max_tons", "edge_id")


@query("""SELECT l_suppkey AS edge_id, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1""")
def n16_paths_by_edge(t: Tables):
    """Number of paths over each edge, from the inverted index."""
    return routing.paths_by_edge(path_table(t), "path", ["l_orderkey"]).groupBy("edge_id").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT l_suppkey AS edge_id FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def n17_failure_set(t: Tables):
    """N17."""
    hits = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("edge_id"))
    return routing.failure_set(hits, t.supplier.select(F.col("s_suppkey").alias("edge_id"), "s_acctbal"), "s_acctbal")


def relaxed_sql(starts: str, rounds: int = 14) -> str:
    """Least costs from the suppliers that `starts` selects, by unrolled relaxation."""
    out = EDGES + """, arcs AS (SELECT a, b, min(cost) AS cost FROM (SELECT from_node AS a, to_node AS b, cost FROM edges UNION ALL SELECT to_node, from_node, cost FROM edges) GROUP BY 1, 2),
        d0 AS (SELECT o, o AS n, 0.0::DOUBLE AS c FROM (""" + starts + """))"""
    for i in range(rounds):
        out += f", d{i + 1} AS (SELECT o, n, min(c) AS c FROM (SELECT * FROM d{i} UNION ALL SELECT o, b, c + cost FROM d{i} JOIN arcs ON n = a) GROUP BY 1, 2)"
    return out + f", best AS (SELECT * FROM d{rounds})"


@query(f"WITH {relaxed_sql('SELECT s_suppkey AS o FROM supplier')} SELECT o AS origin_id, n AS node, round(c, 5) AS cost FROM best")
def n13_relaxed_costs(t: Tables):
    """N13 by joins: least costs from every supplier to all others."""
    # Costs are multiples of 2**-20, so this rounds them as round() does, without its decimals for each of the many rows.
    cost = F.floor(F.col("cost") * 100000 + 0.5) / 100000
    return routing.relaxed_costs(t.supplier.select(F.col("s_suppkey").alias("origin_id")), road_edges(t)).select("origin_id", "node", cost.alias("cost"))


def demand(t: Tables):
    """Tons between each nation's node (its first supplier) and the suppliers that its customers' lines name; a nation without suppliers has no node."""
    nodes = t.supplier.groupBy(F.col("s_nationkey").alias("zone")).agg(F.min("s_suppkey").alias("origin_id"))
    zones = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone")).join(nodes, "zone").select("o_custkey", "origin_id")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(zones, "o_custkey").select("l_orderkey", "origin_id")
    lines = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("destination_id"), "l_quantity").join(orders, "l_orderkey").where("origin_id <> destination_id")
    return lines.groupBy("origin_id", "destination_id").agg(F.sum("l_quantity").alias("tons"))


SUMS = ("length", "time")


def routed(t: Tables):
    edges = road_edges(t)
    return routing.with_path_sums(routing.shortest_paths(demand(t), edges).checkpoint(), edges, list(SUMS), ["origin_id", "destination_id"])


DEMAND = """SELECT z.o, l_suppkey AS d, sum(l_quantity) AS tons FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN (SELECT s_nationkey, min(s_suppkey) AS o FROM supplier GROUP BY 1) z ON c_nationkey = s_nationkey WHERE z.o <> l_suppkey GROUP BY 1, 2"""


@query(f"WITH {relaxed_sql('SELECT min(s_suppkey) AS o FROM supplier GROUP BY s_nationkey')} SELECT p.o AS origin_id, p.d AS destination_id, p.tons, round(c, 5) AS cost, c IS NOT NULL AS reachable FROM ({DEMAND}) p LEFT JOIN best ON best.o = p.o AND best.n = p.d")
def n13_shortest_paths(t: Tables):
    """N13 by Dijkstra in tasks: all pairs with demand."""
    return routing.shortest_paths(demand(t), road_edges(t)).select("origin_id", "destination_id", "tons", F.round("cost", 5).alias("cost"), "reachable")


def arcs_sql(name: str, edges: str, cost: str = "cost") -> str:
    """Both directions of all edges. Costs are multiples of 2**-20, so 2**-40 more for each edge makes the path with fewer edges win ties, exactly."""
    return f"{name} AS MATERIALIZED (SELECT edge_id::VARCHAR AS e, from_node AS a, to_node AS b, {cost} + 1 / 1099511627776.0::DOUBLE AS w FROM {edges} UNION ALL SELECT edge_id::VARCHAR, to_node, from_node, {cost} + 1 / 1099511627776.0::DOUBLE FROM {edges})"


def trees_sql(p: str, starts: str, arcs: str, shut: str | None = None, rounds: int = 14) -> str:
    """Tables `p` (s, o, n, c: the least cost from o to n under scenario s) and `p`_by (the edge and node before each node) for the (s, o) of `starts`; `shut` (s, e) names closed edges."""
    open_ = f"LEFT JOIN {shut} z ON z.s = x.s AND z.e = r.e WHERE z.s IS NULL" if shut else ""
    out = f"{p}0 AS MATERIALIZED (SELECT s, o, o AS n, 0.0::DOUBLE AS c FROM ({starts}))"
    for i in range(rounds):
        out += f", {p}{i + 1} AS MATERIALIZED (SELECT s, o, n, min(c) AS c FROM (SELECT * FROM {p}{i} UNION ALL SELECT x.s, x.o, r.b, x.c + r.w FROM {p}{i} x JOIN {arcs} r ON x.n = r.a {open_}) GROUP BY 1, 2, 3)"
    out += f", {p} AS (SELECT * FROM {p}{rounds})"
    return out + f", {p}_by AS MATERIALIZED (SELECT x.s, x.o, y.n, min(r.e) AS e, arg_min(r.a, r.e) AS u FROM {p} x JOIN {arcs} r ON x.n = r.a JOIN {p} y ON y.s = x.s AND y.o = x.o AND y.n = r.b AND y.c = x.c + r.w {open_} GROUP BY 1, 2, 3)"


def walk_sql(p: str, pairs: str) -> str:
    """`p`_path (s, o, d, path: edge ids in order) of those (s, o, d) of `pairs` that are reachable, by following the edges of `p`_by."""
    return f"""{p}_walk AS (SELECT s, o, d, d AS n, []::VARCHAR[] AS path FROM {pairs} UNION ALL SELECT w.s, w.o, w.d, b.u, list_concat([b.e], w.path) FROM {p}_walk w JOIN {p}_by b ON w.s = b.s AND w.o = b.o AND w.n = b.n),
        {p}_path AS MATERIALIZED (SELECT s, o, d, path FROM {p}_walk WHERE n = o)"""


def sums_sql(p: str) -> str:
    return f"{p}_sums AS MATERIALIZED (SELECT s, o, d, sum(length) AS length, sum(time) AS time FROM (SELECT s, o, d, unnest(path) AS e FROM {p}_path) JOIN edges ON e = edge_id::VARCHAR GROUP BY 1, 2, 3)"


def exact(c: str) -> str:
    """A cost without what arcs_sql has added."""
    return f"floor({c} * 1048576) / 1048576.0::DOUBLE"


BASE_PATHS = f"{EDGES}, {arcs_sql('arcs', 'edges')}, pairs AS MATERIALIZED (SELECT 0 AS s, o, d, tons FROM ({DEMAND})), {trees_sql('t', 'SELECT DISTINCT s, o FROM pairs', 'arcs')}, {walk_sql('t', 'pairs')}, {sums_sql('t')}"


def _side_sql(side: str, cost: str) -> str:
    p = side
    return f"{arcs_sql(p + '_arcs', '(SELECT *, ' + cost + ' AS g FROM edges)', 'g')}, {trees_sql(p, 'SELECT DISTINCT s, o FROM pairs', p + '_arcs')}, {walk_sql(p, 'pairs')}, {sums_sql(p)}"


@query(f"""WITH RECURSIVE {EDGES}, pairs AS MATERIALIZED (SELECT 0 AS s, o, d, tons FROM ({DEMAND})), {_side_sql("lo", "cost")}, {_side_sql("hi", "cost * (1 + edge_id % 3)")}
    SELECT q.o AS origin_id, q.d AS destination_id, q.tons, array_to_string(a.path, '>') AS min_edge_path, array_to_string(b.path, '>') AS max_edge_path, tons * {exact("x.c")} AS min_gcost, tons * {exact("y.c")} AS max_gcost, a.path IS NOT NULL AND b.path IS NOT NULL AS reachable,
        coalesce(m.length, 0) AS min_length, coalesce(m.time, 0) AS min_time, coalesce(n.length, 0) AS max_length, coalesce(n.time, 0) AS max_time
    FROM pairs q LEFT JOIN lo x ON x.o = q.o AND x.n = q.d LEFT JOIN hi y ON y.o = q.o AND y.n = q.d LEFT JOIN lo_path a ON a.o = q.o AND a.d = q.d LEFT JOIN hi_path b ON b.o = q.o AND b.d = q.d LEFT JOIN lo_sums m ON m.o = q.o AND m.d = q.d LEFT JOIN hi_sums n ON n.o = q.o AND n.d = q.d""")
def n14_path_assembly(t: Tables):
    """Paths at least and largest cost, costs times tons, and each path's length and time."""
    edges = road_edges(t).withColumn("min_gcost", F.col("cost")).withColumn("max_gcost", F.col("cost") * (1 + F.col("edge_id") % 3))
    out, key = routing.od_path_assembly(demand(t), edges).checkpoint(), ["origin_id", "destination_id"]
    for side in ("min", "max"):
        names = {f"{side}_{s}": F.col(s) for s in SUMS}
        out = routing.with_path_sums(out, edges.withColumns(names), list(names), key, f"{side}_edge_path")
    return out.withColumns({c: F.array_join(c, ">") for c in ("min_edge_path", "max_edge_path")})


@query(f"""WITH RECURSIVE {BASE_PATHS}, used AS MATERIALIZED (SELECT DISTINCT e AS s, o, d FROM (SELECT o, d, unnest(path) AS e FROM t_path)), shut AS MATERIALIZED (SELECT DISTINCT s, s AS e FROM used),
    {trees_sql("f", "SELECT DISTINCT s, o FROM used", "arcs", "shut")}, {walk_sql("f", "used")}, {sums_sql("f")},
    x AS (SELECT u.s AS scenario_id, u.o AS origin_id, u.d AS destination_id, q.tons, {exact("t.c")} AS old_cost, coalesce(a.length, 0) AS old_length, coalesce(a.time, 0) AS old_time, (f.c IS NULL)::INTEGER AS no_access, {exact("f.c")} AS new_cost, CASE WHEN f.c IS NOT NULL THEN coalesce(b.length, 0) END AS new_length, CASE WHEN f.c IS NOT NULL THEN coalesce(b.time, 0) END AS new_time
        FROM used u JOIN pairs q ON q.o = u.o AND q.d = u.d JOIN t ON t.o = u.o AND t.n = u.d JOIN t_sums a ON a.o = u.o AND a.d = u.d LEFT JOIN f ON f.s = u.s AND f.o = u.o AND f.n = u.d LEFT JOIN f_sums b ON b.s = u.s AND b.o = u.o AND b.d = u.d)
    SELECT *, coalesce(new_cost - old_cost, 0) AS cost_diff, coalesce(new_length - old_length, 0) AS length_diff, coalesce(new_time - old_time, 0) AS time_diff, tons * coalesce(new_cost - old_cost, 0) AS tr_loss FROM x""")
def n18_failures(t: Tables):
    """Every edge that carries flow fails on its own; pairs on it are rerouted or cut off, with their losses and what they gain in length and time."""
    paths = routed(t).where("reachable and tons > 0").checkpoint()
    edges = road_edges(t)
    used = routing.failure_set(edges.select(F.col("edge_id").cast("string").alias("edge_id")), routing.edge_flows(paths, "path", ["tons"]), "tons")
    return routing.rerouting_losses(routing.failures(used.select(F.col("edge_id").alias("scenario_id"), "edge_id"), paths, edges, sums=SUMS), sums=SUMS)


@query(f"""WITH RECURSIVE {BASE_PATHS}, shut AS MATERIALIZED (SELECT brand || '|' || kind AS s, edge_id::VARCHAR AS e FROM edges), used AS MATERIALIZED (SELECT DISTINCT z.s, o, d FROM (SELECT o, d, unnest(path) AS e FROM t_path) p JOIN shut z ON z.e = p.e),
    {trees_sql("f", "SELECT DISTINCT s, o FROM used", "arcs", "shut")},
    x AS (SELECT u.s AS scenario_id, q.tons, (f.c IS NULL)::INTEGER AS no_access, q.tons * coalesce({exact("f.c")} - {exact("t.c")}, 0) AS tr_loss FROM used u JOIN pairs q ON q.o = u.o AND q.d = u.d JOIN t ON t.o = u.o AND t.n = u.d LEFT JOIN f ON f.s = u.s AND f.o = u.o AND f.n = u.d)
    SELECT scenario_id, no_access, sum(tons) AS tons, round(sum(tr_loss), 4) AS tr_loss FROM x WHERE tons > 0 GROUP BY 1, 2""")
def n19_joint_failures(t: Tables):
    """All edges of a brand and kind fail together; isolated and rerouted losses by scenario."""
    paths = routed(t).where("reachable").checkpoint()
    scenarios = road_edges(t).select(F.concat_ws("|", "brand", "kind").alias("scenario_id"), F.col("edge_id").cast("string").alias("edge_id"))
    failed = routing.rerouting_losses(routing.failures(scenarios, paths, road_edges(t))).checkpoint()
    lost = routing.isolated_losses(failed, ["scenario_id"], ["tons"]).withColumn("no_access", F.lit(1))
    moved = routing.reroute_losses(failed, ["scenario_id"], ["tons", "tr_loss"]).withColumn("no_access", F.lit(0))
    return lost.withColumn("tr_loss", F.lit(0.0)).select("scenario_id", "no_access", "tons", "tr_loss").unionByName(moved.select("scenario_id", "no_access", "tons", F.round("tr_loss", 4).alias("tr_loss")))


MODES = """net AS MATERIALIZED (
    SELECT m || ':' || edge_id AS edge_id, m || ':' || from_node AS from_node, m || ':' || to_node AS to_node, CASE WHEN m = 'rail' THEN cost ELSE cost * 2 END AS cost, m AS mode FROM (SELECT *, CASE WHEN length % 5 = 0 THEN 'rail' ELSE 'road' END AS m FROM edges)
    UNION ALL SELECT 'link:' || s_suppkey, 'rail:' || s_suppkey, 'road:' || s_suppkey, 1 + s_suppkey / 1048576.0::DOUBLE, 'link' FROM supplier WHERE s_acctbal > 0)"""


def modes(t: Tables):
    """A network of two modes: parts of every fifth size are rail, the others road; suppliers with a balance are stations that link both."""
    rail = F.col("length") % 5 == 0
    edges = road_edges(t).select("edge_id", "from_node", "to_node", F.when(rail, F.col("cost")).otherwise(F.col("cost") * 2).alias("cost"), F.when(rail, "rail").otherwise("road").alias("mode"))
    links = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("edge_id"), F.lit("rail").alias("from_mode"), F.col("s_suppkey").alias("from_node"), F.lit("road").alias("to_mode"), F.col("s_suppkey").alias("to_node"), (1 + F.col("s_suppkey") / 1048576).alias("cost"))
    return routing.layered(edges, links).checkpoint()


def rail_failures(t: Tables):
    """Each rail edge with flow fails on its own, and all of rail at once with its links."""
    network = modes(t)
    od = demand(t).select(F.concat(F.lit("rail:"), "origin_id").alias("origin_id"), F.concat(F.lit("rail:"), "destination_id").alias("destination_id"), "tons")
    flows = routing.edge_flows(routing.shortest_paths(od, network.where("mode = 'rail'")), "path", ["tons"])
    single = routing.failure_set(network, flows, "tons").select(F.col("edge_id").alias("scenario_id"), "edge_id")
    return routing.modal_failures(single.unionByName(routing.mode_closures(network).where("scenario_id = 'rail'")), od, network, "rail")


@query(f"""WITH RECURSIVE {EDGES}, {MODES}, pairs AS MATERIALIZED (SELECT 0 AS s, 'rail:' || o AS o, 'rail:' || d AS d, tons FROM ({DEMAND})), {arcs_sql("r_arcs", "(SELECT * FROM net WHERE mode = 'rail')")}, {arcs_sql("arcs", "net")},
    {trees_sql("t", "SELECT DISTINCT s, o FROM pairs", "r_arcs")}, {walk_sql("t", "pairs")}, old AS MATERIALIZED (SELECT o, d, unnest(path) AS e FROM t_path),
    shut AS MATERIALIZED (SELECT DISTINCT e AS s, e FROM old UNION ALL SELECT 'rail', edge_id FROM net WHERE mode <> 'road'), used AS MATERIALIZED (SELECT DISTINCT z.s, o, d FROM old JOIN shut z ON z.e = old.e),
    {trees_sql("f", "SELECT DISTINCT s, o FROM used", "arcs", "shut")}, {walk_sql("f", "used")},
    m AS (SELECT s, o, d, bool_or(mode <> 'rail') AS changed FROM (SELECT s, o, d, unnest(path) AS e FROM f_path) p JOIN net ON e = edge_id GROUP BY 1, 2, 3)
    SELECT u.s AS scenario_id, count(*) AS pairs, sum((f.c IS NULL)::BIGINT)::BIGINT AS lost, sum(coalesce(m.changed, false)::BIGINT)::BIGINT AS changed, sum(CASE WHEN f.c IS NULL THEN tons ELSE 0 END) AS lost_tons, sum(CASE WHEN m.changed THEN tons ELSE 0 END) AS changed_tons, round(sum(tons * coalesce({exact("f.c")} - {exact("t.c")}, 0)), 4) AS tr_loss
    FROM used u JOIN pairs q ON q.o = u.o AND q.d = u.d JOIN t ON t.o = u.o AND t.n = u.d LEFT JOIN f ON f.s = u.s AND f.o = u.o AND f.n = u.d LEFT JOIN m ON m.s = u.s AND m.o = u.o AND m.d = u.d GROUP BY 1""")
def n21_modal_failures(t: Tables):
    """Rail flows rerouted over rail, road and their links when rail edges fail: pairs and tons that are lost or change their mode, by scenario."""
    rows = routing.rerouting_losses(rail_failures(t))
    n = lambda c: F.sum(c.cast("long"))
    lost = F.col("no_access") == 1
    return rows.groupBy("scenario_id").agg(F.count("*").alias("pairs"), n(lost).alias("lost"), n(F.col("changed")).alias("changed"), F.sum(F.when(lost, F.col("tons")).otherwise(0.0)).alias("lost_tons"), F.sum(F.when(F.col("changed"), F.col("tons")).otherwise(0.0)).alias("changed_tons"), F.round(F.sum("tr_loss"), 4).alias("tr_loss"))


@query("""SELECT l_suppkey AS edge_id, min(s) AS min_speed, max(s) AS max_speed FROM (SELECT l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) GROUP BY 1""")
def n23_speed_range(t: Tables):
    """Range of a path value on each edge."""
    return routing.speed_range(path_table(t), "path", "tons")


@query("""SELECT l_suppkey AS edge_id, max_by(least(l_quantity, l_tax), l_orderkey * 8 + l_linenumber) AS min_loss, max_by(greatest(l_quantity, l_tax), l_orderkey * 8 + l_linenumber) AS max_loss FROM lineitem GROUP BY 1""")
def n25_last_result(t: Tables):
    """Of several result rows of an edge the last, pairs in order."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("edge_id"), F.col("l_quantity").alias("min_loss"), F.col("l_tax").alias("max_loss"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return routing.last_per_edge(rows, "seq").drop("seq")


@query("""WITH r AS (SELECT l_partkey AS edge_id, l_returnflag AS f, sum(l_quantity) AS tons FROM lineitem GROUP BY 1, 2), a AS (SELECT edge_id, tons FROM r WHERE f = 'A'), b AS (SELECT edge_id, tons FROM r WHERE f = 'R'),
    j AS (SELECT a.edge_id, a.tons AS lo, coalesce(b.tons, 0) AS hi FROM a LEFT JOIN b USING (edge_id)) SELECT edge_id, least(lo, hi)::DOUBLE AS min_tons, greatest(lo, hi)::DOUBLE AS max_tons FROM j""")
def a11_edge_summary(t: Tables):
    """Min and max results of edges; edges only in the max set are left out."""
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("edge_id"), F.col("l_quantity").alias("tons"))
    return routing.edge_summary(side("A"), side("R"), ["edge_id"], ["tons"])


@query("""SELECT l_partkey AS edge_id, l_returnflag AS prov, (l_quantity > 25)::INTEGER AS no_access, sum(l_extendedprice * 0 + l_quantity) AS tons FROM lineitem GROUP BY 1, 2, 3""")
def a9_a10_losses(t: Tables):
    """Isolated and rerouted losses by edge and province."""
    rows = t.lineitem.select(F.col("l_partkey").alias("edge_id"), F.col("l_returnflag").alias("prov"), (F.col("l_quantity") > 25).cast("int").alias("no_access"), F.col("l_quantity").alias("tons"))
    lost, moved = routing.isolated_losses(rows, ["edge_id", "prov"], ["tons"]), routing.reroute_losses(rows, ["edge_id", "prov"], ["tons"])
    return lost.withColumn("no_access", F.lit(1)).unionByName(moved.withColumn("no_access", F.lit(0)))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 50 UNION SELECT p_partkey FROM part WHERE p_size = 7) SELECT k AS edge_id FROM e JOIN part ON k = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#12') AND k NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1)""")
def n22_extra_failures(t: Tables):
    """Flagged or flooded edges of one class that have not failed already."""
    flagged = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("edge_id"))
    near = t.part.where("p_size = 7").select(F.col("p_partkey").alias("edge_id"))
    edges = t.part.select(F.col("p_partkey").alias("edge_id"), F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "national").alias("road_type"))
    failed = t.lineitem.where("l_returnflag = 'R' and l_quantity = 1").select(F.col("l_partkey").alias("edge_id"))
    return routing.extra_failures(flagged, near, edges, "national", failed)


@query(f"""WITH {relaxed_sql('SELECT s_suppkey AS o FROM supplier')}, served AS (SELECT DISTINCT o_custkey AS k, l_suppkey AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    r AS (SELECT c_custkey AS record, abs(c_acctbal) AS kms, b.o AS origin_id, d AS destination_id, b.c AS routed_km, row_number() OVER (PARTITION BY c_custkey ORDER BY b.c, b.o, d) AS n FROM customer JOIN served ON k = c_custkey JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey <> d JOIN best b ON b.o = s_suppkey AND b.n = d)
    SELECT record, origin_id, destination_id, routed_km, kms, abs(routed_km - kms) > 0.2 * kms AS mismatch FROM r WHERE n = 1""")
def n24_closest_candidates(t: Tables):
    """Of each customer's candidate station pairs (all suppliers of its nation, all suppliers of its orders) the nearest, and those far off the reported distance."""
    served = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("record"), F.col("l_suppkey").alias("destination_id")).distinct()
    records = t.customer.select(F.col("c_custkey").alias("record"), F.col("c_nationkey").alias("place"), F.abs("c_acctbal").alias("kms")).join(served, "record")
    stations = t.supplier.select(F.col("s_nationkey").alias("place"), F.col("s_suppkey").alias("origin_id"))
    return routing.closest_candidates(records, stations, road_edges(t), "record")


@query("""SELECT 'rail' AS mode, count(*) AS n FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R') UNION ALL SELECT 'road', count(*) FROM part""")
def n21_multi_modal_edges(t: Tables):
    """Edge tables of two modes as one network, closed links and rail edges without flow left out."""
    flows = t.lineitem.where("l_quantity = 50 and l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("edge_id")).agg(F.sum("l_quantity").alias("tons"))
    rail = t.supplier.select(F.lit("rail").alias("mode"), F.col("s_suppkey").alias("edge_id"), F.when(F.col("s_acctbal") > 0, "operational").otherwise("closed").alias("operation_state"))
    road = t.part.select(F.lit("road").alias("mode"), F.col("p_partkey").alias("edge_id"))
    return routing.multi_modal_edges([rail, road], flows).groupBy("mode").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS k, s_suppkey AS j FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal""")
def x2_pair_predicate(t: Tables):
    """Pairs under an equal key for which a predicate holds."""
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), "c_acctbal")
    b = t.supplier.select(F.col("s_suppkey").alias("j"), F.col("s_nationkey").alias("n"), "s_acctbal")
    return joins.link_pairs(a, b, ["n"], lambda x, y: x["c_acctbal"] > y["s_acctbal"]).select("k", "j")


