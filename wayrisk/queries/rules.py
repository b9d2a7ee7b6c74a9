"""Scalar rules, sources, joins and lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayrisk.functions import columns as C
from wayrisk.operators import joins, lookup, od, ordered
from wayrisk.queries.base import DEPOTS, OD_LOG, PLACES, Tables, depots, od_log, places, query
from wayrisk.sources import tables as S


@query("""SELECT p_partkey AS asset, 'FU_1in' || p_size || '_50cm-' || (p_size % 4 + 1) || 'm.shp' AS file_name, p_size::INTEGER AS return_period, '50cm' AS min_depth, (p_size % 4 + 1) || 'm' AS max_depth,
    0.5::DOUBLE AS min_m, (p_size % 4 + 1)::DOUBLE AS max_m, CASE WHEN p_size % 2 = 0 THEN 2030 ELSE 2016 END::INTEGER AS year,
    CASE WHEN p_size % 3 = 0 THEN 'rcp4p5' WHEN p_size % 3 = 1 THEN 'rcp8p5' ELSE 'none' END AS climate_scenario, round(1.0 / (10000 + p_size), 9)::DOUBLE AS probability FROM part""")
def s4_s5_p7_file_scenarios(t: Tables):
    """Scenario attributes from file names of parts."""
    size = F.col("p_size")
    name = F.concat(F.lit("FU_1in"), size, F.lit("_50cm-"), size % 4 + 1, F.lit("m.shp"))
    river = F.concat(F.lit("inunriver_"), F.when(size % 3 == 0, "rcp4p5_").when(size % 3 == 1, "rcp8p5_").otherwise("historical_"), F.when(size % 2 == 0, "2030_").otherwise("1980_"), F.lit("rp_"), (size + 10000).cast("string"))
    df = t.part.select(F.col("p_partkey").alias("asset"), name.alias("file_name"), river.alias("river"))
    df = df.withColumn("s", S.scenario_of_file(F.col("file_name"))).withColumn("c", S.climate_of_file(F.col("river"))).select("asset", "file_name", "s.*", "c.*")
    return df.withColumns({"min_m": C.depth_metres(F.col("min_depth")), "max_m": C.depth_metres(F.col("max_depth")), "probability": F.round("probability", 9)})


@query(f"""WITH {OD_LOG}, w AS (SELECT o, d, sum(tons) AS tons FROM od GROUP BY o, d) SELECT o AS origin, d::VARCHAR AS destination, tons FROM w WHERE tons > 0""")
def s3_melt_zone_matrix(t: Tables):
    """S3: a wide nation x nation matrix molten to rows."""
    zones = [r.n_nationkey for r in t.nation.select("n_nationkey").distinct().orderBy("n_nationkey").collect()]
    wide = od_log(t).groupBy("o").pivot("d", zones).agg(F.sum("tons"))
    return S.melt_zones(wide, "o")


@query("""SELECT s_suppkey AS id, 10.5 + s_suppkey AS x0, len(s_name)::DOUBLE AS y0, 3 AS n FROM supplier""")
def s6_wkt_geometry(t: Tables):
    """Lines from WKT text."""
    text = F.concat(F.lit("LINESTRING ("), F.lit(10.5) + F.col("s_suppkey"), F.lit(" "), F.length("s_name").cast("double"), F.lit(", 1.25 -2, 3e2 4)"))
    df = S.read_geometry(t.supplier.select(F.col("s_suppkey").alias("id"), text.alias("wkt")))
    return df.select("id", F.col("points")[0]["x"].alias("x0"), F.col("points")[0]["y"].alias("y0"), F.size("points").alias("n"))


@query("""SELECT l_suppkey::VARCHAR AS edge_id, count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def s8_text_paths(t: Tables):
    """Path lists stored as text, read back and counted by edge."""
    text = F.concat(F.lit("['"), F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), "', '"), F.lit("']"))
    stored = t.lineitem.groupBy("l_orderkey").agg(text.alias("path"))
    return stored.select(F.explode(S.path_list(F.col("path"))).alias("edge_id")).groupBy("edge_id").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS name, n_regionkey::VARCHAR AS region FROM nation WHERE n_nationkey >= 3""")
def s9_sub_table(t: Tables):
    """Fields 1 and 2 of text lines after the first three, under new names."""
    lines = t.nation.select(F.col("n_nationkey").alias("line_no"), F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    return S.sub_table(lines, 3, 1, 2, ["name", "region"])


@query("""SELECT o_orderkey AS k, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, TIMESTAMP '2016-01-01') AS start,
    round(date_diff('second', o_orderdate, o_orderdate + to_days((o_orderkey % 5)::INTEGER)) / 3600.0, 4)::DOUBLE AS hours,
    CASE WHEN o_orderkey % 5 > 0 THEN round(o_orderkey % 1000 / (24.0 * (o_orderkey % 5)), 6)::DOUBLE END AS speed,
    CASE WHEN o_orderkey % 60 BETWEEN 10 AND 50 THEN o_orderkey % 60 WHEN o_orderkey % 70 BETWEEN 10 AND 50 THEN o_orderkey % 70 ELSE 20 END::DOUBLE AS chosen FROM orders""")
def p3_p4_p5_transit(t: Tables):
    """Default dates, transit hours and speed, choice of a speed."""
    k = F.col("o_orderkey")
    end = F.col("o_orderdate") + F.make_dt_interval((k % 5).cast("int"))
    hours = C.transit_hours(F.col("o_orderdate"), end)
    start = C.or_default_date(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), "2016-01-01")
    speed = F.round(C.transit_speed((k % 1000).cast("double"), hours), 6)
    return t.orders.select(k.alias("k"), start.alias("start"), F.round(hours, 4).alias("hours"), speed.alias("speed"), C.choose_speed((k % 60).cast("double"), (k % 70).cast("double")).alias("chosen"))


@query("""SELECT c_custkey AS k, 'general ' || replace(lower(c_name), '#', '') || ' estacion aeioun' AS name,
    CASE WHEN c_custkey % 2 = 0 THEN 15 * abs(c_acctbal) ELSE abs(c_acctbal) END AS tons, round(c_acctbal / 365, 6) AS daily FROM customer""")
def p6_p8_names_units(t: Tables):
    """Normal names; tons of vehicles; tons a day."""
    name = F.concat(F.lit("  GRAL. "), "c_name", F.lit(" EST. áéíóúñ "))
    rules = (("gral.", "general"), ("est.", "estacion"), ("#", ""))
    unit = F.when(F.col("c_custkey") % 2 == 0, " Unidades").otherwise("tons")
    return t.customer.select(F.col("c_custkey").alias("k"), C.normal_name(name, rules).alias("name"), C.tons_of(F.abs("c_acctbal"), unit).alias("tons"), F.round(C.per_day(F.col("c_acctbal")), 6).alias("daily"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS a, o_orderkey % 4 AS p, o_orderkey % 5 AS b,
        CASE o_orderkey % 4 WHEN 0 THEN 'Export' WHEN 1 THEN 'Import' WHEN 2 THEN 'Transit' ELSE 'Import' END AS kind FROM orders),
    n AS (SELECT *, len(list_distinct([a, p, b])) AS n FROM r),
    l AS (SELECT k, kind, 'in' AS leg, CASE WHEN n = 1 THEN -1 WHEN n = 2 AND a <> p THEN a WHEN n = 2 THEN b END AS other, p, a, b, n FROM n)
    SELECT k, kind, CASE WHEN kind = 'Import' THEN other ELSE p END AS o, CASE WHEN kind = 'Import' THEN p ELSE other END AS d FROM l WHERE n < 3
    UNION ALL SELECT k, kind, a, p FROM l WHERE n = 3 UNION ALL SELECT k, kind, p, b FROM l WHERE n = 3""")
def p10_p11_port_legs(t: Tables):
    """Kinds of operation, and directed legs of port records."""
    k = F.col("o_orderkey")
    names = F.array(*(F.lit(x) for x in ("Exportación", "Importación", "Otros", "Cabotaje Entrado")))
    kind = C.trade_kind(F.get(names, k % 4))
    df = t.orders.select(k.alias("k"), kind.alias("kind"), F.explode(C.port_legs(k % 3, k % 4, k % 5, kind, F.lit(-1).cast("long"))).alias("leg"))
    return df.select("k", "kind", "leg.o", "leg.d")


@query("""WITH r AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'national' WHEN 1 THEN 'province' ELSE 'rural' END AS kind,
        CASE WHEN p_partkey % 7 = 0 THEN '0' WHEN p_partkey % 2 = 0 THEN 'T,A' ELSE 'R' END AS material, CASE p_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'pavimentado' ELSE 'de tierra' END AS surface,
        p_size % 3 AS service, p_size % 8 AS quality, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS width FROM part)
    SELECT k, CASE WHEN k % 6 = 0 THEN 'no number' ELSE 'RN' || k END AS name,
        CASE WHEN kind = 'national' THEN CASE WHEN material = '0' THEN 'Asfalto' WHEN material = 'R' THEN 'Ripio' ELSE 'Asfalto,Tierra' END
             WHEN surface = '0' THEN 'Tierra' WHEN surface = 'pavimentado' THEN 'Pavimentado' ELSE 'De Tierra' END AS surface,
        CASE WHEN kind = 'national' THEN CASE WHEN material = 'R' THEN 'unpaved' ELSE 'paved' END WHEN surface = 'pavimentado' THEN 'paved' ELSE 'unpaved' END AS condition,
        CASE WHEN width <> 0 THEN width WHEN kind = 'rural' THEN 3.65 ELSE 7.3 END::DOUBLE AS width, CASE WHEN k % 3 = 0 THEN 'mountain' ELSE 'flat' END AS terrain,
        CASE WHEN kind = 'province' THEN 40 WHEN kind = 'rural' THEN 20 WHEN service = 1 OR quality BETWEEN 1 AND 3 THEN 50 WHEN service = 2 OR quality BETWEEN 4 AND 6 THEN 60 ELSE 70 END::DOUBLE AS min_speed,
        CASE WHEN kind = 'province' THEN 60 WHEN kind = 'rural' THEN 40 WHEN service = 1 OR quality BETWEEN 1 AND 3 THEN 80 WHEN service = 2 OR quality BETWEEN 4 AND 6 THEN 90 ELSE 100 END::DOUBLE AS max_speed,
        CASE WHEN quality > 7 THEN 4 WHEN quality > 5 THEN 3 WHEN quality > 3 THEN 2 WHEN quality > 0 THEN 1 ELSE 0 END::INTEGER AS quality_band
    FROM r""")
def p13_p17_p36_road_rules(t: Tables):
    """Labels, surface, condition, width, terrain, speeds and score bands of roads."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "national").when(k % 3 == 1, "province").otherwise("rural")
    material = F.when(k % 7 == 0, "0").when(k % 2 == 0, "T,A").otherwise("R")
    surface = F.when(k % 5 == 0, "0").when(k % 5 == 1, "pavimentado").otherwise("de tierra")
    width = F.when(k % 4 == 0, 0).otherwise(F.col("p_size")).cast("double")
    terrain = F.when(k % 3 == 0, " Montaña").when(k % 3 == 1, "Llano").otherwise("x")
    speeds = C.default_speeds(F.lit(0), F.lit(0), kind, F.col("p_size") % 3, F.col("p_size") % 8)
    df = t.part.select(
        k.alias("k"), C.road_name(F.when(k % 6 != 0, F.concat(F.lit("RN"), k))).alias("name"), C.road_surface(kind, material, surface).alias("surface"), C.road_condition(kind, material, surface).alias("condition"),
        C.default_width(width, kind).alias("width"), C.terrain_class(terrain).alias("terrain"), speeds.alias("s"), C.score_band(F.col("p_size") % 8, C.QUALITY_BANDS).alias("quality_band"),
    )
    return df.select(*[c for c in df.columns if c != "s"], "s.*")


@query("""WITH r AS (SELECT p_partkey AS k, p_size::DOUBLE AS len, (p_partkey % 3) * 20.0 AS lo, (p_partkey % 3) * 20.0 + 40 AS hi FROM part)
    SELECT k, round(len / hi, 6)::DOUBLE AS min_time, round(len / CASE WHEN lo = 0 THEN 20 ELSE lo END, 6)::DOUBLE AS max_time, round(0.065 * len * 0.5, 6)::DOUBLE AS tariff,
        round(len / hi / 15 + 0.065 * len * 0.5, 6)::DOUBLE AS gcost, round(1.1 * len, 6)::DOUBLE AS used FROM r""")
def p18_p21_costs(t: Tables):
    """Travel times, tariffs, generalised costs, usage factors."""
    n, k = F.col("p_size").cast("double"), F.col("p_partkey")
    times = C.travel_times(n, (k % 3) * 20.0, (k % 3) * 20.0 + 40)
    tariff = C.tariff_cost(F.lit(0.065), n, 0.5)
    df = t.part.select(k.alias("k"), times.alias("t"), tariff.alias("tariff"), C.generalised_cost(times["min_time"], tariff).alias("gcost"), C.with_usage(n, 0.1).alias("used"))
    return df.select("k", *(F.round(c, 6).alias(c.split(".")[-1]) for c in ("t.min_time", "t.max_time", "tariff", "gcost", "used")))


@query("""WITH r AS (SELECT c_custkey AS k, c_acctbal AS a, c_acctbal * (c_custkey % 3 - 1) AS b FROM customer),
    s AS (SELECT *, CASE WHEN a < 0 AND b < 0 THEN abs(a) > abs(b) ELSE a > b END AS sw FROM r) SELECT k, CASE WHEN sw THEN b ELSE a END AS min_loss, CASE WHEN sw THEN a ELSE b END AS max_loss FROM s""")
def p22_p23_minmax_order(t: Tables):
    """P22, P23."""
    k = F.col("c_custkey")
    return C.order_all_pairs(t.customer.select(k.alias("k"), F.col("c_acctbal").alias("min_loss"), (F.col("c_acctbal") * (k % 3 - 1)).alias("max_loss")))


@query("""WITH r AS (SELECT p_partkey AS k, p_retailprice AS x, (p_partkey % 4) * 250.0 AS y FROM part),
    c AS (SELECT *, CASE WHEN x - y = 0 AND y = 0 THEN 0 WHEN y = 0 THEN sign(x - y) * 1e9 ELSE 100 * (x - y) / y END AS ch FROM r)
    SELECT k, round(ch, 6) AS change, CASE WHEN ch < -100 THEN '< -100' WHEN ch < -50 THEN '-100 to -50' WHEN ch < -10 THEN '-50 to -10' WHEN ch < 0 THEN '-10 to 0' WHEN ch < 0.001 THEN NULL
        WHEN ch < 10 THEN '0 to 10' WHEN ch < 50 THEN '10 to 50' WHEN ch < 100 THEN '50 to 100' ELSE ' > 100' END AS class,
        round(greatest(-100, least(100, ch)), 6)::DOUBLE AS clipped, pow(10, floor(log10(x)))::DOUBLE * round_even(x / pow(10, floor(log10(x))), 0)::DOUBLE AS rounded, round(1 / (k % 7 + 1), 9) AS return_period FROM c""")
def p33_p37_p41_changes(t: Tables):
    """Significant figures, percent change with sentinels, classes, clipping, return periods."""
    k = F.col("p_partkey")
    df = t.part.select(k.alias("k"), F.col("p_retailprice").alias("x"), ((k % 4) * 250.0).alias("y"))
    df = df.withColumn("change", C.percent_change(F.col("x"), F.col("y"))).withColumn("class", C.range_label(F.col("change")))
    df = C.clipped_change(df.withColumn("clipped", F.col("change")), "clipped", "x", -1e18)
    return df.select("k", F.round("change", 6).alias("change"), "class", F.round("clipped", 6).alias("clipped"), C.round_significant(F.col("x"), 1).alias("rounded"), F.round(C.return_period((F.col("k") % 7 + 1).cast("double")), 9).alias("return_period"))


@query("""WITH d AS (SELECT unnest([10, 20, 30]) AS duration) SELECT p_partkey AS k, duration::INTEGER AS duration, round(duration * p_size + p_retailprice, 4) AS total_risk,
    'road_' || p_partkey AS node, 'air_' || CASE WHEN p_brand = 'Brand#11' THEN 'EZE' ELSE p_brand END || '-' || p_type AS route FROM part, d
    WHERE p_size + p_retailprice > 0 AND p_size > 2 AND p_size < 40 AND p_retailprice > 900 AND p_retailprice < 1e6""")
def p38_p42_risk_rows(t: Tables):
    """Extent filter, ids, risk filter, and total risk for several durations."""
    df = t.part.where(C.within_extent(F.col("p_size"), F.col("p_retailprice"), (2, 40, 900, 1e6))).where(C.carries_risk(F.col("p_size").cast("double"), F.col("p_retailprice")))
    out = C.total_risk(df.withColumnsRenamed({"p_size": "eael", "p_retailprice": "ead"}), [10, 20, 30])
    return out.select(F.col("p_partkey").alias("k"), "duration", F.round("total_risk", 4).alias("total_risk"), C.node_id("road", F.col("p_partkey")).alias("node"), C.route_id("air", F.col("p_brand"), F.col("p_type"), {"Brand#11": "EZE"}).alias("route"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS node_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)
    SELECT p_partkey AS edge_id, CASE WHEN (p_partkey % n + 1) IN (SELECT node_id FROM f) OR (p_partkey * 7 % n + 1) IN (SELECT node_id FROM f) THEN 'operational' ELSE 'not operational' END AS operation_state FROM part, (SELECT max(s_suppkey) AS n FROM supplier)""")
def p43_operational_links(t: Tables):
    """Links with an end that carries flow."""
    flow = t.lineitem.where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_suppkey").alias("node_id")).distinct()
    k, n = F.col("p_partkey"), F.lit(t.supplier.agg(F.max("s_suppkey")).first()[0])
    return C.operational_state(t.part.select(k.alias("edge_id"), (k % n + 1).alias("from_node"), (k * 7 % n + 1).alias("to_node")), flow).select("edge_id", "operation_state")


@query("""SELECT c_custkey AS k, coalesce(sum(o_totalprice), 0) > 0 AS any, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def j1_p2_left_fill(t: Tables):
    """Left join with numeric gaps as 0."""
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    out = joins.left_fill(t.customer.select("c_custkey"), orders, ["c_custkey"])
    return out.select(F.col("c_custkey").alias("k"), (F.col("total") > 0).alias("any"), "n")


@query("""SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer""")
def j2_j3_semi_anti(t: Tables):
    """J2, J3."""
    ids, orders = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    return joins.present_in(ids, orders, ["k"]).withColumn("has", F.lit(True)).unionByName(joins.absent_from(ids, orders, ["k"]).withColumn("has", F.lit(False)))


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS a FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS b FROM lineitem WHERE l_quantity < 2 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.k = b.k""")
def j4_outer_fill(t: Tables):
    """J4."""
    a = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("a"))
    b = t.lineitem.where("l_quantity < 2").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("b"))
    return joins.outer_fill(a, b, ["k"])


@query("""SELECT s_suppkey AS node, s_name AS name, l_returnflag AS hazard, sum(l_quantity) AS exposed FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""")
def j5_one_to_many(t: Tables):
    """Nodes with their hazards; node keys must be unique."""
    many = t.lineitem.select(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("hazard"), "l_quantity")
    out = joins.one_to_many(t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name")), many, ["node"])
    return out.groupBy("node", "name", "hazard").agg(F.sum("l_quantity").alias("exposed"))


@query("""SELECT p_partkey AS bridge_id, l_suppkey AS edge_id, flow FROM (SELECT p_partkey, p_partkey % n + 1 AS l_suppkey FROM part, (SELECT max(s_suppkey) AS n FROM supplier)) JOIN (SELECT l_suppkey, sum(l_quantity) AS flow FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (l_suppkey) WHERE flow > 0""")
def j30_bridges(t: Tables):
    """Bridges inherit their edge's flow."""
    edges = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("edge_id")).agg(F.sum("l_quantity").alias("flow"))
    n = F.lit(t.supplier.agg(F.max("s_suppkey")).first()[0])
    return joins.inherit_from_edges(t.part.select(F.col("p_partkey").alias("bridge_id"), (F.col("p_partkey") % n + 1).alias("edge_id")), edges, "flow").select("bridge_id", "edge_id", "flow")


@query("""SELECT p_partkey AS k, lower(p_brand) || '/' || min(r_name) AS industry FROM part JOIN region ON p_size % 5 = r_regionkey GROUP BY p_partkey, p_brand""")
def j6_industries(t: Tables):
    """Industries by commodity group and subgroup, without regard to case."""
    region = t.region.select(F.col("r_regionkey").alias("r"), "r_name")
    df = t.part.join(region, F.col("p_size") % 5 == F.col("r")).select(F.col("p_partkey").alias("k"), F.lower("p_brand").alias("commodity_group"), F.lower("r_name").alias("commodity_subgroup"))
    table = t.part.select(F.col("p_brand").alias("commodity_group")).distinct().join(F.broadcast(t.region.select(F.upper("r_name").alias("commodity_subgroup"), "r_name"))).withColumn("industry", F.concat(F.lower("commodity_group"), F.lit("/"), "r_name"))
    return lookup.industry_of(df, table).select("k", "industry")


@query("""SELECT s_suppkey AS k, coalesce((SELECT min_by(n_nationkey::VARCHAR, n_nationkey) FROM nation WHERE n_regionkey = s_suppkey % 7), '') AS province FROM supplier""")
def j7_first_by_name(t: Tables):
    """The first lookup row of a name, '' where there is none."""
    table = t.nation.select(F.concat(F.lit(" REGION "), "n_regionkey").alias("name"), F.col("n_nationkey").cast("string").alias("province"), F.col("n_nationkey").alias("seq"))
    df = t.supplier.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("region "), F.col("s_suppkey") % 7).alias("name"))
    return lookup.first_by_name(df, "name", table, "province").select("k", "province")


@query("""WITH e AS (SELECT p_partkey AS edge_id, p_brand AS road_no, p_size::DOUBLE AS prog_min, p_size + 0.5 AS prog_max FROM part),
    l AS (SELECT s_suppkey AS seq, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 3) AS road_no, s_suppkey % 20 AS start_km, s_suppkey % 20 + 20 AS end_km, s_acctbal AS width FROM supplier)
    SELECT e.edge_id, min_by(width, seq) AS width FROM e LEFT JOIN l ON e.road_no = l.road_no AND prog_min >= start_km AND prog_max <= end_km GROUP BY e.edge_id""")
def j8_range_lookup(t: Tables):
    """Width by road name and km range, the first row wins."""
    edges = t.part.select(F.col("p_partkey").alias("edge_id"), F.array("p_brand").alias("road_no"), F.col("p_size").cast("double").alias("prog_min"), (F.col("p_size") + 0.5).alias("prog_max"))
    k = F.col("s_suppkey")
    table = t.supplier.select(k.alias("seq"), F.concat(F.lit("Brand#"), 1 + k % 5, 1 + k % 3).alias("road_no"), (k % 20).alias("start_km"), (k % 20 + 20).alias("end_km"), F.col("s_acctbal").alias("width"))
    return lookup.first_in_range(edges, table, "road_no", "prog_min", "prog_max", "start_km", "end_km", ["width"]).select("edge_id", "width")


@query("""WITH s AS (SELECT n_nationkey * 3.0 + 5 AS speed, n_regionkey * 1.5 AS earth, n_nationkey * 0.5 AS paved FROM nation)
    SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN earth ELSE paved END AS cost FROM lineitem ASOF LEFT JOIN s ON l_quantity >= speed""")
def j9_floor_lookup(t: Tables):
    """Time cost of the largest design speed at or below the speed, by surface."""
    steps = t.nation.select((F.col("n_nationkey") * 3.0 + 5).alias("speed"), (F.col("n_regionkey") * 1.5).alias("earth"), (F.col("n_nationkey") * 0.5).alias("paved"))
    out = lookup.floor_lookup(t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity", "l_returnflag"), "l_quantity", steps, "speed", ["earth", "paved"])
    surface = F.when(F.col("l_returnflag") == "R", "Tierra").otherwise("Asfalto")
    return out.select("k", "n", lookup.surface_cost(surface, F.col("earth"), F.col("earth"), F.col("paved")).alias("cost"))


@query("""WITH f AS (SELECT o_orderkey AS k, 'm' || (o_orderkey % 5) AS port_type, 'm' || (o_orderkey % 7) AS from_mode, 'm' || (o_custkey % 5) AS to_mode FROM orders),
    r AS (SELECT n_nationkey AS seq, 'm' || (n_nationkey % 4) AS one_mode, 'm' || (n_nationkey % 6) AS other_mode, n_nationkey * 0.5 AS tariff_min, n_nationkey * 0.75 AS tariff_max FROM nation),
    h AS (SELECT k, min_by(tariff_min, seq) AS a, min_by(tariff_max, seq) AS b FROM f JOIN r ON (one_mode = port_type AND other_mode = to_mode) OR (one_mode = to_mode AND other_mode = from_mode) OR (one_mode = to_mode AND other_mode = port_type) OR (one_mode = from_mode AND other_mode = to_mode) GROUP BY k)
    SELECT f.k, coalesce(a, 0)::DOUBLE AS tariff_min, coalesce(b, 0)::DOUBLE AS tariff_max FROM f LEFT JOIN h USING (k)""")
def j10_mode_tariffs(t: Tables):
    """The first tariff rule that fits a link's modes."""
    k, n = F.col("o_orderkey"), F.col("n_nationkey")
    m = F.lit("m")
    df = t.orders.select(k.alias("k"), F.concat(m, k % 5).alias("port_type"), F.concat(m, k % 7).alias("from_mode"), F.concat(m, F.col("o_custkey") % 5).alias("to_mode"))
    rules = t.nation.select(n.alias("seq"), F.concat(m, n % 4).alias("one_mode"), F.concat(m, n % 6).alias("other_mode"), (n * 0.5).alias("tariff_min"), (n * 0.75).alias("tariff_max"))
    return lookup.first_rule(df, "k", rules, lookup.MODE_PAIRS, ["tariff_min", "tariff_max"]).select("k", "tariff_min", "tariff_max")


@query("""SELECT p_partkey AS k, coalesce(min_by(n_nationkey + 0.5, n_nationkey), 1)::DOUBLE AS cost FROM part LEFT JOIN nation ON contains(p_name || ' ' || p_type, left(n_name, 2)) GROUP BY p_partkey""")
def j11_substring_lookup(t: Tables):
    """The first line whose name is a part of the edge's line."""
    df = t.part.select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("line"))
    rules = t.nation.select(F.col("n_nationkey").alias("seq"), F.substring("n_name", 1, 2).alias("line"), (F.col("n_nationkey") + 0.5).alias("cost"))
    return lookup.first_contained(df, "k", "line", rules, "line", ["cost"], 1.0).select("k", "cost")


@query("""WITH r AS (SELECT c_custkey AS record, 'st ' || (c_custkey % 150) AS name, c_nationkey AS line, c_nationkey % 5 AS prov FROM customer),
    c AS (SELECT s_suppkey AS node, 'st ' || s_suppkey AS name, s_nationkey AS line, s_nationkey % 5 AS prov FROM supplier),
    h AS (SELECT record, node, 1 AS level FROM r JOIN c USING (name, line, prov) UNION ALL SELECT record, node, 2 FROM r JOIN c USING (name, prov) UNION ALL SELECT record, node, 3 FROM r JOIN c USING (name, line)
        UNION ALL SELECT record, node, 4 FROM r JOIN c ON r.prov = c.prov AND contains(c.name, r.name) UNION ALL SELECT record, node, 5 FROM r JOIN c USING (name) UNION ALL SELECT record, node, 6 FROM r JOIN c ON contains(c.name, r.name)),
    k AS (SELECT *, min(level) OVER (PARTITION BY record) AS best FROM h) SELECT DISTINCT record, node, level::INTEGER AS level FROM k WHERE level = best""")
def j26_station_cascade(t: Tables):
    """Station names to nodes, by six levels of likeness."""
    c, s = F.col("c_nationkey"), F.col("s_nationkey")
    records = t.customer.select(F.col("c_custkey").alias("record"), F.concat(F.lit("st "), F.col("c_custkey") % 150).alias("name"), c.alias("line"), (c % 5).alias("prov"))
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), F.concat(F.lit("st "), "s_suppkey").alias("name"), s.alias("line"), (s % 5).alias("prov"))
    part = ("name", "name", lookup.INSIDE)
    name, line, prov = ("name", "name"), ("line", "line"), ("prov", "prov")
    levels = [([name, line, prov], None), ([name, prov], None), ([name, line], None), ([prov], part), ([name], None), ([], part)]
    return lookup.cascade(records, "record", nodes, levels, "node")


@query("""WITH a AS (SELECT o_orderkey AS record_id, o_orderdate::DATE AS route, o_totalprice AS start_km FROM orders), b AS (SELECT event_id AS place_id, (TIMESTAMP '1992-01-01' + to_days((event_id % 2400)::INTEGER))::DATE AS route, value AS distance FROM events),
    x AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY start_km, record_id) AS k, count(*) OVER (PARTITION BY route) AS n FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY distance, place_id) AS k, count(*) OVER (PARTITION BY route) AS n FROM b)
    SELECT record_id, place_id FROM x JOIN y USING (route, k, n)""")
def j28_pair_in_order(t: Tables):
    """The k-th record of a route with its k-th place."""
    records = t.orders.select(F.col("o_orderkey").alias("record_id"), F.to_date("o_orderdate").alias("route"), F.col("o_totalprice").alias("start_km"))
    places = t.events.select(F.col("event_id").alias("place_id"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("event_id") % 2400).cast("int")).alias("route"), F.col("value").alias("distance"))
    return lookup.pair_in_order(records, places, "route", "start_km", "distance").select("record_id", "place_id")


@query("""WITH r AS (SELECT c_custkey AS record, 'Puerto ' || (c_custkey % 45) AS ref, CASE WHEN c_custkey % 11 = 0 THEN ' Rada ' WHEN c_custkey % 7 = 0 THEN 'Zona ' || (c_custkey % 9) ELSE 'pto ' || (c_custkey % 120) END AS named, 'g' || (c_custkey % 3) AS grp, 'land ' || c_nationkey AS land FROM customer),
    n AS (SELECT 'node_' || s_suppkey AS node, lower('PUERTO ' || s_suppkey) AS name FROM supplier),
    t AS (SELECT lower('Pto ' || (p_partkey % 60)) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'all' ELSE 'g' || (p_partkey % 4) END AS grp, 'Puerto ' || (p_partkey % 50) AS port, p_partkey AS seq FROM part),
    l AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'all' ELSE 'zona ' || (n_nationkey % 9) END AS key, 'land ' || n_nationkey AS land, 'node_' || (n_nationkey + 1) AS node, n_nationkey AS seq FROM nation),
    a AS (SELECT record, lower(ref) AS ref, CASE WHEN trim(lower(named)) = 'rada' THEN 'Unknown' ELSE named END AS named, grp, land FROM r),
    b AS (SELECT record, ref, coalesce((SELECT min_by(port, seq) FROM t WHERE t.key = lower(trim(a.named)) AND t.grp = a.grp), (SELECT min_by(port, seq) FROM t WHERE t.key = lower(trim(a.named)) AND t.grp = 'all'),
        (SELECT min_by(node, seq) FROM l WHERE l.key = lower(trim(a.named))), (SELECT min_by(node, seq) FROM l WHERE l.land = a.land AND l.key = 'all'), named) AS named FROM a),
    p AS (SELECT record, ref, named, lower(trim(named)) AS key, node, name FROM b, n),
    one AS (SELECT record, node, named, 1 AS level FROM p WHERE contains(name, ref) AND (contains(ref, key) OR contains(key, ref) OR named = node)),
    two AS (SELECT record, node, named, 2 AS level FROM p WHERE record NOT IN (SELECT record FROM one) AND (contains(name, key) OR contains(key, name) OR named = node)),
    three AS (SELECT record, node, named, 3 AS level FROM p WHERE record NOT IN (SELECT record FROM one) AND record NOT IN (SELECT record FROM two) AND contains(name, ref))
    SELECT DISTINCT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)""")
def j27_port_cascade(t: Tables):
    """Port names to nodes, after four levels of renaming."""
    c, n, p = F.col("c_custkey"), F.col("n_nationkey"), F.col("p_partkey")
    named = F.when(c % 11 == 0, F.lit(" Rada ")).when(c % 7 == 0, F.concat(F.lit("Zona "), c % 9)).otherwise(F.concat(F.lit("pto "), c % 120))
    records = t.customer.select(c.alias("record"), F.concat(F.lit("Puerto "), c % 45).alias("reference"), named.alias("named"), F.concat(F.lit("g"), c % 3).alias("commodity_group"), F.concat(F.lit("land "), "c_nationkey").alias("country"))
    nodes = t.supplier.select(F.concat(F.lit("node_"), "s_suppkey").alias("node"), F.concat(F.lit("PUERTO "), "s_suppkey").alias("name"))
    renames = t.part.select(F.concat(F.lit("Pto "), p % 60).alias("od_port"), F.when(p % 5 == 0, "All").otherwise(F.concat(F.lit("G"), p % 4)).alias("commodity_group"), F.concat(F.lit("Puerto "), p % 50).alias("port"), p.alias("seq"))
    countries = t.nation.select(F.when(n % 2 == 0, "all").otherwise(F.concat(F.lit("zona "), n % 9)).alias("port_name"), F.concat(F.lit("LAND "), n).alias("country"), F.concat(F.lit("node_"), n + 1).alias("node"), n.alias("seq"))
    return lookup.port_cascade(records, nodes, renames, countries)


@query(f"""WITH {PLACES}, {DEPOTS}, d AS (SELECT point_id, node_id AS marker_id, node_id * 2.0 AS reading, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS d FROM places p JOIN depots n ON p.region = n.region),
    k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, marker_id) AS k FROM d) SELECT point_id, round(min_by(reading + d / 1000, reading), 6)::DOUBLE AS reading_km FROM k WHERE k <= 2 GROUP BY point_id""")
def j29_marker_reading(t: Tables):
    """Km reading of a point from its two nearest markers of the route."""
    markers = depots(t).select(F.col("node_id").alias("marker_id"), "x", "y", F.col("region").alias("route"), (F.col("node_id") * 2.0).alias("reading"))
    return lookup.marker_reading(places(t).withColumnRenamed("region", "route"), markers, "route", 50.0).select("point_id", F.round("reading_km", 6).alias("reading_km"))


@query("""WITH s AS (SELECT o_totalprice / 4 AS speed, max(o_custkey) AS custkey FROM orders GROUP BY 1) SELECT l_orderkey AS k, l_linenumber AS n, custkey FROM lineitem ASOF LEFT JOIN s ON l_extendedprice >= speed""")
def j9_floor_of_many(t: Tables):
    """As many steps as orders: the customer of the dearest order whose quarter is at most a line's price."""
    steps = t.orders.select((F.col("o_totalprice") / 4).alias("speed"), F.col("o_custkey").alias("custkey"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_extendedprice")
    return ordered.as_of(rows, "l_extendedprice", steps, "speed", ["custkey"]).drop("l_extendedprice")


@query("""SELECT l_partkey AS id, max(l_quantity) AS depth FROM lineitem GROUP BY 1""")
def w8_deepest_first(t: Tables):
    """The deepest row of each asset, by numbers and not by text."""
    rows = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("depth"), "l_orderkey", "l_linenumber")
    return lookup.keep_first(rows, ["id"], F.desc("depth"), F.col("l_orderkey"), F.col("l_linenumber")).select("id", "depth")


@query(f"""WITH {OD_LOG} SELECT o_prov, d_prov, sum(tons) AS tons, sum(CASE WHEN kind = 'R' THEN tons ELSE 0 END)::DOUBLE AS returned FROM od GROUP BY 1, 2""")
def a1_province_sums(t: Tables):
    """A1."""
    return od.sum_by(od_log(t).withColumn("returned", F.when(F.col("kind") == "R", F.col("tons")).otherwise(0.0)), ["o_prov", "d_prov"], ["tons", "returned"])


@query(f"""WITH {OD_LOG} SELECT o, d, sum(CASE WHEN kind = 'A' THEN tons ELSE 0 END)::DOUBLE AS A, sum(CASE WHEN kind = 'N' THEN tons ELSE 0 END)::DOUBLE AS N, sum(CASE WHEN kind = 'R' THEN tons ELSE 0 END)::DOUBLE AS R, sum(tons) AS total_tons FROM od GROUP BY 1, 2""")
def a2_od_pivot(t: Tables):
    """A2."""
    return od.od_totals(od_log(t), ["o", "d"], "kind", ["A", "N", "R"])


@query(f"""WITH {OD_LOG}, dd AS (SELECT o, d, kind, day, sum(tons) AS t FROM od GROUP BY ALL), e AS (SELECT o, d, kind, min(t) AS lo, max(t) AS hi FROM dd GROUP BY ALL)
    SELECT o, d, sum(CASE WHEN kind = 'A' THEN lo ELSE 0 END)::DOUBLE AS "min_A", sum(CASE WHEN kind = 'A' THEN hi ELSE 0 END)::DOUBLE AS "max_A", sum(CASE WHEN kind = 'R' THEN lo ELSE 0 END)::DOUBLE AS "min_R", sum(CASE WHEN kind = 'R' THEN hi ELSE 0 END)::DOUBLE AS "max_R",
    sum(lo) AS min_total_tons, sum(hi) AS max_total_tons FROM e GROUP BY 1, 2""")
def a3_daily_range(t: Tables):
    """A3: two-level daily aggregation."""
    return od.daily_range(od_log(t), ["o", "d"], "kind", "day", ["A", "R"])


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def a4_daily_totals(t: Tables):
    """A4: daily sums (of one ton an event)."""
    return od.daily_totals(t.events.withColumn("one", F.lit(1)), "ts", "one").withColumnRenamed("tons", "n")


@query("""SELECT a.n_regionkey AS origin_province, count(*) FILTER (WHERE m = 'rail')::DOUBLE AS rail, count(*) FILTER (WHERE m = 'road')::DOUBLE AS road FROM (SELECT s_nationkey AS k, 'rail' AS m FROM supplier UNION ALL SELECT c_nationkey, 'road' FROM customer) JOIN nation a ON k = n_nationkey GROUP BY 1""")
def a5_u1_combine_modes(t: Tables):
    """Matrices of two modes with different columns as one."""
    region = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("origin_province"))
    rail = t.supplier.select(F.col("s_nationkey").alias("k")).join(region, "k").select("origin_province", F.lit(1.0).alias("rail"))
    road = t.customer.select(F.col("c_nationkey").alias("k")).join(region, "k").select("origin_province", F.lit(1.0).alias("road"))
    return od.combine_modes(rail, road, keys=("origin_province",))


@query("""SELECT road_type, name, count(*) AS n FROM (SELECT 'national' AS road_type, p_brand AS name FROM part WHERE p_size > 10 UNION ALL SELECT 'rural', s_name FROM supplier) GROUP BY 1, 2""")
def u2_stack_layers(t: Tables):
    """Layers with own names and filters under one another."""
    layers = {"national": (t.part, {"p_brand": "name"}, F.col("p_size") > 10), "rural": (t.supplier, {"s_name": "name"}, None)}
    return od.stack_layers(layers, ["name"]).groupBy("road_type", "name").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT l_suppkey AS a, l_returnflag AS b, -1 AS node_id FROM lineitem UNION ALL SELECT -1, '', k FROM (SELECT l_suppkey AS k FROM lineitem UNION SELECT l_partkey FROM lineitem)""")
def u3_u4_distinct(t: Tables):
    """Distinct key tuples; ids of two columns."""
    keys = od.distinct_on(t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_returnflag").alias("b")), ["a", "b"]).withColumn("node_id", F.lit(-1).cast("long"))
    return keys.unionByName(od.ids_of(t.lineitem, "l_suppkey", "l_partkey").select(F.lit(-1).cast("long").alias("a"), F.lit("").alias("b"), "node_id"))


@query(f"""WITH {OD_LOG} SELECT kind, zone, sum(p)::DOUBLE AS production, sum(a)::DOUBLE AS attraction FROM (SELECT kind, o AS zone, tons AS p, 0 AS a FROM od UNION ALL SELECT kind, d, 0, tons FROM od) GROUP BY 1, 2""")
def a27_productions(t: Tables):
    """A27."""
    return od.productions_attractions(od_log(t).withColumnsRenamed({"o": "origin", "d": "destination"}), "kind")


@query("""WITH w AS (SELECT c_nationkey AS zone, c_custkey AS node_id, c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS share FROM customer WHERE c_acctbal > 1000),
    v AS (SELECT s_nationkey AS zone, s_suppkey AS node_id, s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS share FROM supplier WHERE s_acctbal > 1000),
    f AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, 1000.0 + n_nationkey AS tons FROM nation)
    SELECT v.node_id AS origin_id, w.node_id AS destination_id, round(tons * v.share * w.share, 6)::DOUBLE AS tons FROM f JOIN v ON a = v.zone JOIN w ON b = w.zone WHERE v.node_id <> w.node_id""")
def j25_w7_zone_expansion(t: Tables):
    """Zone flows to node pairs by weights normalised in each zone, small nodes left out."""
    o = od.normal_weights(t.supplier.select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("node_id"), "s_acctbal"), "zone", "s_acctbal", 1000)
    d = od.normal_weights(t.customer.select(F.col("c_nationkey").alias("zone"), F.col("c_custkey").alias("node_id"), "c_acctbal"), "zone", "c_acctbal", 1000)
    n = F.col("n_nationkey")
    flows = t.nation.select(n.alias("origin_zone"), ((n + 1) % 25).alias("destination_zone"), (1000.0 + n).alias("tons"))
    # As the SQL rounds doubles: by arithmetic, without a decimal for each of the many rows.
    tons = F.floor(F.col("tons") * 1000000 + 0.5) / 1000000
    return od.expand_to_nodes(flows, o, d).select("origin_id", "destination_id", tons.alias("tons"))
