"""Statistics, rankings and economy tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayrisk.functions import columns as C
from wayrisk.operators import macro, stats
from wayrisk.queries.base import BOXES, EDGES, OD_LOG, PLACES, Tables, boxes, od_log, places, query, road_edges


@query(f"""WITH {EDGES} SELECT 'brand' AS attribute, brand AS value, count(*) AS n, sum(length) AS length FROM edges GROUP BY brand UNION ALL SELECT 'kind', kind, count(*), sum(length) FROM edges GROUP BY kind""")
def a18_network_statistics(t: Tables):
    """Counts and lengths by brand and by kind in one pass."""
    return stats.network_statistics(road_edges(t), ["brand", "kind"])


@query(f"""WITH {EDGES} SELECT brand, kind, count(*) AS n, sum(length) AS length FROM edges GROUP BY 1, 2""")
def a19_by_boundary(t: Tables):
    """A19."""
    return stats.by_boundary(road_edges(t), ["brand", "kind"])


@query("""SELECT round(100.0 * avg(CASE WHEN l_suppkey % 3 <> l_partkey % 3 THEN 1 ELSE 0 END), 6) AS percent FROM lineitem""")
def a26_differing_paths(t: Tables):
    """A26."""
    df = t.lineitem.select((F.col("l_suppkey") % 3).alias("a"), (F.col("l_partkey") % 3).alias("b"))
    return stats.differing_share(df, "a", "b").select(F.round("percent", 6).alias("percent"))


@query(f"""WITH {PLACES}, {BOXES} SELECT poly_id AS box_id, count(point_id) AS n FROM boxes LEFT JOIN places ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def a29_points_in_boxes(t: Tables):
    """A29."""
    return stats.points_in_boxes(places(t), boxes(t).withColumnRenamed("poly_id", "box_id"), 25.0)


@query("""WITH f AS (SELECT l_suppkey, sum(l_quantity) AS flow, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(regr_slope(ln(flow), ln(n)), 6) AS slope, round(regr_intercept(ln(flow), ln(n)), 6) AS intercept, round(regr_r2(ln(flow), ln(n)), 6) AS r2,
    round(var_pop(ln(flow)) * (1 - regr_r2(ln(flow), ln(n))), 6) AS mse FROM f""")
def a31_log_regression(t: Tables):
    """Flow on count, both in logarithms."""
    f = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("flow"), F.count("*").alias("n"))
    return stats.log_regression(f, "n", "flow").select(*(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "mse")))


@query("""WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey AS k, CASE WHEN hi > lo THEN least(8, floor((p_retailprice - lo) * 9 / (hi - lo))) ELSE 0 END::INTEGER AS bin FROM part, e""")
def a32_weight_bins(t: Tables):
    """A32."""
    return stats.weight_bins(t.part, "p_retailprice", 9).select(F.col("p_partkey").alias("k"), "bin")


@query("""WITH r AS (SELECT c_custkey AS k, c_mktsegment AS mode, least(c_acctbal, c_custkey::DOUBLE) AS lo0, greatest(c_acctbal, c_custkey::DOUBLE) AS hi0 FROM customer)
    SELECT k, mode, lo0 AS lo, hi0 AS hi, round(100.0 * (row_number() OVER (PARTITION BY mode ORDER BY hi0, k) - 1) / count(*) OVER (PARTITION BY mode), 6)::DOUBLE AS percentile FROM r""")
def w5_percentile_curve(t: Tables):
    """Percentile ranks within a mode."""
    df = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("mode"), F.col("c_acctbal").alias("lo"), F.col("c_custkey").cast("double").alias("hi"))
    return stats.percentile_curve(df, ["mode"], "lo", "hi", "k").withColumn("percentile", F.round("percentile", 6))


@query("""SELECT l_returnflag AS mode, l_suppkey AS edge_id, sum(l_quantity) AS flow, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, l_suppkey)::INTEGER AS rank FROM lineitem GROUP BY 1, 2""")
def t1_ranked_flows(t: Tables):
    """T1."""
    f = t.lineitem.groupBy(F.col("l_returnflag").alias("mode"), F.col("l_suppkey").alias("edge_id")).agg(F.sum("l_quantity").alias("flow"))
    return stats.ranked(f, ["mode"], "flow", "edge_id")


@query("""SELECT l_partkey AS id, sum(l_quantity) AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, id LIMIT 50""")
def t2_top_50(t: Tables):
    """T2."""
    f = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("value"))
    return stats.top(f, 50, F.col("value"), "id")


@query("""SELECT l_partkey AS id, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r, (coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) + coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0))::DOUBLE AS row_total FROM lineitem GROUP BY 1""")
def t3_row_totals(t: Tables):
    """T3."""
    f = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(*(F.sum(F.when(F.col("l_returnflag") == x, F.col("l_quantity"))).alias(x.lower()) for x in "AR"))
    return stats.by_row_total(f, ["a", "r"], "id")


CELLS = OD_LOG + """, cells AS (SELECT o AS row, d AS col, sum(tons) AS value FROM od GROUP BY 1, 2)"""


def cells(t: Tables):
    return od_log(t).groupBy(F.col("o").alias("row"), F.col("d").alias("col")).agg(F.sum("tons").alias("value"))


@query(f"""WITH {CELLS} SELECT a.n_regionkey AS row_sector, b.n_regionkey AS col_sector, sum(value) AS value FROM cells JOIN nation a ON row = a.n_nationkey JOIN nation b ON col = b.n_nationkey GROUP BY 1, 2""")
def m1_sectors(t: Tables):
    """M1."""
    look = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("sector"))
    return macro.to_sectors(cells(t), look, look)


@query(f"""WITH {CELLS} SELECT row, col, round(value / sum(value) OVER (PARTITION BY col), 9) AS a FROM cells""")
def m2_coefficients(t: Tables):
    """M2."""
    return macro.technical_coefficients(cells(t)).withColumn("a", F.round("a", 9))


@query(f"""WITH {CELLS}, f AS (SELECT c_nationkey AS row, count(*)::DOUBLE AS value FROM customer GROUP BY 1) SELECT row, sum(value) AS total FROM (SELECT row, value FROM cells UNION ALL SELECT row, value FROM f) GROUP BY row""")
def m2_m7_totals(t: Tables):
    """M2, M7: base output as row sums of intermediate use and final demand."""
    final = t.customer.groupBy(F.col("c_nationkey").alias("row")).agg(F.count("*").cast("double").alias("value"))
    return macro.totals(cells(t), final)


@query(f"""WITH {CELLS} SELECT x.row, y.col, sum(x.value * y.value) AS value FROM cells x JOIN cells y ON x.col = y.row GROUP BY 1, 2""")
def m3_product(t: Tables):
    """M3: the product of the table with itself."""
    c = cells(t)
    return macro.product(c.withColumnRenamed("col", "k"), c.withColumnRenamed("row", "k"))


@query(f"""WITH {CELLS} SELECT row, col, value, round(value / sum(value) OVER (PARTITION BY row), 9) AS share FROM cells""")
def m4_shares(t: Tables):
    """M4."""
    return macro.shares_of(cells(t), ["row"]).withColumn("share", F.round("share", 9))


FLOW = OD_LOG + """, tr AS (SELECT o_prov AS origin, d_prov AS destination, kind AS sector, sum(tons) AS value FROM od GROUP BY 1, 2, 3)"""


def sector_flows(t: Tables):
    return od_log(t).groupBy(F.col("o_prov").alias("origin"), F.col("d_prov").alias("destination"), F.col("kind").alias("sector")).agg(F.sum("tons").alias("value"))


@query(f"""WITH {FLOW}, q AS (SELECT origin AS region, sector, sum(value) AS output FROM tr GROUP BY 1, 2), s AS (SELECT *, value / sum(value) OVER (PARTITION BY destination, sector) AS share FROM tr)
    SELECT origin, destination, s.sector, round(share * least(a.output, b.output), 5) AS trade FROM s JOIN q a ON origin = a.region AND s.sector = a.sector JOIN q b ON destination = b.region AND s.sector = b.sector""")
def m5_trade_proxy(t: Tables):
    """M5."""
    f = sector_flows(t)
    output = f.groupBy(F.col("origin").alias("region"), "sector").agg(F.sum("value").alias("output"))
    return macro.trade_proxy(f, output).withColumn("trade", F.round("trade", 5))


@query(f"""WITH {CELLS} SELECT 'row' AS axis, row AS k, round(sum(value) * 1.25, 2) AS total FROM cells GROUP BY row UNION ALL SELECT 'col', col, round(sum(value) * 1.25, 2) FROM cells GROUP BY col""")
def m6_balance(t: Tables):
    """M6: the table balanced to 1.25 times its totals from a distorted start; its row and column sums are returned."""
    c = cells(t).checkpoint()
    rows = c.groupBy("row").agg((F.sum("value") * 1.25).alias("total"))
    cols = c.groupBy("col").agg((F.sum("value") * 1.25).alias("total"))
    start = c.withColumn("value", F.col("value") * (1 + (F.col("row") * 7 + F.col("col") * 3) % 5))
    out = macro.balance(start, rows, cols, 1e-9).checkpoint()
    sums = [out.groupBy(F.col(a).alias("k")).agg(F.sum("value").alias("t")).select(F.lit(a).alias("axis"), "k", F.round("t", 2).alias("total")) for a in ("row", "col")]
    return sums[0].unionByName(sums[1])


def balance_sql(rounds: int = 40) -> str:
    """Rounds of row and column scaling of a table without negative cells, written out."""
    out = """start AS MATERIALIZED (SELECT row, col, value * (1 + (row * 7 + col * 3) % 5) AS p FROM cells), rt AS (SELECT row, sum(value) * 1.25 AS t FROM cells GROUP BY row), ct AS (SELECT col, sum(value) * 1.25 AS t FROM cells GROUP BY col),
        s0 AS MATERIALIZED (SELECT col, 1.0::DOUBLE AS s FROM ct)"""
    for i in range(rounds):
        out += f""", r{i + 1} AS MATERIALIZED (SELECT p.row, any_value(rt.t) / sum(p.p * s.s) AS r FROM start p JOIN s{i} s ON p.col = s.col JOIN rt ON p.row = rt.row GROUP BY p.row),
        s{i + 1} AS MATERIALIZED (SELECT p.col, any_value(ct.t) / sum(p.p * r.r) AS s FROM start p JOIN r{i + 1} r ON p.row = r.row JOIN ct ON p.col = ct.col GROUP BY p.col)"""
    return out + f", balanced AS (SELECT p.row, p.col, p.p * r.r * s.s AS value FROM start p JOIN r{rounds} r ON p.row = r.row JOIN s{rounds} s ON p.col = s.col)"


@query(f"""WITH {CELLS}, {balance_sql()} SELECT row, col, round(value, 4) AS value FROM balanced""")
def m6_cells(t: Tables):
    """M6: the cells of the balanced table."""
    c = cells(t).checkpoint()
    rows = c.groupBy("row").agg((F.sum("value") * 1.25).alias("total"))
    cols = c.groupBy("col").agg((F.sum("value") * 1.25).alias("total"))
    start = c.withColumn("value", F.col("value") * (1 + (F.col("row") * 7 + F.col("col") * 3) % 5))
    return macro.balance(start, rows, cols, 1e-11).select("row", "col", F.round("value", 4).alias("value"))


@query(f"""WITH {FLOW}, b AS (SELECT origin AS region, destination AS other, sector, sum(value) AS trade FROM tr WHERE origin <> destination GROUP BY 1, 2, 3)
    SELECT region, other, sector, trade, round(trade / sum(trade) OVER (PARTITION BY other, sector), 9) AS import_share FROM b""")
def m8_trade(t: Tables):
    """M8: trade between regions and import shares."""
    f = sector_flows(t).select(F.col("origin").alias("row_region"), F.col("destination").alias("col_region"), F.col("sector").alias("row_sector"), "value")
    return macro.regional_trade(f).withColumn("import_share", F.round("import_share", 9))


@query(f"""WITH {FLOW}, b AS (SELECT * FROM tr WHERE origin <> destination) SELECT region, sector, sum(e)::DOUBLE AS exports, sum(i)::DOUBLE AS imports FROM (SELECT origin AS region, sector, value AS e, 0 AS i FROM b UNION ALL SELECT destination, sector, 0, value FROM b) GROUP BY 1, 2""")
def m8_totals(t: Tables):
    """M8: exports and imports."""
    f = sector_flows(t).select(F.col("origin").alias("row_region"), F.col("destination").alias("col_region"), F.col("sector").alias("row_sector"), "value")
    return macro.total_trade(macro.regional_trade(f))


SHOCK = OD_LOG + """, od2 AS (SELECT d_prov AS destination, kind AS sector, o AS event, tons FROM od), tot AS (SELECT destination, sector, sum(tons) AS t FROM od2 GROUP BY 1, 2), lost AS (SELECT event, destination, sector, sum(tons) AS f FROM od2 GROUP BY 1, 2, 3),
    sh AS (SELECT event, destination, sector, greatest(0.8, 1 - f / t)::DOUBLE AS shock FROM lost JOIN tot USING (destination, sector)), per AS (SELECT event, min(shock) AS m, round(sum(shock), 9) AS s FROM sh GROUP BY 1),
    kept AS (SELECT event, min(event) OVER (PARTITION BY s) AS same_as FROM per WHERE m <= 0.95)"""


def shocks(t: Tables):
    f = od_log(t).select(F.col("o").alias("event"), F.col("d_prov").alias("destination"), F.col("kind").alias("sector"), "tons")
    return macro.supply_shocks(f, f)


@query(f"""WITH {SHOCK} SELECT event, destination, sector, round(shock, 9) AS shock, same_as FROM sh JOIN kept USING (event)""")
def m9_supply_shocks(t: Tables):
    """M9."""
    return shocks(t).select("event", "destination", "sector", F.round("shock", 9).alias("shock"), "same_as")


@query(f"""WITH {SHOCK} SELECT event, destination AS region, round(sum(-(1 - shock) * t) / 365, 6) AS loss_per_day FROM sh JOIN kept USING (event) JOIN tot USING (destination, sector) GROUP BY 1, 2""")
def m10_direct_losses(t: Tables):
    """M10."""
    base = od_log(t).groupBy(F.col("d_prov").alias("region"), F.col("kind").alias("sector")).agg(F.sum("tons").alias("output"))
    return macro.losses_per_day(macro.direct_losses(shocks(t), base)).withColumn("loss_per_day", F.round("loss_per_day", 6))


@query("""SELECT p_partkey AS k, round(CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 0.01 * p_retailprice * 12 END, 6)::DOUBLE AS scaled, (p_partkey % 4 > 0) AS kept, p_brand || '|' || p_type AS both FROM part""")
def p1_p9_p12_x_columns(t: Tables):
    """Tidy names, percent scaling, a record rule, and several columns from one struct."""
    from wayrisk.operators import joins

    df = C.tidy_columns(t.part.withColumnRenamed("p_retailprice", " P_Price "), {"p_partkey": "k", "p_price": "value"}, ["k", "value", "p_brand", "p_type"])
    df = C.scaled(df.withColumn("scaled", F.when(F.col("k") % 4 == 0, 0.0).otherwise(F.col("value"))), ["scaled"], 0.12)
    df = joins.transform_records(df, lambda x: x.withColumn("scaled", F.round("scaled", 6)), F.col("value").isNotNull())
    pair = F.struct((F.col("k") % 4 > 0).alias("kept"), F.concat_ws("|", C.province_name(F.col("p_brand")), "p_type").alias("both"))
    return joins.spread(df, pair).select("k", "scaled", "kept", "both")
