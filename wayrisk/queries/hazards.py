"""Hazard, risk and adaptation queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayrisk.functions import columns as C
from wayrisk.operators import hazard, stats
from wayrisk.queries.base import HAZARD, Tables, hazard_facts, query

KEYS = ["id", "hazard_type", "model", "climate_scenario", "year"]
WEIGHTS = HAZARD + """, per AS (
    SELECT id, hazard_type, model, climate_scenario, year, probability, min(min_depth) AS min_depth, max(max_depth) AS max_depth, sum(exposure) AS exposure, any_value(edge_length) AS edge_length FROM haz GROUP BY 1, 2, 3, 4, 5, 6),
    cl AS (SELECT *, CASE WHEN 100 * exposure / (1000 * edge_length) > 100 THEN 100 * exposure / (100 * exposure / (1000 * edge_length)) ELSE exposure END AS x, least(100, 100 * exposure / (1000 * edge_length)) AS pc FROM per),
    st AS (SELECT *, least(1, x / 500) AS w, lead(probability) OVER q - probability AS dp, (least(1, x / 500) + least(1, lead(x) OVER q / 500)) / 2 AS mw, (x + lead(x) OVER q) / 2 AS mx FROM cl WINDOW q AS (PARTITION BY id, hazard_type, model, climate_scenario, year ORDER BY probability)),
    wt AS (SELECT id, hazard_type, model, climate_scenario, year, min(min_depth) AS min_flood_depth, max(max_depth) AS max_flood_depth, min(probability) AS min_probability, max(probability) AS max_probability,
        min(x) AS min_exposure_length, max(x) AS max_exposure_length, min(pc)::DOUBLE AS min_exposure_percent, max(pc)::DOUBLE AS max_exposure_percent,
        CASE WHEN count(*) = 1 THEN sum(probability * w) ELSE sum(dp * mw) END AS risk_wt, CASE WHEN count(*) = 1 THEN sum(probability * x) ELSE sum(dp * mx) END AS dam_wt FROM st GROUP BY 1, 2, 3, 4, 5)"""
RISK = WEIGHTS + """, rk AS (
    SELECT wt.*, risk_wt * p_size AS min_eael_per_day, risk_wt * p_size * 2 AS max_eael_per_day, 1000 * 0.5 * dam_wt * 7.3 / 7.3 AS ead FROM wt JOIN part ON id = p_partkey)"""


def weights(t: Tables):
    return hazard.scenario_weights(hazard_facts(t), KEYS, 500)


def risks(t: Tables):
    size = F.col("p_size").cast("double")
    assets = t.part.select(F.col("p_partkey").alias("id"), F.lit(7.3).alias("width"), F.lit(0.5).alias("unit_cost"), size.alias("min_impact"), (2 * size).alias("max_impact"))
    return hazard.risk_table(weights(t), assets)


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(f"""WITH {HAZARD} SELECT id, hazard_type, model, year, sum(exposure) AS exposure FROM haz GROUP BY ALL""")
def a6_sum_of_hits(t: Tables):
    """A6."""
    return hazard.sum_of_hits(hazard_facts(t).select("id", "hazard_type", "model", "year", "exposure"), "exposure")


@query(f"""WITH {WEIGHTS} SELECT id, hazard_type, model, climate_scenario, year, min_flood_depth, max_flood_depth, min_probability, max_probability, round(min_exposure_length, 6) AS min_exposure_length, round(max_exposure_length, 6) AS max_exposure_length,
    round(min_exposure_percent, 6) AS min_exposure_percent, round(max_exposure_percent, 6) AS max_exposure_percent, round(risk_wt, 6) AS risk_wt, round(dam_wt, 5) AS dam_wt FROM wt""")
def a7_a8_p24_p25_weights(t: Tables):
    """Scenario summary and weights of each asset."""
    out = rounded(weights(t), "min_exposure_length", "max_exposure_length", "min_exposure_percent", "max_exposure_percent", "risk_wt")
    return rounded(out, "dam_wt", places=5)


@query(f"""WITH {HAZARD}, p AS (SELECT id, probability AS p, sum(exposure) AS x FROM haz GROUP BY 1, 2), l AS (SELECT *, (lead(p) OVER q - p) * (x + lead(x) OVER q) / 2 AS a FROM p WINDOW q AS (PARTITION BY id ORDER BY p))
    SELECT id, round(CASE WHEN count(*) = 1 THEN sum(p * x) ELSE sum(a) END, 5) AS area FROM l GROUP BY id""")
def w1_trapezoids(t: Tables):
    """Area under exposure by a window."""
    facts = hazard_facts(t).groupBy("id", F.col("probability").alias("p")).agg(F.sum("exposure").alias("x"))
    return rounded(hazard.trapezoids(facts, ["id"], "p", "x"), "area", places=5)


@query(f"""WITH {RISK} SELECT id, climate_scenario, year, min(min_flood_depth) AS min_flood_depth, max(max_flood_depth) AS max_flood_depth, round(min(min_exposure_length), 6) AS min_exposure_length, round(max(max_exposure_length), 6) AS max_exposure_length,
    round(sum(min_eael_per_day), 5) AS min_eael_per_day, round(sum(max_eael_per_day), 5) AS max_eael_per_day, round(sum(ead), 3) AS ead FROM rk GROUP BY 1, 2, 3""")
def p28_a13_combined_risk(t: Tables):
    """EAEL and EAD, and all hazards of an asset together."""
    out = hazard.combined_risk(risks(t), ["id", "climate_scenario", "year"])
    out = rounded(out, "min_eael_per_day", "max_eael_per_day", places=5)
    return rounded(rounded(out, "ead", places=3), "min_exposure_length", "max_exposure_length")


CHANGE = HAZARD + """, g AS (SELECT id, climate_scenario, year, sum(exposure) AS v FROM haz GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER q AS k, first_value(v) OVER q AS v0, first_value(year) OVER q AS y0 FROM g WINDOW q AS (PARTITION BY id ORDER BY year, climate_scenario)),
    ch AS (SELECT id, climate_scenario, year, CASE WHEN y0 = 2016 THEN v0 ELSE 0 END::DOUBLE AS current, v AS future, CASE WHEN y0 = 2016 THEN {diff} ELSE 1e9 END::DOUBLE AS change FROM r WHERE (y0 = 2016 AND k > 1) OR (y0 <> 2016 AND v > 0))"""


def changes(t: Tables, absolute=False):
    by = hazard_facts(t).groupBy("id", "climate_scenario", "year").agg(F.sum("exposure").alias("v"))
    return hazard.climate_change(by, ["id"], "v", absolute=absolute)


@query("WITH " + CHANGE.format(diff="CASE WHEN v0 <> 0 THEN 100 * (v - v0) / v0 END") + " SELECT id, climate_scenario, year, current, future, round(change, 6) AS change FROM ch WHERE change IS NOT NULL")
def w2_climate_change(t: Tables):
    """Percent change from the earliest year."""
    return rounded(changes(t), "change")


@query("WITH " + CHANGE.format(diff="v - v0") + " SELECT * FROM ch")
def w3_absolute_change(t: Tables):
    """W3."""
    return changes(t, absolute=True)


@query("WITH " + CHANGE.format(diff="CASE WHEN v0 <> 0 THEN 100 * (v - v0) / v0 END") + """ SELECT climate_scenario, count(*) AS assets, count(*) FILTER (WHERE future > 900) AS above_value, count(*) FILTER (WHERE future > 900 AND change > 20) AS above_both,
    round(100.0 * count(*) FILTER (WHERE future > 900) / count(*), 6)::DOUBLE AS above_value_percent, round(100.0 * count(*) FILTER (WHERE future > 900 AND change > 20) / count(*), 6)::DOUBLE AS above_both_percent FROM ch GROUP BY 1""")
def a21_change_matrix(t: Tables):
    """A21."""
    return rounded(hazard.change_matrix(changes(t), ["climate_scenario"], "future", "change", 900, 20), "above_value_percent", "above_both_percent")


@query("WITH " + CHANGE.format(diff="CASE WHEN v0 <> 0 THEN 100 * (v - v0) / v0 END") + """ SELECT id, max(current) AS current, max(future) FILTER (WHERE climate_scenario = 'median') AS median_value, round(max(change) FILTER (WHERE climate_scenario = 'median'), 6) AS median_change,
    max(future) FILTER (WHERE climate_scenario = 'high') AS high_value, round(max(change) FILTER (WHERE climate_scenario = 'high'), 6) AS high_change FROM ch GROUP BY id""")
def a22_climate_columns(t: Tables):
    """A22."""
    return rounded(hazard.climate_columns(changes(t), "id", ["median", "high"]), "median_change", "high_change")


@query("""WITH f AS (SELECT p_partkey AS edge_id, p_size::DOUBLE AS min_tr_loss, p_size * 2.0 AS max_tr_loss, p_retailprice AS min_total_tons, p_retailprice + p_partkey % 2 AS max_total_tons FROM part),
    e AS (SELECT l_partkey AS edge_id, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE sum(l_quantity) END AS a, sum(l_quantity) * 2 AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
    j AS (SELECT f.*, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM f LEFT JOIN e USING (edge_id)), k AS (SELECT *, CASE WHEN min_total_tons = max_total_tons AND a = 0 AND b > 0 THEN b ELSE a END AS m FROM j)
    SELECT edge_id, min_tr_loss, max_tr_loss, min_total_tons, max_total_tons, m::DOUBLE AS min_econ_loss, b::DOUBLE AS max_econ_loss, (min_tr_loss + m)::DOUBLE AS min_econ_impact, (max_tr_loss + b)::DOUBLE AS max_econ_impact FROM k""")
def a12_p27_economic_combination(t: Tables):
    """Transport and economic losses of edges."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    flows = t.part.select(k.alias("edge_id"), s.alias("min_tr_loss"), (2 * s).alias("max_tr_loss"), F.col("p_retailprice").alias("min_total_tons"), (F.col("p_retailprice") + k % 2).alias("max_total_tons"))
    q = F.sum("l_quantity")
    losses = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("edge_id")).agg(q.alias("q"))
    losses = losses.select("edge_id", (F.when(F.col("edge_id") % 4 == 0, 0.0).otherwise(F.col("q")) / -1e6).alias("min_total_losses"), (2 * F.col("q") / -1e6).alias("max_total_losses"))
    out = hazard.economic_combination(flows, losses)
    return rounded(out, "min_econ_loss", "max_econ_loss", "min_econ_impact", "max_econ_impact", places=4)


@query(f"""WITH {HAZARD}, n AS (SELECT p_brand AS province, sum(p_size * 100.0)::DOUBLE AS total FROM part GROUP BY 1), h AS (SELECT p_brand AS province, hazard_type, climate_scenario, sum(exposure) AS exposed FROM haz JOIN part ON id = p_partkey GROUP BY 1, 2, 3)
    SELECT province, hazard_type, climate_scenario, exposed, total, round(100 * exposed / total, 6) AS percent FROM h JOIN n USING (province)""")
def a14_exposure_by_boundary(t: Tables):
    """A14."""
    of = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("province"), (F.col("p_size") * 100.0).alias("length"))
    hits = hazard_facts(t).withColumnRenamed("exposure", "length").join(of.select("id", "province"), "id")
    return rounded(hazard.exposure_by_boundary(hits, of, ["province"], ["hazard_type", "climate_scenario"]), "percent")


NATIONAL = HAZARD + """, na AS (SELECT hazard_type, climate_scenario, probability, sum(exposure) AS exposed, sum(exposure) / (SELECT sum(p_size * 100) FROM part) AS f FROM haz GROUP BY 1, 2, 3)"""


@query(f"""WITH {NATIONAL} SELECT hazard_type, climate_scenario, probability, exposed, round(f, 6)::DOUBLE AS percentage_exposure FROM na""")
def a15_national_exposure(t: Tables):
    """A15."""
    network = t.part.select((F.col("p_size") * 100.0).alias("length"))
    out = hazard.national_exposure(hazard_facts(t).withColumnRenamed("exposure", "length"), network, ["hazard_type", "climate_scenario", "probability"])
    return rounded(out, "percentage_exposure")


@query(f"""WITH {HAZARD} SELECT round(1 / probability, 6) AS return_period, sum(CASE WHEN hazard_type = 'A' THEN exposure ELSE 0 END)::DOUBLE AS "A", sum(CASE WHEN hazard_type = 'N' THEN exposure ELSE 0 END)::DOUBLE AS "N", sum(CASE WHEN hazard_type = 'R' THEN exposure ELSE 0 END)::DOUBLE AS "R" FROM haz GROUP BY 1""")
def a16_p41_exposure_pivot(t: Tables):
    """Return periods by hazard."""
    rows = hazard_facts(t).withColumn("return_period", F.round(C.return_period(F.col("probability")), 6))
    return hazard.exposure_pivot(rows, "return_period", "hazard_type", ["A", "N", "R"], "exposure")


@query(f"""WITH {HAZARD}, m AS (SELECT hazard_type, climate_scenario, model, sum(exposure) AS t FROM haz GROUP BY ALL) SELECT hazard_type, climate_scenario, min(t) AS min_length, max(t) AS max_length, round(100 * min(t) / any_value(n), 6) AS min_percent, round(100 * max(t) / any_value(n), 6) AS max_percent FROM m, (SELECT sum(p_size * 100.0::DOUBLE) AS n FROM part) GROUP BY 1, 2""")
def a17_hazard_totals(t: Tables):
    """Against the length of the whole network."""
    network = t.part.agg(F.sum(F.col("p_size") * 100.0)).first()[0]
    return rounded(hazard.hazard_totals(hazard_facts(t).withColumnRenamed("exposure", "length"), network, ["hazard_type", "climate_scenario"]), "min_percent", "max_percent")


@query(f"""WITH {HAZARD} SELECT id, hazard_type, min(probability) AS min_probability, max(probability) AS max_probability, max(exposure) AS exposure FROM haz GROUP BY 1, 2""")
def a20_t4_probability_ranges(t: Tables):
    """A20, T4."""
    return hazard.probability_ranges(hazard_facts(t), ["id", "hazard_type"], "exposure")


@query(f"""WITH {HAZARD} SELECT id, year, min(min_depth) AS min_depth, max(max_depth) AS max_depth FROM haz GROUP BY 1, 2""")
def a23_ranges(t: Tables):
    """A23."""
    return hazard.ranges(hazard_facts(t), ["id", "year"], ["depth"])


@query("""WITH r AS (SELECT l_partkey AS e, sum(l_quantity) AS rail FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), m AS (SELECT l_partkey AS e, sum(l_quantity) AS multi FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    b AS (SELECT coalesce(r.e, m.e) AS e, coalesce(rail, 0) AS rail, coalesce(multi, 0) AS multi FROM r FULL JOIN m ON r.e = m.e), w AS (SELECT p_partkey AS e, k AS s, p_size * k / 8.0 AS wt FROM part, (SELECT unnest([1, 2, 3]) AS k)),
    x AS (SELECT e, s, sum(rail * wt) AS r, sum(multi * wt) AS m FROM b JOIN w USING (e) GROUP BY 1, 2) SELECT e AS edge_id, min(r)::DOUBLE AS min_rail_eael, max(r)::DOUBLE AS max_rail_eael, min(m)::DOUBLE AS min_multi_eael, max(m)::DOUBLE AS max_multi_eael FROM x WHERE e IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY e""")
def a30_multi_modal_comparison(t: Tables):
    """A30."""
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("edge_id"), F.col("l_quantity").alias("loss"))
    w = t.part.select(F.col("p_partkey").alias("edge_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("scenario"), "p_size").withColumn("risk_wt", F.col("p_size") * F.col("scenario") / 8.0)
    flows = t.part.select(F.col("p_partkey").alias("edge_id"), (F.col("p_size") - 10).alias("flow"))
    return hazard.multi_modal_comparison(side("R"), side("A"), w.select("edge_id", "scenario", "risk_wt"), flows)


DISCOUNT = """, y AS (SELECT unnest(range(0, 35)) AS k), ds AS (SELECT sum(1 / pow(1.12, k)) AS plain, sum(pow(1.02, k) / pow(1.12, k)) AS growing, sum(1 / pow(1.12, k)) FILTER (WHERE k > 0 AND k % 8 = 0) AS periodic FROM y)"""


def asset_costs(t: Tables):
    """Adaptation costs of parts as assets: width from size, concrete where the type says so."""
    unit = {"two_lane_concrete": 0.9, "four_lane_concrete": 1.7, "two_lane_asphalt": 0.6, "routine": 0.01, "periodic": 0.08}
    width = (F.col("p_size") % 20).cast("double")
    surface = F.when(F.col("p_partkey") % 3 == 0, "Asfalto,Hormigon").otherwise("Asfalto")
    exposed = F.col("p_size") * 10.0
    d = C.discount_sums(0.12, 0.02, 2016, 2051, 8)
    df = t.part.select(F.col("p_partkey").alias("id"), width.alias("w"), surface.alias("surface"), exposed.alias("exposed"), F.col("p_retailprice").alias("price"), d.alias("d"))
    return df.withColumn("c", C.adaptation_costs(F.col("w"), F.col("surface"), F.col("exposed"), unit, F.col("d.plain"), F.col("d.periodic")))


COSTS = """a AS (SELECT p_partkey AS id, CASE WHEN p_size % 20 = 0 THEN 7.3 ELSE p_size % 20 END::DOUBLE AS w, p_partkey % 3 = 0 AS con, p_size * 10.0::DOUBLE AS exposed, p_retailprice AS price FROM part)""" + DISCOUNT + """,
    n AS (SELECT *, CASE WHEN con AND w > 7.3 THEN 1.7 * w / 14.6 WHEN con THEN 0.9 * w / 7.3 ELSE 0.6 * w / 7.3 END::DOUBLE AS new, plain * 0.01 * w / 7.3 + periodic * 0.08 * w / 7.3 AS upkeep FROM a, ds),
    co AS (SELECT *, CASE WHEN con THEN 'Upgrading to Concrete ' ELSE 'Upgrading to Bituminous ' END || CASE WHEN w <= 3.65 THEN '1L' WHEN w <= 7.3 THEN '2L' WHEN w <= 10.95 THEN '3L' WHEN w <= 14.6 THEN '4L' ELSE '> 4L' END AS option,
        1000 * exposed * new AS initial, 1000 * exposed * new + 1000 * exposed * upkeep AS total, 1e6 * new AS initial_per_km, 1e6 * new + 1e6 * upkeep AS total_per_km FROM n)"""


@query(f"""WITH {COSTS} SELECT id, option, round(initial, 2) AS initial, round(total, 2) AS total, round(initial_per_km, 2) AS initial_per_km, round(total_per_km, 2) AS total_per_km FROM co""")
def p29_p30_adaptation_costs(t: Tables):
    """Discount sums, options and costs."""
    return rounded(asset_costs(t).select("id", "c.*"), "initial", "total", "initial_per_km", "total_per_km", places=2)


@query(f"""WITH {COSTS}, g AS (SELECT unnest([0.0, 0.02, 0.05]) AS growth), gd AS (SELECT growth, sum(pow(1 + growth, k) / pow(1.12, k)) AS gr FROM g, y GROUP BY 1), du AS (SELECT unnest([10, 30, 90]) AS duration)
    SELECT id, duration::INTEGER AS duration, growth::DOUBLE AS growth, round((plain * price * 1000 + price * 1 * duration * gr) / total, 6)::DOUBLE AS min_bc_ratio, round((plain * price * 1000 + price * 3 * duration * gr) / total, 6)::DOUBLE AS max_bc_ratio,
    round(plain * price * 1000 + price * 3 * duration * gr - total, 1)::DOUBLE AS max_bc_diff FROM co, gd, du""")
def p31_p32_benefit_sweep(t: Tables):
    """Benefits and ratios over a grid of duration and growth."""
    assets = asset_costs(t).select("id", (F.col("price") * 1000).alias("ead"), F.col("price").alias("min_eael_per_day"), (3 * F.col("price")).alias("max_eael_per_day"), F.col("c.total").alias("total"))
    out = stats.sweep(assets, [10, 30, 90], [0.0, 0.02, 0.05], 0.12, 2016, 2051)
    out = rounded(out, "min_bc_ratio", "max_bc_ratio")
    return rounded(out, "max_bc_diff", places=1).select("id", "duration", "growth", "min_bc_ratio", "max_bc_ratio", "max_bc_diff")


RATIOS = """rs AS (SELECT l_partkey AS id, l_linenumber AS duration, l_tax AS growth, l_quantity / 20 AS max_bc_ratio, l_quantity / 40 AS min_bc_ratio, (l_partkey % 50)::DOUBLE AS length FROM lineitem)"""


def ratios(t: Tables):
    return t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("duration"), F.col("l_tax").alias("growth"), (F.col("l_quantity") / 20).alias("max_bc_ratio"), (F.col("l_quantity") / 40).alias("min_bc_ratio"), (F.col("l_partkey") % 50).cast("double").alias("length"))


@query(f"""WITH {RATIOS}, b AS (SELECT id, duration, growth, max(max_bc_ratio) AS hi, max(min_bc_ratio) AS lo, max(length) AS km FROM rs GROUP BY 1, 2, 3)
    SELECT duration, growth, count(*) FILTER (WHERE hi > 1) AS max_count, round(100 * count(*) FILTER (WHERE hi > 1) / (SELECT count(*)::DOUBLE FROM part), 6)::DOUBLE AS max_percent, coalesce(sum(km) FILTER (WHERE hi > 1), 0)::DOUBLE AS max_km,
    count(*) FILTER (WHERE lo > 1) AS min_count, round(100 * count(*) FILTER (WHERE lo > 1) / (SELECT count(*)::DOUBLE FROM part), 6)::DOUBLE AS min_percent, coalesce(sum(km) FILTER (WHERE lo > 1), 0)::DOUBLE AS min_km FROM b GROUP BY 1, 2""")
def a24_sensitivity(t: Tables):
    """A24."""
    return rounded(stats.sensitivity(ratios(t), t.part.count()), "max_percent", "min_percent")


@query("""WITH s AS (SELECT l_partkey AS id, max(l_quantity / 40) FILTER (WHERE l_linenumber <= 3) AS b, max(l_quantity / 40) FILTER (WHERE l_linenumber BETWEEN 4 AND 5) AS s FROM lineitem GROUP BY 1), c AS (SELECT coalesce(b, 0) AS b, coalesce(s, 0) AS s FROM s)
    SELECT count(*) FILTER (WHERE b = s) AS equal, count(*) FILTER (WHERE s > b) AS up, count(*) FILTER (WHERE s < b) AS down, count(*) FILTER (WHERE b < 1 AND s >= 1) AS over_1_up, count(*) FILTER (WHERE b >= 1 AND s < 1) AS over_1_down FROM c""")
def a25_ratio_transitions(t: Tables):
    """A25."""
    rows = hazard_facts(t).withColumn("ratio", F.col("exposure") / 400)
    return stats.ratio_transitions(rows, "id", "baseline", "median", "ratio")


@query("""WITH r AS (SELECT l_partkey AS id, l_returnflag AS mode, l_orderkey * 8 + l_linenumber AS u, l_quantity + l_orderkey / 1048576.0 AS bc_ratio, l_quantity AS cost, l_quantity * 2 AS benefit FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY mode, id ORDER BY bc_ratio DESC, cost) AS n FROM r)
    SELECT mode, id, sum(cost) OVER q AS investment, sum(benefit) OVER q AS total_benefit FROM k WHERE n = 1 AND bc_ratio >= 30 WINDOW q AS (PARTITION BY mode ORDER BY bc_ratio DESC, id ROWS UNBOUNDED PRECEDING)""")
def w4_investment_curve(t: Tables):
    """W4."""
    return curve(t).select("mode", "id", "investment", "total_benefit")


def curve(t: Tables):
    rows = t.lineitem.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("mode"), (F.col("l_quantity") + F.col("l_orderkey") / 1048576).alias("bc_ratio"), F.col("l_quantity").alias("cost"), (F.col("l_quantity") * 2).alias("benefit"))
    return stats.investment_curve(rows, ["mode"], 30.0)


@query("""WITH r AS (SELECT l_partkey AS id, l_returnflag AS mode, l_quantity + l_orderkey / 1048576.0 AS bc_ratio, l_quantity AS cost FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY mode, id ORDER BY bc_ratio DESC, cost) AS n FROM r)
    SELECT mode, sum(cost) * 3 AS total_cost, sum(cost) * 2 AS total_benefit, sum(cost) AS investment FROM k WHERE n = 1 AND bc_ratio >= 30 GROUP BY mode""")
def a33_largest_totals(t: Tables):
    """The ends of the investment curves."""
    return stats.largest_totals(curve(t).withColumn("total_cost", F.col("investment") + F.col("total_benefit")), "mode")
