"""End-to-end chains of operators (survey section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.functions import columns as C
from wayrisk.operators import hazard, joins, od, routing, spatial, stats


def edge_flows_of_zones(flows: DataFrame, origins: DataFrame, destinations: DataFrame, edges: DataFrame, least_daily_tons: float = 0.5) -> DataFrame:
    """Zone flows a year to flows on edges: node pairs, daily totals above a least, paths at least and largest cost, edge sums, ranked.

    edges: edge_id, from_node, to_node, min_gcost, max_gcost.
    """
    pairs = od.expand_to_nodes(flows, origins, destinations)
    daily = pairs.groupBy("origin_id", "destination_id").agg(C.per_day(F.sum("tons")).alias("tons")).where(F.col("tons") > least_daily_tons)
    paths = routing.od_path_assembly(daily, edges).withColumns({"min_total_tons": F.col("tons"), "max_total_tons": F.col("tons")})
    summed = routing.min_max_edge_flows(paths, edges.select("edge_id"), ["total_tons"])
    return summed.orderBy(F.desc("max_total_tons"), "edge_id")


def climate_risks(lines: DataFrame, polygons: DataFrame, scenarios: DataFrame, assets: DataFrame, tile: float, threshold: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """Network and flood polygons to risks and their change: clip, weights, EAEL and EAD, all hazards together, change from today.

    scenarios: poly_id, hazard_type, model, climate_scenario, year, probability, min_depth, max_depth;
    assets: id, edge_length (km), width, unit_cost, min_impact, max_impact.
    """
    hits = spatial.line_hits(lines, polygons, tile).join(scenarios, "poly_id").withColumnsRenamed({"edge_id": "id", "length": "exposure"})
    facts = hits.join(assets.select("id", "edge_length"), "id").drop("poly_id")
    keys = ["id", "hazard_type", "model", "climate_scenario", "year"]
    risks = hazard.risk_table(hazard.scenario_weights(facts, keys, threshold), assets.drop("edge_length"))
    together = hazard.combined_risk(risks, ["id", "climate_scenario", "year"])
    return together, hazard.climate_change(together, ["id"], "ead")


def failure_losses(hits: DataFrame, flows: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Hazard hits to losses of single-edge failures: the failure set, rerouting, losses by edge and access."""
    failed = routing.failure_set(hits, flows, "tons")
    scenarios = failed.select(F.col("edge_id").cast("string").alias("scenario_id"), F.col("edge_id").cast("string").alias("edge_id"))
    rows = routing.rerouting_losses(routing.failures(scenarios, paths, edges))
    return rows.groupBy(F.col("scenario_id").alias("edge_id"), "no_access").agg(F.sum("tons").alias("tons"), F.sum("tr_loss").alias("tr_loss"))


def adaptation_report(risks: DataFrame, costs: DataFrame, durations: list[int], growths: list[float], rate: float, start: int, end: int) -> DataFrame:
    """Risks and costs to the investment curve of each duration: the benefit sweep, the best ratio of each asset, running sums."""
    swept = stats.sweep(joins.left_fill(costs, risks, ["id"]), durations, growths, rate, start, end)
    best = swept.select("id", "duration", F.col("max_bc_ratio").alias("bc_ratio"), F.col("total").alias("cost"), F.col("max_benefit").alias("benefit"))
    return stats.investment_curve(best, ["duration"])
