"""Hazard scenarios, weights and risk (survey rows A6-A17, A20-A23, A30, W1-W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions import columns as C


def sum_of_hits(hits: DataFrame, length: str = "length") -> DataFrame:
    """Hits that agree in everything but length, as one."""
    return hits.groupBy(*(c for c in hits.columns if c != length)).agg(F.sum(length).alias(length))


def scenario_weights(facts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """By asset and scenario, depth and probability ranges, exposure ranges, and risk and damage weights.

    facts: keys, probability, min_depth, max_depth, exposure (m) and edge_length
    (km). A weight is the area under the exposure (or its share of the
    threshold) over ascending probability by trapezoids; with one probability it
    is p times the value. Of several edge lengths of one key and probability
    the smallest counts. Each of the two steps has its own exchange; both
    combine before it.
    """
    per = facts.groupBy(*keys, "probability").agg(F.min("min_depth").alias("min_depth"), F.max("max_depth").alias("max_depth"), F.sum("exposure").alias("exposure"), F.min("edge_length").alias("edge_length"))
    e = C.clamp_exposure(F.col("exposure"), C.exposure_percent(F.col("exposure"), F.col("edge_length")), threshold)
    per = per.withColumn("_e", e)
    points = F.sort_array(F.collect_list(F.struct(F.col("probability").alias("p"), F.col("_e.weight").alias("w"), F.col("_e.exposure").alias("x"))))
    out = per.groupBy(*keys).agg(
        F.min("min_depth").alias("min_flood_depth"),
        F.max("max_depth").alias("max_flood_depth"),
        F.min("probability").alias("min_probability"),
        F.max("probability").alias("max_probability"),
        F.min("_e.exposure").alias("min_exposure_length"),
        F.max("_e.exposure").alias("max_exposure_length"),
        F.min("_e.percent").alias("min_exposure_percent"),
        F.max("_e.percent").alias("max_exposure_percent"),
        points.alias("_points"),
    )

    def area(field):
        steps = F.sequence(F.lit(1), F.size("_points") - 1)
        one = F.col("_points")[0]
        pieces = F.transform(steps, lambda i: (F.col("_points")[i]["p"] - F.col("_points")[i - 1]["p"]) * (F.col("_points")[i]["%s" % field] + F.col("_points")[i - 1]["%s" % field]) / 2)
        return F.when(F.size("_points") == 1, one["p"] * one[field]).otherwise(F.aggregate(pieces, F.lit(0.0), lambda s, v: s + v))

    return out.withColumn("risk_wt", area("w")).withColumn("dam_wt", area("x")).drop("_points")


def trapezoids(facts: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under y over ascending x by a window; for keys with more points than an array should hold."""
    w = Window.partitionBy(*keys).orderBy(x)
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    steps = facts.withColumn("_a", (nx - F.col(x)) * (F.col(y) + ny) / 2)
    return steps.groupBy(*keys).agg(F.when(F.count("*") == 1, F.sum(F.col(x) * F.col(y))).otherwise(F.sum("_a")).alias("area"))


def risk_table(weights: DataFrame, assets: DataFrame, key: str = "id", bridge: bool = False) -> DataFrame:
    """EAEL a day and EAD of each asset and scenario. assets: id, width, unit_cost, min_impact, max_impact."""
    joined = weights.join(assets, key)
    damage = C.ead(F.col("unit_cost"), F.col("risk_wt") if bridge else F.col("dam_wt"), F.col("width"), bridge)
    return joined.withColumns({"min_eael_per_day": C.eael_per_day(F.col("risk_wt"), F.col("min_impact")), "max_eael_per_day": C.eael_per_day(F.col("risk_wt"), F.col("max_impact")), "ead": damage})


def combined_risk(risks: DataFrame, keys: list[str]) -> DataFrame:
    """Risks of several hazards together, in one aggregation: ranges of depth and exposure, sums of EAEL and EAD."""
    return risks.groupBy(*keys).agg(
        F.min("min_flood_depth").alias("min_flood_depth"),
        F.max("max_flood_depth").alias("max_flood_depth"),
        F.min("min_exposure_length").alias("min_exposure_length"),
        F.max("max_exposure_length").alias("max_exposure_length"),
        F.sum("min_eael_per_day").alias("min_eael_per_day"),
        F.sum("max_eael_per_day").alias("max_eael_per_day"),
        F.sum("ead").alias("ead"),
    )


def climate_change(risks: DataFrame, keys: list[str], value: str, base_year: int = 2016, sentinel: float = 1e9, on_undefined: str = "drop", absolute: bool = False) -> DataFrame:
    """Current (earliest year) against each later scenario.

    Groups without a row of base_year have current 0, the sentinel as change,
    and only positive values; groups with base_year alone give nothing.
    absolute: difference instead of percent. Undefined changes are dropped or 0.
    """
    w = Window.partitionBy(*keys).orderBy("year", "climate_scenario")
    ranked = risks.withColumn("_k", F.row_number().over(w)).withColumn("_v", F.first(value).over(w)).withColumn("_y", F.first("year").over(w))
    based = F.col("_y") == base_year
    current = F.when(based, F.col("_v")).otherwise(0.0)
    diff = F.col(value) - F.col("_v")
    change = diff if absolute else F.when(F.col("_v") != 0, 100 * diff / F.col("_v"))
    change = F.when(based, change).otherwise(F.lit(float(sentinel)))
    if on_undefined == "zero":
        change = F.coalesce(change, F.lit(0.0))
    out = ranked.where((based & (F.col("_k") > 1)) | (~based & (F.col(value) > 0)))
    out = out.select(*keys, "climate_scenario", "year", current.alias("current"), F.col(value).alias("future"), change.alias("change"))
    return out.where(F.col("change").isNotNull())


def economic_combination(flows: DataFrame, losses: DataFrame) -> DataFrame:
    """Rerouting losses of edges with economic ones (given in negative millions), pairs in order, impact their sum.

    flows: edge_id, min_tr_loss, max_tr_loss, min_total_tons, max_total_tons; losses: edge_id, min_total_losses, max_total_losses.
    """
    econ = losses.select("edge_id", *((F.col(f"{m}_total_losses") * -1e6).alias(f"{m}_econ_loss") for m in ("min", "max")))
    econ = econ.where("min_econ_loss > 0 or max_econ_loss > 0")
    joined = C.order_all_pairs(flows.join(econ, "edge_id", "left").fillna(0, subset=["min_econ_loss", "max_econ_loss"]))
    lo = C.corrected_min_loss(F.col("min_total_tons"), F.col("max_total_tons"), F.col("min_econ_loss"), F.col("max_econ_loss"))
    joined = joined.withColumn("min_econ_loss", lo)
    return joined.withColumns({f"{m}_econ_impact": F.col(f"{m}_tr_loss") + F.col(f"{m}_econ_loss") for m in ("min", "max")})


def exposure_by_boundary(hits: DataFrame, network: DataFrame, boundary: list[str], scenario: list[str]) -> DataFrame:
    """Exposed length by boundary and scenario, with its share (in percent) of the boundary's network."""
    exposed = hits.groupBy(*boundary, *scenario).agg(F.sum("length").alias("exposed"))
    total = network.groupBy(*boundary).agg(F.sum("length").alias("total"))
    return exposed.join(total, boundary).withColumn("percent", F.when(F.col("total") > 0, 100 * F.col("exposed") / F.col("total")))


def national_exposure(hits: DataFrame, network: DataFrame, scenario: list[str]) -> DataFrame:
    """Exposed length by scenario and its share of the network (a fraction, as reported)."""
    total = network.agg(F.sum("length").alias("_total"))
    out = hits.groupBy(*scenario).agg(F.sum("length").alias("exposed")).join(F.broadcast(total))
    return out.withColumn("percentage_exposure", F.col("exposed") / F.col("_total")).drop("_total")


def exposure_pivot(exposure: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """A column for each hazard scenario, missing 0."""
    return exposure.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0.0)


def hazard_totals(hits: DataFrame, network_length: float, keys: list[str], model: str = "model") -> DataFrame:
    """Sums by model, then the least and the largest model, with shares of the network."""
    by_model = hits.groupBy(*keys, model).agg(F.sum("length").alias("t"))
    out = by_model.groupBy(*keys).agg(F.min("t").alias("min_length"), F.max("t").alias("max_length"))
    return out.withColumns({f"{m}_percent": 100 * F.col(f"{m}_length") / network_length for m in ("min", "max")})


def probability_ranges(hits: DataFrame, keys: list[str], flow: str) -> DataFrame:
    """Probability range by node and scenario, by flow descending then keys."""
    out = hits.groupBy(*keys).agg(F.min("probability").alias("min_probability"), F.max("probability").alias("max_probability"), F.max(flow).alias(flow))
    return out.orderBy(F.desc(flow), *keys)


def change_matrix(changes: DataFrame, keys: list[str], value: str, change: str, value_threshold: float, change_threshold: float) -> DataFrame:
    """Counts and percents of assets above a value, and above a change, in one aggregation."""
    big, grown = F.col(value) > value_threshold, F.col(change) > change_threshold
    n = F.count("*")
    return changes.groupBy(*keys).agg(
        n.alias("assets"), F.count_if(big).alias("above_value"), F.count_if(big & grown).alias("above_both"), (100 * F.count_if(big) / n).alias("above_value_percent"), (100 * F.count_if(big & grown) / n).alias("above_both_percent")
    )


def climate_columns(changes: DataFrame, key: str, scenarios: list[str]) -> DataFrame:
    """Per asset `current`, and for each scenario its value and change."""
    per = [F.max(F.when(F.col("climate_scenario") == s, F.col(c))).alias(f"{s}_{n}") for s in scenarios for n, c in (("value", "future"), ("change", "change"))]
    return changes.groupBy(key).agg(F.max("current").alias("current"), *per)


def ranges(df: DataFrame, keys: list[str], stems: list[str]) -> DataFrame:
    """Least minimum and largest maximum by asset."""
    return df.groupBy(*keys).agg(*(f.alias(n) for s in stems for f, n in ((F.min(f"min_{s}"), f"min_{s}"), (F.max(f"max_{s}"), f"max_{s}"))))


def multi_modal_comparison(rail: DataFrame, multi: DataFrame, weights: DataFrame, flows: DataFrame, cap: float = 1e7) -> DataFrame:
    """Failure losses of two tables side by side (losses from `cap` on are left out), EAEL by scenario, then ranges of edges with flow."""
    keep = [t.where(F.abs("loss") < cap).groupBy("edge_id").agg(F.sum("loss").alias(n)) for t, n in ((rail, "rail_loss"), (multi, "multi_loss"))]
    both = keep[0].join(keep[1], "edge_id", "full").fillna(0, subset=["rail_loss", "multi_loss"])
    eael = both.join(weights, "edge_id").groupBy("edge_id", "scenario").agg(F.sum(F.col("rail_loss") * F.col("risk_wt")).alias("rail_eael"), F.sum(F.col("multi_loss") * F.col("risk_wt")).alias("multi_eael"))
    out = eael.groupBy("edge_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("rail_eael", "multi_eael") for n, f in (("min", F.min), ("max", F.max))))
    return out.join(flows.where("flow > 0"), "edge_id", "left_semi")
