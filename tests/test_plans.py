"""The chains on a small made-up country."""

import pytest
from pyspark.sql import functions as F

from wayrisk.functions import geometry as G
from wayrisk.plans import chains


def test_zones_to_edges(spark):
    flows = spark.createDataFrame([("A", "B", 730.0)], "origin_zone string, destination_zone string, tons double")
    o = spark.createDataFrame([("A", "a", 1.0)], "zone string, node_id string, share double")
    d = spark.createDataFrame([("B", "b", 0.75), ("B", "c", 0.25)], "zone string, node_id string, share double")
    edges = spark.createDataFrame([("e1", "a", "b", 1.0, 9.0), ("e2", "a", "c", 2.0, 2.0), ("e3", "b", "c", 5.0, 5.0)], "edge_id string, from_node string, to_node string, min_gcost double, max_gcost double")
    got = [(r.edge_id, r.min_total_tons, r.max_total_tons) for r in chains.edge_flows_of_zones(flows, o, d, edges, 0.4).collect()]
    assert got == [("e2", 0.5, 2.0), ("e1", 0.0, 1.5), ("e3", 0.0, 1.5)]


def test_floods_to_change(spark):
    line = spark.createDataFrame([("r", 0.0, 0.0, 1000.0, 0.0)], "edge_id string, a double, b double, c double, d double").select("edge_id", F.array(G.point(F.col("a"), F.col("b")), G.point(F.col("c"), F.col("d"))).alias("points"))
    poly = spark.createDataFrame([(1, 100.0, 350.0), (2, 100.0, 600.0)], "poly_id int, x0 double, x1 double").select("poly_id", G.rectangle_ring(F.col("x0"), F.lit(-5.0), F.col("x1"), F.lit(5.0)).alias("ring"))
    sc = spark.createDataFrame([(1, "river", "m", "baseline", 2016, 0.1, 0.5, 1.0), (2, "river", "m", "high", 2050, 0.1, 0.5, 2.0)], "poly_id int, hazard_type string, model string, climate_scenario string, year int, probability double, min_depth double, max_depth double")
    assets = spark.createDataFrame([("r", 1.0, 7.3, 2.0, 10.0, 20.0)], "id string, edge_length double, width double, unit_cost double, min_impact double, max_impact double")
    risks, change = chains.climate_risks(line, poly, sc, assets, 100.0)
    got = {r.year: r for r in risks.collect()}
    assert got[2016].ead == pytest.approx(1e3 * 2 * 25) and got[2050].min_eael_per_day == pytest.approx(0.1 * 10)
    assert change.first().change == pytest.approx(100.0)


def test_adaptation_report(spark):
    risks = spark.createDataFrame([("a", 1e6, 10.0, 20.0), ("b", 1.0, 0.0, 0.0)], "id string, ead double, min_eael_per_day double, max_eael_per_day double")
    costs = spark.createDataFrame([("a", 1e6), ("b", 1e6)], "id string, total double")
    got = chains.adaptation_report(risks, costs, [10, 20], [0.0], 0.1, 2016, 2030).collect()
    assert sorted((r.id, r.duration) for r in got) == [("a", 10), ("a", 20)] and all(r.investment == 1e6 for r in got)
