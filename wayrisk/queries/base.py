"""Registration, and the transport tables that queries derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def od_log(t: Tables) -> DataFrame:
    """Freight log: o and d (nations), their provinces (regions), kind, subkind, day, tons."""
    home = t.nation.select(F.col("n_nationkey").alias("o"), F.col("n_regionkey").alias("o_prov"))
    away = t.nation.select(F.col("n_nationkey").alias("d"), F.col("n_regionkey").alias("d_prov"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("subkind"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("tons"))
    out = lines.join(t.orders.select("o_orderkey", "o_custkey"), lines["l_orderkey"] == F.col("o_orderkey"))
    out = out.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("d")), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("o")), F.col("l_suppkey") == F.col("s_suppkey"))
    return out.join(home, "o").join(away, "d").select("o", "d", "o_prov", "d_prov", "kind", "subkind", "day", "tons")


OD_LOG = """od AS (
    SELECT s_nationkey AS o, c_nationkey AS d, a.n_regionkey AS o_prov, b.n_regionkey AS d_prov, l_returnflag AS kind, l_linestatus AS subkind,
        CAST(l_shipdate AS DATE) AS day, l_quantity AS tons
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey)"""


def path_table(t: Tables) -> DataFrame:
    """An order's path: its suppliers as edges in line order, with tons and its customer."""
    p = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda s: s["l_suppkey"])
    return t.lineitem.groupBy("l_orderkey").agg(p.alias("path"), F.sum("l_quantity").alias("tons"))


def hazard_facts(t: Tables) -> DataFrame:
    """Exposure facts of parts: asset id, hazard, model, scenario, year, probability, depths, exposed metres, edge length in km."""
    k = F.col("l_linenumber")
    scenario = F.when(k <= 3, "baseline").when(k <= 5, "median").otherwise("high")
    return t.lineitem.join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("id"),
        F.col("l_returnflag").alias("hazard_type"),
        F.col("l_linestatus").alias("model"),
        scenario.alias("climate_scenario"),
        F.when(k <= 3, 2016).otherwise(2050).alias("year"),
        ((F.round(F.col("l_discount") * 100) + 1) / 100).alias("probability"),
        (k * 0.5).cast("double").alias("min_depth"),
        (k * 0.5 + 1).cast("double").alias("max_depth"),
        (F.col("l_quantity") * 10).alias("exposure"),
        (F.col("p_size") / 10).alias("edge_length"),
    )


HAZARD = """haz AS (
    SELECT l_partkey AS id, l_returnflag AS hazard_type, l_linestatus AS model,
        CASE WHEN l_linenumber <= 3 THEN 'baseline' WHEN l_linenumber <= 5 THEN 'median' ELSE 'high' END AS climate_scenario,
        CASE WHEN l_linenumber <= 3 THEN 2016 ELSE 2050 END AS year, (round(l_discount * 100) + 1) / 100 AS probability,
        (l_linenumber * 0.5)::DOUBLE AS min_depth, (l_linenumber * 0.5 + 1)::DOUBLE AS max_depth, l_quantity * 10 AS exposure, p_size / 10.0::DOUBLE AS edge_length
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def road_edges(t: Tables) -> DataFrame:
    """Parts as edges between suppliers: the two ends are the ring neighbour and a further supplier, by arithmetic on keys."""
    n = t.supplier.agg(F.max("s_suppkey").alias("n"))
    k = F.col("p_partkey")
    return t.part.join(F.broadcast(n)).select(
        k.alias("edge_id"),
        (k % F.col("n") + 1).alias("from_node"),
        ((k * 7 + 3 * F.floor(k / F.col("n"))) % F.col("n") + 1).cast("long").alias("to_node"),
        (F.col("p_size") + k / 1048576).alias("cost"),
        F.col("p_size").cast("double").alias("length"),
        (F.col("p_size") / F.when(k % 2 == 0, 32).otherwise(64)).alias("time"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("kind"),
    )


EDGES = """edges AS (
    SELECT p_partkey AS edge_id, p_partkey % n + 1 AS from_node, (p_partkey * 7 + 3 * (p_partkey // n)) % n + 1 AS to_node,
        p_size + p_partkey / 1048576.0::DOUBLE AS cost, p_size::DOUBLE AS length, p_size / CASE WHEN p_partkey % 2 = 0 THEN 32.0::DOUBLE ELSE 64.0::DOUBLE END AS time, p_brand AS brand, p_type AS kind
    FROM part, (SELECT max(s_suppkey) AS n FROM supplier))"""


def places(t: Tables) -> DataFrame:
    """Customers as points on a plane of 1000 x 1000."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("point_id"), (k * 7919 % 10007 / 10.007).alias("x"), (k * 104729 % 10009 / 10.009).alias("y"), F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("balance"))


PLACES = """places AS (
    SELECT c_custkey AS point_id, c_custkey * 7919 % 10007 / 10.007::DOUBLE AS x, c_custkey * 104729 % 10009 / 10.009::DOUBLE AS y, c_nationkey AS region, c_acctbal AS balance FROM customer)"""


def depots(t: Tables) -> DataFrame:
    """Suppliers as nodes on the same plane."""
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("node_id"), (k * 6151 % 1009 / 1.009).alias("x"), (k * 12289 % 1013 / 1.013).alias("y"), F.col("s_nationkey").alias("region"))


DEPOTS = """depots AS (
    SELECT s_suppkey AS node_id, s_suppkey * 6151 % 1009 / 1.009::DOUBLE AS x, s_suppkey * 12289 % 1013 / 1.013::DOUBLE AS y, s_nationkey AS region FROM supplier)"""


def boxes(t: Tables) -> DataFrame:
    """Parts as squares of side p_size on the plane: poly_id, x0, y0, x1, y1."""
    k = F.col("p_partkey")
    x, y = (k * 31337 % 1021 / 1.021), (k * 27449 % 1019 / 1.019)
    return t.part.select(k.alias("poly_id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + F.col("p_size")).alias("y1"), F.col("p_retailprice").alias("price"))


BOXES = """boxes AS (
    SELECT p_partkey AS poly_id, p_partkey * 31337 % 1021 / 1.021::DOUBLE AS x0, p_partkey * 27449 % 1019 / 1.019::DOUBLE AS y0,
        p_partkey * 31337 % 1021 / 1.021::DOUBLE + p_size AS x1, p_partkey * 27449 % 1019 / 1.019::DOUBLE + p_size AS y1, p_retailprice AS price FROM part)"""
