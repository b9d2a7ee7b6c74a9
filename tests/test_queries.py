"""Every query that has SQL against DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wayrisk.queries import ORACLE, QUERIES, paths
from wayrisk.queries.base import EDGES, Tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v) -> str:
    if v is None or pd.isna(v):
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return str(v)[:10] if hasattr(v, "year") else str(float(v))


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def least_costs(edges: pd.DataFrame, n: int) -> np.ndarray:
    """Least costs between all of n nodes; the costs of these tables add up exactly."""
    d = np.full((n + 1, n + 1), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, c in zip(edges.from_node, edges.to_node, edges.cost, strict=True):
        d[a, b] = d[b, a] = min(d[a, b], c)
    for k in range(n + 1):
        d = np.minimum(d, d[:, k, None] + d[k])
    return d


def test_nearest_of_all_candidates(spark):
    folder, c = SF.replace("0.001", "0.01"), duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    d = least_costs(c.execute(f"WITH {EDGES} SELECT * FROM edges").df(), c.execute("SELECT max(s_suppkey) FROM supplier").fetchone()[0])
    pairs = c.execute("SELECT DISTINCT c_custkey, s_suppkey, l_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_nationkey = c_nationkey WHERE s_suppkey <> l_suppkey").fetchall()
    best = {}
    for k, o, e in pairs:
        if np.isfinite(d[o, e]):
            best[k] = min(best.get(k, (np.inf,)), (d[o, e], o, e))
    got = {r.record: (r.routed_km, r.origin_id, r.destination_id) for r in QUERIES["n24_closest_candidates"](spark, folder).collect()}
    assert got == best and max(v[2] for v in got.values()) > 97


def test_every_used_edge_fails(spark):
    folder, c = SF.replace("0.001", "0.01"), duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    edges, n = c.execute(f"WITH {EDGES} SELECT * FROM edges").df(), c.execute("SELECT max(s_suppkey) FROM supplier").fetchone()[0]
    pairs = c.execute("SELECT count(*) FROM (SELECT DISTINCT o, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN (SELECT s_nationkey, min(s_suppkey) AS o FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey WHERE o <> l_suppkey)").fetchone()[0]
    assert paths.demand(Tables(spark, folder)).count() == pairs
    used = {}
    for r in paths.routed(Tables(spark, folder)).where("reachable and tons > 0").collect():
        for e in r.path:
            used.setdefault(e, set()).add((r.origin_id, r.destination_id))
    got = {}
    for r in QUERIES["n18_failures"](spark, folder).collect():
        got.setdefault(r.scenario_id, {})[r.origin_id, r.destination_id] = np.inf if r.no_access else r.new_cost
        # An edge's cost is its length and a fraction that grows with its number.
        assert r.no_access or abs(r.new_length - r.new_cost) < 1 and r.length_diff == r.new_length - r.old_length
    assert {e: set(x) for e, x in got.items()} == used
    for e, x in got.items():
        d = least_costs(edges[edges.edge_id != int(e)], n)
        assert x == {k: d[k] for k in x}
