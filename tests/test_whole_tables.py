"""Queries over graphs and snapshots take whole tables."""

from pathlib import Path

import duckdb
import pytest

from siltstone import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables")


def rows(spark, name):
    return sorted(map(tuple, catalog.queries()[name](spark, SF).collect()))


def test_every_edge_counts(spark):
    edges = rows(spark, "edges_dedup")
    reached = set(edges)
    while new := {(a, d) for a, b in reached for c, d in edges if b == c} - reached:
        reached |= new
    assert rows(spark, "reach_recursive") == sorted(reached)
    assert [n for (n,) in rows(spark, "cycle_nodes")] == sorted(a for a, b in reached if a == b)
    assert sum(len(r.split(",")) for _, r in rows(spark, "referrers_list") if r) == len(edges)


def test_every_order_is_compared(spark):
    con = duckdb.connect()
    for name in ("orders", "supplier", "customer", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert len(rows(spark, "delta_two_snapshots")) == con.execute("SELECT count(*) FROM orders").fetchone()[0]
    for name in ("delta_two_snapshots", "reach_recursive", "cycle_nodes", "referrers_list"):
        assert rows(spark, name) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
