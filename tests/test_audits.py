"""Audit checks over odd edges, and what the planted audit reads."""

from datetime import datetime, timedelta

from stagewise.operators import audits
from stagewise.plans import queries

EDGES = "src_asset string, src_window long, dst_asset string, dst_window long, edge_type string"


def plain(edges, nodes):
    """Loops, sources without a node and edges without their reverse, row by row; a missing value equals nothing."""
    known = [e for e in edges if None not in e]
    reverse = {(c, d, a, b, t) for a, b, c, d, t in known}
    loops = sum(None not in e[:4] and e[:2] == e[2:4] for e in edges)
    orphans = sum(None in e[:2] or e[:2] not in nodes for e in edges)
    return loops + orphans + sum(None in e or e not in reverse for e in edges)


def test_malformed_edges_are_counted_row_by_row(spark):
    edges = [
        ("a", 1, "b", 1, "interaction"), ("b", 1, "a", 1, "interaction"), ("b", 1, "a", 1, "interaction"),  # both ways, one twice
        ("a", 1, "a", 2, "temporal"), ("a", 1, "a", 2, "temporal"),  # one way, twice
        ("a", 2, "a", 3, "temporal"), ("a", 3, "a", 2, "interaction"),  # back by another type
        ("c", 1, "c", 1, "temporal"), ("c", 1, "c", 1, None),  # loops
        ("z", 9, "a", 1, "temporal"), ("a", 1, "z", 9, "temporal"),  # no node
        (None, 1, "a", 1, "temporal"), ("a", 1, None, 1, "temporal"), ("a", None, "a", None, "temporal"), ("a", 1, "b", 1, None), ("b", 1, "a", 1, None),
    ]
    nodes = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 1), ("c", 1), (None, 1)]
    found = audits.edges_well_formed(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, "asset_id string, window_id long")).first()
    assert (found["pass"], found.detail) == (False, f"{plain(edges, nodes)} malformed edges")
    assert audits.edges_well_formed(spark.createDataFrame(edges[:3], EDGES), spark.createDataFrame(nodes, "asset_id string, window_id long")).first()["pass"]
    assert audits.edges_well_formed(spark.createDataFrame([], EDGES), spark.createDataFrame(nodes, "asset_id string, window_id long")).first()["pass"]


def test_planted_audit_builds_each_table_once(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), i % 40, ("view", "error", "purchase", "signup")[i % 7 % 4], float(i % 150), '{"k": %d}' % (i % 37)) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    plan = queries.QUERIES["audit_violations"](spark, str(tmp_path))._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan
    assert plan.count("Relation [event_id") == 0  # every check reads kept tables, none goes back to the events
