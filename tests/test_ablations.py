"""The ablation queries on small event tables: what they report of their edge sets."""

from datetime import datetime, timedelta

from stagewise.operators import graph
from stagewise.plans import queries

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
TYPES = ("view", "error", "purchase", "signup")


def event_rows(n=1500, users=40, peers=37):
    return [(i, datetime(2024, 1, 1) + timedelta(minutes=20 * i), i * i % users, TYPES[i % 7 % 4], float(i % 150), '{"k": %d}' % (i * 3 % peers)) for i in range(n)]


def plain_graph(rows):
    """Nodes and undirected edges of each mode, row by row."""
    window = lambda ts: int((ts - datetime(1970, 1, 1)).total_seconds() // 21600)
    nodes = {(str(r[2]), window(r[1])) for r in rows}
    met = {(window(r[1]), *sorted((str(r[2]), r[5][6:-1]))) for r in rows}
    interactions = sum(a != b and (a, w) in nodes and (b, w) in nodes for w, a, b in met)
    temporal = len(nodes) - len({a for a, _ in nodes})
    return len(nodes), {"interaction_only": interactions, "temporal_only": temporal, "both": interactions + temporal}


def test_graph_mode_ablation_tells_the_size_of_each_edge_set(spark, tmp_path):
    rows = event_rows()
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    n_nodes, n_edges = plain_graph(rows)
    out = queries.QUERIES["graph_mode_ablation"](spark, str(tmp_path)).collect()
    assert sorted((r.model, r.split) for r in out) == sorted((m, s) for m in graph.MODES for s in ("train", "val", "test"))
    assert min(n_edges.values()) > 0
    for r in out:
        assert (r.n_nodes, r.n_edges, r.average_degree) == (n_nodes, n_edges[r.model], round(2 * n_edges[r.model] / n_nodes, 4))
    assert all(sum(r.n_samples for r in out if r.model == m) == n_nodes for m in graph.MODES)
