"""Asset-time graph as two DataFrames: nodes (asset_id, window_id) and directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.scalar import is_missing_text
from stagewise.operators.blocks import BLOCK, timeline
from stagewise.session import cut_lineage

EDGE_COLUMNS = ["src_asset", "src_window", "dst_asset", "dst_window", "edge_type"]
MODES = {
    "interaction_only": ["interaction"],
    "temporal_only": ["temporal"],
    "both": ["interaction", "temporal"],
}


def contacts_between_nodes(interactions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed contacts (asset, peer, window) whose both ends are nodes of that window.

    A peer text that stands for "missing" can never be a node, so it is filtered before
    the shuffle instead of piling up on one join key.
    """
    real = interactions.filter(
        ~is_missing_text(F.col("peer_id")) & (F.col("asset_id") != F.col("peer_id"))
    )
    keys = nodes.select("asset_id", "window_id")
    return real.join(
        keys.withColumnRenamed("asset_id", "peer_id"), ["peer_id", "window_id"], "left_semi"
    ).join(keys, ["asset_id", "window_id"], "left_semi").select("asset_id", "peer_id", "window_id")


def both_directions(pairs: DataFrame, a: list[str], b: list[str], edge_type: str) -> DataFrame:
    """Each unordered pair as two directed edges. `a` and `b` name (asset, window) columns."""
    ends = F.array(
        F.struct(F.col(a[0]).alias("src_asset"), F.col(a[1]).alias("src_window"),
                 F.col(b[0]).alias("dst_asset"), F.col(b[1]).alias("dst_window")),
        F.struct(F.col(b[0]).alias("src_asset"), F.col(b[1]).alias("src_window"),
                 F.col(a[0]).alias("dst_asset"), F.col(a[1]).alias("dst_window")),
    )
    return pairs.select(F.explode(ends).alias("e")).select("e.*", F.lit(edge_type).alias("edge_type"))


def interaction_edges(interactions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between assets that met in a window, both directions, each once.

    Pairs are put in canonical order before the duplicate removal, which halves what
    is shuffled.
    """
    contacts = contacts_between_nodes(interactions, nodes)
    pairs = contacts.select(
        F.least("asset_id", "peer_id").alias("a"), F.greatest("asset_id", "peer_id").alias("b"), "window_id"
    ).distinct()
    return both_directions(pairs, ["a", "window_id"], ["b", "window_id"], "interaction")


def temporal_edges(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges between consecutive observed windows of an asset, both directions."""
    steps = timeline(nodes.select("asset_id", "window_id"), block=block).filter(
        F.col("next_window_id").isNotNull()
    )
    return both_directions(steps, ["asset_id", "window_id"], ["asset_id", "next_window_id"], "temporal")


def representative_edges(interactions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Window-free edges between the first nodes of assets that were ever in contact."""
    first = nodes.groupBy("asset_id").agg(F.min("window_id").alias("first_window"))
    pairs = interactions.filter(
        ~is_missing_text(F.col("peer_id")) & (F.col("asset_id") != F.col("peer_id"))
    ).select(
        F.least("asset_id", "peer_id").alias("a"), F.greatest("asset_id", "peer_id").alias("b")
    ).distinct()
    ends = pairs.join(first.select(F.col("asset_id").alias("a"), F.col("first_window").alias("aw")), "a").join(
        first.select(F.col("asset_id").alias("b"), F.col("first_window").alias("bw")), "b"
    )
    return both_directions(ends, ["a", "aw"], ["b", "bw"], "interaction")


def build_edges(interactions: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Both edge sets; they are disjoint, so appending them needs no duplicate removal."""
    return interaction_edges(interactions, nodes).unionByName(temporal_edges(nodes, block))


def edges_for_mode(edges: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown graph mode '{mode}'")
    return edges.filter(F.col("edge_type").isin(MODES[mode]))


def induced_subgraph(edges: DataFrame, kept_nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are kept. Nodes have natural keys, so nothing is renumbered."""
    keys = kept_nodes.select("asset_id", "window_id")
    for side in ("src", "dst"):
        named = keys.select(F.col("asset_id").alias(f"{side}_asset"), F.col("window_id").alias(f"{side}_window"))
        edges = edges.join(named, [f"{side}_asset", f"{side}_window"], "left_semi")
    return edges.select(*EDGE_COLUMNS)


def node_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src_asset").alias("asset_id"), F.col("src_window").alias("window_id")).agg(
        F.count("*").alias("degree")
    )


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per mode: nodes, undirected edges, average degree, from one pass over the edges."""
    totals = edges.agg(*[
        F.count(F.when(F.col("edge_type").isin(types), True)).alias(mode) for mode, types in MODES.items()
    ])
    n = nodes.agg(F.count("*").alias("n_nodes"))
    rows = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("endpoints")) for m in MODES])
    return totals.crossJoin(F.broadcast(n)).select("n_nodes", F.explode(rows).alias("r")).select(
        "r.mode", "n_nodes", F.floor(F.col("r.endpoints") / 2).cast("bigint").alias("n_edges"),
        F.round(F.col("r.endpoints") / F.nullif(F.col("n_nodes").cast("double"), F.lit(0.0)), 4).alias("average_degree"),
    )


def node_ids(nodes: DataFrame) -> DataFrame:
    """Contiguous node ids 0..N-1 in (asset, window) order, for exports that need them.

    A distributed range sort, written out so that its partitions are fixed. An id is the
    number of rows in earlier partitions plus the place within its own.
    """
    fixed = cut_lineage(nodes.select("asset_id", "window_id").orderBy("asset_id", "window_id")).withColumn(
        "_row", F.monotonically_increasing_id()
    ).select("asset_id", "window_id", F.shiftright("_row", 33).alias("_part"),
             F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return fixed.join(F.broadcast(starts), "_part").select(  # one row per partition
        "asset_id", "window_id", (F.col("_start") + F.col("_place")).alias("node_id"))
