"""Neighbour propagation over the asset-time graph: joins and aggregates, no tensors.

Nodes are (asset_id, window_id) rows with a few feature columns, or with one array `x` of any width (`*_vectors`); edges are
directed and hold both directions. Each round is one equi-join and one sum. A target with very many neighbours is summed up
before its messages are shuffled. A source with very many is joined in parts: its row is copied once for each part, and its
edges are dealt to the parts by their targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.operators.graph import node_degree
from stagewise.session import cut_lineage, cut_step, discard, keep

KEY = ["asset_id", "window_id"]
HUB_EDGES = 1_000_000  # edges of one source that a task joins
BROADCAST_HUBS = 100_000
MESSAGES_A_PASS = 30_000_000  # vectors that are on their way at a time


def _hubs(edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame | None:
    """(KEY, _parts) of sources with more edges than a task should join; None where there are none, as mostly.

    `degrees` are those of the edges, where a caller has counted them.
    """
    degrees = node_degree(edges) if degrees is None else degrees
    hubs = keep(degrees.filter(F.col("degree") > HUB_EDGES).select(*KEY, F.ceil(F.col("degree") / HUB_EDGES).alias("_parts")))
    many = hubs.limit(BROADCAST_HUBS + 1).count()
    return None if not many else F.broadcast(hubs) if many <= BROADCAST_HUBS else hubs


def _messages(edges: DataFrame, nodes: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """The source node's columns delivered to each target, keyed like a node."""
    sent = edges.select(F.col("src_asset").alias("asset_id"), F.col("src_window").alias("window_id"), "dst_asset", "dst_window")
    if hubs is None:
        met = sent.join(nodes, KEY)
    else:
        parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
        dealt = sent.join(hubs, KEY, "left").withColumn("_part", F.pmod(F.xxhash64("dst_asset", "dst_window"), parts)).drop("_parts")
        copied = nodes.join(hubs, KEY, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
        met = dealt.join(copied, [*KEY, "_part"]).drop("_part")
    return met.drop(*KEY).withColumnsRenamed({"dst_asset": "asset_id", "dst_window": "window_id"})


def convolve(nodes: DataFrame, edges: DataFrame, columns: list[str], rounds: int = 2) -> DataFrame:
    """Symmetrically normalised propagation with self loops, `rounds` times.

    Features are divided by sqrt(degree + 1) once before and once after summing, which
    equals the edge weight 1/sqrt(d_i d_j) without looking up both ends of an edge. The
    edges are read once per round and for the degree, so they are kept; a round reads its
    nodes twice, so they are, too, or the work would double with each round.
    """
    edges = keep(edges)
    degrees = keep(node_degree(edges))
    hubs = _hubs(edges, degrees)
    state = nodes.select(*KEY, *columns).join(degrees, KEY, "left").withColumn(
        "_norm", 1 / F.sqrt(1 + F.coalesce(F.col("degree"), F.lit(0)))
    ).drop("degree")
    for _ in range(rounds):
        scaled = keep(state.select(*KEY, "_norm", *[(F.col(c) * F.col("_norm")).alias(c) for c in columns]))
        arriving = _messages(edges, scaled.drop("_norm"), hubs).withColumn("_norm", F.lit(None).cast("double"))
        state = scaled.unionByName(arriving).groupBy(*KEY).agg(
            F.max("_norm").alias("_norm"), *[F.sum(c).alias(c) for c in columns]
        ).select(*KEY, "_norm", *[(F.col(c) * F.col("_norm")).alias(c) for c in columns])
    return state.drop("_norm")


def mean_neighbours(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Own features plus the mean over the neighbours (`nb_` prefix; 0 without any)."""
    own, edges = nodes.select(*KEY, *columns), keep(edges)
    means = _messages(edges, own, _hubs(edges)).groupBy(*KEY).agg(*[F.avg(c).alias(f"nb_{c}") for c in columns])
    return own.join(means, KEY, "left").fillna(0.0, [f"nb_{c}" for c in columns])


def attend(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Neighbours and self weighted by the softmax of their cosine similarity to the node.

    A softmax-weighted mean is a quotient of two sums, so it is one aggregate. Cosines
    lie in [-1, 1], so the exponentials need no shift.
    """
    length = F.sqrt(sum(F.col(c) * F.col(c) for c in columns))
    own = nodes.select(*KEY, *columns).withColumn("_len", length)
    target = own.withColumnsRenamed({**{c: f"_t_{c}" for c in columns}, "_len": "_t_len"})
    edges = keep(edges)
    met = _messages(edges, own, _hubs(edges)).join(target, KEY)
    dot = sum(F.col(c) * F.col(f"_t_{c}") for c in columns)
    cosine = F.coalesce(dot / F.nullif(F.col("_len") * F.col("_t_len"), F.lit(0.0)), F.lit(0.0))
    arriving = met.select(*KEY, *columns, F.exp(cosine).alias("_w"))
    itself = own.select(*KEY, *columns, F.exp((F.col("_len") > 0).cast("double")).alias("_w"))
    return arriving.unionByName(itself).groupBy(*KEY).agg(*[
        (F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in columns
    ])


# Vectors of any width: one array per node, summed in one buffer.


def _summed(batch: pa.RecordBatch) -> tuple[pd.DataFrame, np.ndarray]:
    """Distinct keys of a batch and the sums of their vectors, in order of first appearance."""
    keys = batch.select(KEY).to_pandas()
    vectors = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    group = keys.groupby(KEY, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return keys.iloc[order[starts]], np.add.reduceat(vectors[order], starts, axis=0)


def sum_vectors(messages: DataFrame) -> DataFrame:
    """(KEY, x): element-wise sums of equally long arrays.

    Each task adds up the messages of a batch where they arise, so a node's share of the shuffle is at most a vector for each
    batch that reaches it. Behind the shuffle a partition is sorted and its vectors run through one buffer.
    """
    rows = messages.select(*KEY, "x")
    schema = rows.schema

    def out(keys: pd.DataFrame, sums: np.ndarray, like: pa.Schema) -> pa.RecordBatch:
        ends = np.arange(len(keys) + 1, dtype=np.int32) * sums.shape[1]
        x = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums.reshape(-1)))
        return pa.RecordBatch.from_arrays([*[pa.array(keys[k], like.field(k).type) for k in KEY], x], [*KEY, "x"])

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield out(*_summed(batch), batch.schema)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_sum, like = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sums = _summed(batch)
            like = batch.schema
            if open_key is not None:
                if tuple(keys.iloc[0]) == tuple(open_key.iloc[0]):
                    sums[0] += open_sum[0]
                else:
                    yield out(open_key, open_sum, like)
            if len(keys) > 1:
                yield out(keys.iloc[:-1], sums[:-1], like)
            open_key, open_sum = keys.iloc[-1:], sums[-1:]
        if open_key is not None:
            yield out(open_key, open_sum, like)

    return rows.mapInArrow(early, schema).repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(final, schema)


def _times(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda v, w: v * w), F.lit(0.0), lambda sum_, v: sum_ + v)


def convolve_vectors(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """As `convolve`, over the array `x`. A node is one row.

    The norm of a node is the last entry of its own vector, and 0 in what it sends: it goes through the sum, and no round joins it.
    A round adds up the messages of one part of the targets after the other and stores the sums, so that disk holds the messages
    of one part, the state before and the sums.
    """
    edges = keep(edges)
    degrees = keep(node_degree(edges))
    hubs = _hubs(edges, degrees)
    parts = max(1, -(-edges.count() // MESSAGES_A_PASS))
    norm = 1 / F.sqrt(1 + F.coalesce(F.col("degree"), F.lit(0)))
    placed = nodes.select(*KEY, "x").dropna(subset=KEY).join(degrees, KEY, "left")
    state = [cut_lineage(placed.select(*KEY, F.array_append("x", norm).alias("x")))]
    scaled = lambda: _appended(state).select(*KEY, _times(F.slice("x", 1, F.size("x") - 1), F.element_at("x", -1)).alias("x"), F.element_at("x", -1).alias("_norm"))
    for _ in range(rounds):
        sent, itself = (scaled().select(*KEY, F.array_append("x", last).alias("x")) for last in (F.lit(0.0), F.col("_norm")))
        sums = [cut_step(lambda: _arrived(edges, sent, itself, hubs, part, parts)) for part in range(parts)]
        discard(*state)
        state = sums
    return _appended(state).select(*KEY, F.slice("x", 1, F.size("x") - 1).alias("x"))


def _arrived(edges: DataFrame, sent: DataFrame, itself: DataFrame, hubs: DataFrame | None, part: int, parts: int) -> DataFrame:
    """Sums of what reaches the nodes of one part, times their norm, which stays the last entry. A target that is no node has none."""
    mine = lambda *key: F.pmod(F.xxhash64(*key), F.lit(parts)) == part if parts > 1 else F.lit(True)
    messages = _messages(edges.filter(mine("dst_asset", "dst_window")), sent, hubs)
    sums = sum_vectors(messages.unionByName(itself.filter(mine(*KEY)))).filter(F.element_at("x", -1) > 0)
    return sums.select(*KEY, F.array_append(_times(F.slice("x", 1, F.size("x") - 1), F.element_at("x", -1)), F.element_at("x", -1)).alias("x"))


def _appended(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def mean_vectors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As `mean_neighbours`, over the array `x`: own entries, then the means of the neighbours'."""
    own, edges = nodes.select(*KEY, "x"), keep(edges)
    sums = sum_vectors(_messages(edges, own, _hubs(edges)).withColumn("x", F.array_append("x", F.lit(1.0))))  # the last entry counts
    means = sums.select(*KEY, F.transform(F.slice("x", 1, F.size("x") - 1), lambda v: v / F.element_at("x", -1)).alias("_means"))
    means = own.join(means, KEY, "left").withColumn("_means", F.coalesce("_means", F.transform("x", lambda v: F.lit(0.0))))
    return means.select(*KEY, F.concat("x", "_means").alias("x"))


def attend_vectors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As `attend`, over the array `x`."""
    own = keep(nodes.select(*KEY, "x").withColumn("_len", F.sqrt(_dot("x", "x"))))
    edges = keep(edges)
    met = _messages(edges, own, _hubs(edges)).join(own.select(*KEY, F.col("x").alias("_t"), F.col("_len").alias("_t_len")), KEY)
    cosine = F.coalesce(_dot("x", "_t") / F.nullif(F.col("_len") * F.col("_t_len"), F.lit(0.0)), F.lit(0.0))
    arriving = met.select(*KEY, "x", F.exp(cosine).alias("_w"))
    itself = own.select(*KEY, "x", F.exp((F.col("_len") > 0).cast("double")).alias("_w"))
    weighted = arriving.unionByName(itself).select(*KEY, F.array_append(_times(F.col("x"), F.col("_w")), F.col("_w")).alias("x"))  # the last entry weighs
    return sum_vectors(weighted).select(*KEY, F.transform(F.slice("x", 1, F.size("x") - 1), lambda v: v / F.element_at("x", -1)).alias("x"))
