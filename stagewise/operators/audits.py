"""Leakage and quality checks as (check, pass, detail) rows. Every check is a data check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.vectors import evidence_gates, gated_stream
from stagewise.operators.features import FeatureEncoder, numeric_params
from stagewise.operators.graph import EDGE_COLUMNS, induced_subgraph
from stagewise.operators.ranking import validation_thresholds


def _row(df: DataFrame, check: str, violations: Column, what: str) -> DataFrame:
    v = F.coalesce(violations, F.lit(0)).cast("bigint")
    return df.agg(v.alias("v")).select(
        F.lit(check).alias("check"), (F.col("v") == 0).alias("pass"),
        F.concat(F.col("v").cast("string"), F.lit(" " + what)).alias("detail"),
    )


def asset_in_one_split(split_rows: DataFrame) -> DataFrame:
    per_asset = split_rows.groupBy("asset_id").agg(F.countDistinct("split").alias("n"))
    return _row(per_asset, "asset_in_one_split", F.sum((F.col("n") > 1).cast("int")), "assets in several splits")


def encoder_is_train_only(encoder: FeatureEncoder, instance_rows: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Compare a fitted encoder with an independent refit on train rows."""
    spark = instance_rows.sparkSession
    used = spark.createDataFrame(
        [(n, encoder.medians[n], *encoder.scales[n]) for n in encoder.scales] or [("", 0.0, 0.0, 1.0)],
        "name string, u_median double, u_mean double, u_std double")
    train = instance_rows.filter("split = 'train'")
    again = numeric_params(train, encoder.numeric).filter(F.col("median").isNotNull())
    far = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(F.lit(1.0), F.abs(F.col(b)))
    differs = far("u_median", "median") | far("u_mean", "mean") | far("u_std", "std") | F.col("u_mean").isNull()
    seen = train.agg(F.count("*").alias("n_train"))
    return _row(
        again.join(F.broadcast(used), "name", "left").crossJoin(F.broadcast(seen)), "encoder_train_only",
        F.sum((differs | (F.col("n_train") != encoder.n_rows_seen)).cast("int")), "features differ from a train-only refit",
    )


def fold_graph_is_train_only(edges: DataFrame, nodes_with_split: DataFrame) -> DataFrame:
    """Edges of the train subgraph that touch a val or test node."""
    inner = induced_subgraph(edges, nodes_with_split.filter("split = 'train'"))
    others = nodes_with_split.filter("split <> 'train'").select("asset_id", "window_id")
    touching = None
    for side in ("src", "dst"):
        named = others.select(F.col("asset_id").alias(f"{side}_asset"), F.col("window_id").alias(f"{side}_window"))
        part = inner.join(named, [f"{side}_asset", f"{side}_window"], "left_semi").select("edge_type")
        touching = part if touching is None else touching.unionByName(part)
    return _row(touching, "fold_graph_train_only", F.count("*"), "train subgraph edges touch val or test")


def cross_split_edges(edges: DataFrame, nodes_with_split: DataFrame) -> DataFrame:
    """How many edges connect nodes of different splits (the full graph is transductive)."""
    named = lambda side: nodes_with_split.select(
        F.col("asset_id").alias(f"{side}_asset"), F.col("window_id").alias(f"{side}_window"), F.col("split").alias(f"{side}_split"))
    met = edges.join(named("src"), ["src_asset", "src_window"]).join(named("dst"), ["dst_asset", "dst_window"])
    return met.agg(F.count(F.when(F.col("src_split") != F.col("dst_split"), True)).alias("n_cross_split"),
                   F.count("*").alias("n_edges"))


def no_impact_in_prefix(with_prefix: DataFrame) -> DataFrame:
    bad = F.exists("prefix", lambda step: step.getField("stage_label") == "IMP")
    return _row(with_prefix, "no_impact_in_prefix", F.sum(bad.cast("int")), "prefixes hold an impact window")


def no_impact_mass_in_features(rows: DataFrame, width: int, proba: Column | None = None) -> DataFrame:
    """With all probability on impact, neither gate may open and the width must stay 1 + features.

    `rows` carries the feature array `x`; every row is probed.
    """
    probe = proba if proba is not None else F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    gates = evidence_gates(probe)
    streams = [gated_stream(F.element_at(gates, k), F.col("x")) for k in (2, 3)]
    bad = reduce(lambda a, b: a | b, [(F.element_at(s, 1) >= 0.99) | (F.size(s) != 1 + width) for s in streams])
    return _row(rows, "no_impact_mass_in_features", F.sum(bad.cast("int")), "feature rows carry impact mass")


def thresholds_ignore_test(ovr: DataFrame, choose: Callable[[DataFrame], DataFrame] = validation_thresholds) -> DataFrame:
    """Thresholds, as `choose` takes them from all rows, must not move when every test label is turned round."""
    turned = ovr.withColumn("label", F.when(F.col("split") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    b = choose(turned).withColumnRenamed("threshold", "other")
    moved = ~F.col("threshold").eqNullSafe(F.col("other"))
    return _row(choose(ovr).join(b, "stage", "full"), "thresholds_ignore_test", F.sum(moved.cast("int")), "thresholds moved")


def chronological(violations: DataFrame) -> DataFrame:
    return _row(violations, "chronological_windows", F.count("*"), "windows start before their predecessor")


def edges_well_formed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Self loops, ends without a node, and edges without their reverse.

    An edge and its reverse fall onto one key and are counted, so every edge moves once, and once more as a count for its source.
    """
    loops = (F.col("src_asset") == F.col("dst_asset")) & (F.col("src_window") == F.col("dst_window"))
    # As edges hold both directions, checking the sources checks every end.
    sources = edges.groupBy("src_asset", "src_window").agg(F.count("*").alias("n"))
    ends = nodes.select(F.col("asset_id").alias("src_asset"), F.col("window_id").alias("src_window"))
    orphans = sources.join(ends, ["src_asset", "src_window"], "left_anti")
    src, dst = (F.struct(f"{side}_asset", f"{side}_window") for side in ("src", "dst"))
    turn = lambda a, b: [F.when(src <= dst, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{a}_{c}") for c in ("asset", "window")]
    counted = edges.groupBy(*turn("src", "dst"), *turn("dst", "src"), "edge_type").agg(
        F.count(F.when(src <= dst, True)).alias("n_there"), F.count(F.when(src > dst, True)).alias("n_back"))
    known = F.lit(True)  # an end or a type that is missing equals no other
    for c in EDGE_COLUMNS:
        known &= F.col(c).isNotNull()
    met = known & (loops | ((F.col("n_there") > 0) & (F.col("n_back") > 0)))
    lonely = counted.filter(~F.coalesce(met, F.lit(False))).select((F.col("n_there") + F.col("n_back")).alias("n"))
    bad = edges.filter(loops).select(F.lit(1).cast("bigint").alias("n")).unionByName(orphans.select("n")).unionByName(lonely)
    return _row(bad, "edges_well_formed", F.sum("n"), "malformed edges")


def probabilities_sum_to_one(scored: DataFrame) -> DataFrame:
    off = F.abs(F.aggregate("proba", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-6
    return _row(scored, "probabilities_sum_to_one", F.sum(off.cast("int")), "rows do not sum to 1")


def not_synthetic(spark: SparkSession, folder: str) -> DataFrame:
    from stagewise.sources.paths import is_synthetic

    marked = is_synthetic(spark, folder)
    return spark.createDataFrame(
        [("not_synthetic", not marked, "marker found" if marked else "no marker")], "check string, pass boolean, detail string")


def provenance_present(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables that lack a provenance column, by schema alone."""
    from stagewise.sources.sinks import REQUIRED_STAMPS

    spark = next(iter(tables.values())).sparkSession
    missing = sorted(name for name, df in tables.items() if not set(REQUIRED_STAMPS) <= set(df.columns))
    detail = "all tables stamped" if not missing else "unstamped: " + ", ".join(missing)
    return spark.createDataFrame([("provenance_present", not missing, detail)], "check string, pass boolean, detail string")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def verdict(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.when(F.col("pass"), True)).alias("n_pass"), F.count("*").alias("n_total"))
