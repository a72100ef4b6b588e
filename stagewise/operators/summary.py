"""Dataset summary and windowing audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.vectors import STAGES
from stagewise.operators.sequences import forecast_gate
from stagewise.operators.splits import SPLITS


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, True))


def windows_per_asset(labels: DataFrame) -> DataFrame:
    """Distribution of the number of windows per asset.

    Assets are counted per number of windows first, so the exact percentiles see only
    the distinct numbers with their frequencies.
    """
    sizes = labels.groupBy("asset_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("assets"))
    q = lambda p: F.percentile("n", F.lit(p), F.col("assets"))
    return sizes.agg(
        F.min("n").alias("n_min"), q(0.25).alias("n_q25"), q(0.5).alias("n_median"),
        (F.sum(F.col("n") * F.col("assets")) / F.sum("assets")).alias("n_mean"), q(0.75).alias("n_q75"),
        F.max("n").alias("n_max"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("assets"))), F.lit(0)).alias("n_single_window"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("assets"))), F.lit(0)).alias("n_multi_window"),
    )


def suspicious_windowing(labels: DataFrame) -> DataFrame:
    """One row with the signs of degenerate windowing, empty if none."""
    sizes = labels.groupBy("asset_id").agg(F.count("*").alias("n"))
    per_asset = sizes.agg(F.sum("n").alias("n_instances"), F.count("*").alias("n_assets"), _count(F.col("n") > 1).alias("n_multi"))
    spread = labels.agg(F.countDistinct("window_id").alias("n_windows"))
    return per_asset.crossJoin(F.broadcast(spread)).withColumn("flags", F.array_compact(F.array(
        F.when(F.col("n_instances") == F.col("n_assets"), F.lit("one instance per asset")),
        F.when(F.col("n_windows") <= 1, F.lit("a single window overall")),
        F.when(F.col("n_multi") == 0, F.lit("no asset with several windows")),
    )))


def volume(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("n_records"), F.countDistinct("asset_id").alias("n_assets"),
        F.countDistinct("window_id").alias("n_windows"),
    )


def impact_assets(labels: DataFrame) -> DataFrame:
    """Assets that reach impact at all, and those that never do."""
    per_asset = labels.groupBy("asset_id").agg(F.max("severity").alias("worst"))
    return per_asset.agg(
        _count(F.col("worst") == len(STAGES) - 1).alias("n_reaching"),
        _count(F.col("worst") < len(STAGES) - 1).alias("n_never"),
    )


def busiest_asset(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Trace of the asset with most windows: its stage counts and window range."""
    top = labels.groupBy("asset_id").agg(
        F.count("*").alias("n_windows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"),
        *[_count(F.col("stage_label") == s).alias(f"n_{s}") for s in STAGES],
    ).orderBy(F.desc("n_windows"), "asset_id").limit(1)
    return trace(records, top)


def first_singleton(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Trace of the first asset that has just one window."""
    one = labels.groupBy("asset_id").agg(
        F.count("*").alias("n_windows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"),
        *[_count(F.col("stage_label") == s).alias(f"n_{s}") for s in STAGES],
    ).filter("n_windows = 1").orderBy("asset_id").limit(1)
    return trace(records, one)


def first_impact_asset(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Trace of the first asset that reaches impact."""
    hit = labels.groupBy("asset_id").agg(
        F.count("*").alias("n_windows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"),
        *[_count(F.col("stage_label") == s).alias(f"n_{s}") for s in STAGES],
    ).filter("n_IMP > 0").orderBy("asset_id").limit(1)
    return trace(records, hit)


def trace(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """Attach the raw record count of a one-row asset choice."""
    return records.select("asset_id").join(F.broadcast(chosen), "asset_id").groupBy(chosen.columns).agg(
        F.count("*").alias("n_records")
    )


def dataset_summary(
    records: DataFrame, raw_rows: DataFrame, instances: DataFrame, edges: DataFrame, forecast: DataFrame,
    feature_dimension: int, delta_t: float, min_instances: int = 10,
) -> DataFrame:
    """Long (metric, value, note) table. Each input is reduced to one row before the rows are laid out."""
    worst = len(STAGES) - 1
    one_row = (
        raw_rows.agg(F.count("*").alias("raw_records_count"))
        .crossJoin(records.agg(F.count("*").alias("raw_records_kept_after_adapter_cleaning")))
        .crossJoin(instances.groupBy("asset_id", "split").agg(
            F.count("*").alias("n"), F.max("severity").alias("worst"),
            *[_count(F.col("stage_label") == s).alias(s) for s in STAGES],
        ).agg(
            F.sum("n").alias("final_unified_instances"), F.count("*").alias("n_distinct_assets"),
            *[F.sum(s).alias(f"stage_count_{s}") for s in STAGES],
            *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"split_count_{s}") for s in SPLITS],
            _count(F.col("worst") == worst).alias("impact_positive_asset_count"),
            _count(F.col("worst") < worst).alias("impact_negative_asset_count"),
        ))
        .crossJoin(edges.agg(
            _count(F.col("edge_type") == "interaction").alias("_i"), _count(F.col("edge_type") == "temporal").alias("_t")))
        .crossJoin(forecast.agg(
            F.count("*").alias("impact_forecast_instances_total"),
            _count(F.col("label") == 1).alias("impact_forecast_positive_total"),
            _count(F.col("label") == 0).alias("impact_forecast_negative_total"),
            *[_count((F.col("split") == s) & (F.col("label") == v)).alias(f"impact_forecast_{name}_{s}")
              for s in SPLITS for v, name in ((1, "positive"), (0, "negative"))],
        ))
        .crossJoin(forecast_gate(forecast, min_instances).select(
            F.col("valid").alias("_valid"), F.array_join("reasons", "; ").alias("_why")))
    )
    plain = [
        "raw_records_count", "raw_records_kept_after_adapter_cleaning", "final_unified_instances", "n_distinct_assets",
        *[f"stage_count_{s}" for s in STAGES], *[f"split_count_{s}" for s in SPLITS],
        "impact_positive_asset_count", "impact_negative_asset_count",
        "impact_forecast_instances_total", "impact_forecast_positive_total", "impact_forecast_negative_total",
        *[f"impact_forecast_{name}_{s}" for s in SPLITS for name in ("positive", "negative")],
    ]
    n = F.col("final_unified_instances").cast("double")
    derived = {
        "feature_dimension": (F.lit(float(feature_dimension)), ""),
        "delta_t_seconds": (F.lit(float(delta_t)), ""),
        "graph_nodes": (n, ""),
        "graph_interaction_edges": (F.floor(F.col("_i") / 2), "undirected"),
        "graph_temporal_edges": (F.floor(F.col("_t") / 2), "undirected"),
        "graph_average_degree": (F.round((F.col("_i") + F.col("_t")) / F.nullif(n, F.lit(0.0)), 4), "edge ends per node"),
        "impact_forecasting_valid_overall": (F.col("_valid").cast("double"), None),
    }
    cell = lambda name, value, note: F.struct(
        F.lit(name).alias("metric"), value.cast("double").alias("value"), note.alias("note"))
    rows = [cell(c, F.col(c), F.lit("")) for c in plain] + [
        cell(name, value, F.col("_why") if note is None else F.lit(note)) for name, (value, note) in derived.items()
    ]
    return one_row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
