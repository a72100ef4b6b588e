"""Forecast instances: what an asset showed before a cut, and whether impact follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.operators.blocks import BLOCK, look_back, timeline


def with_first_impact(labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each (asset, window) with `pos`, the asset's first impact window and its last window."""
    return timeline(labels, block=block, marks={"first_impact": F.col("stage_label") == "IMP"})


def forecast_label(horizon: Column | int, drop_unconfirmed: bool = True) -> Column:
    """1/0, or NULL where the recording ends too early to confirm a negative."""
    horizon = horizon if isinstance(horizon, Column) else F.lit(horizon)
    cut = F.col("window_id")
    reached = F.when(F.col("first_impact") - cut <= horizon, 1).otherwise(0)
    confirmed = F.col("last_window_id") - cut >= horizon
    silent = F.when(confirmed, 0) if drop_unconfirmed else F.lit(0)
    return F.when(F.col("first_impact").isNotNull(), reached).otherwise(silent).cast("int")


def eligible_cuts(placed: DataFrame) -> DataFrame:
    """Windows strictly before the first impact, or all windows of assets without impact."""
    return placed.filter(F.col("first_impact").isNull() | (F.col("window_id") < F.col("first_impact")))


def forecast_instances(
    labels: DataFrame, horizon: int, max_seq_len: int, drop_unconfirmed: bool = True, block: int = BLOCK
) -> DataFrame:
    """(asset, cut window, label, seq_len). `labels` may carry a split column.

    The prefix is the last `max_seq_len` observed windows, so its length needs no
    sequence: it follows from the position.
    """
    cuts = eligible_cuts(with_first_impact(labels, block)).withColumn(
        "label", forecast_label(horizon, drop_unconfirmed)
    ).filter(F.col("label").isNotNull())
    return cuts.withColumn("cut_window_id", F.col("window_id")).withColumn(
        "seq_len", F.least(F.col("pos") + 1, F.lit(max_seq_len)).cast("int")
    )


def horizon_sweep(labels: DataFrame, horizons: tuple, max_seq_len: int, drop_unconfirmed: bool = True,
                  block: int = BLOCK) -> DataFrame:
    """Forecast instances for several horizons; the horizon is a column, the timeline is built once."""
    cuts = eligible_cuts(with_first_impact(labels, block)).withColumn(
        "horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))
    )
    return cuts.withColumn("label", forecast_label(F.col("horizon"), drop_unconfirmed)).filter(
        F.col("label").isNotNull()
    ).withColumn("seq_len", F.least(F.col("pos") + 1, F.lit(max_seq_len)).cast("int"))


def prefixes(placed: DataFrame, max_seq_len: int, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Add `prefix`: the last `max_seq_len` windows as an array of structs, oldest first.

    Whole structs are collected, so a missing value keeps its place.
    """
    return look_back(
        placed, max_seq_len, {"prefix": lambda w: F.collect_list(F.struct(*columns)).over(w)}, block
    )


def prefix_stats(placed: DataFrame, max_seq_len: int, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Causal-history summary per column: last is the column itself; mean, max, delta over the prefix."""
    builds = {"history_len": lambda w: F.count(F.lit(1)).over(w)}
    for c in columns:
        builds[f"{c}__hist_mean"] = lambda w, c=c: F.avg(c).over(w)
        builds[f"{c}__hist_max"] = lambda w, c=c: F.max(c).over(w)
        builds[f"{c}__hist_delta"] = lambda w, c=c: F.col(c) - F.first(c).over(w)
    return look_back(placed, max_seq_len, builds, block)


def flatten_prefixes(with_prefix: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (instance, step): the exploded form of the sequences."""
    return with_prefix.select(*keys, F.posexplode("prefix").alias("step", "item")).select(*keys, "step", "item.*")


def instances_to_frame(forecast: DataFrame) -> DataFrame:
    return forecast.select("asset_id", "split", "label", "seq_len", "cut_window_id")


def ordinal_baselines(cuts: DataFrame, p_column: str, max_seq_len: int, block: int = BLOCK) -> DataFrame:
    """Unlearned scores from evidence in the prefix: its maximum, and how often it passes 0.5.

    `cuts` are timeline rows (every window, so the look-back sees all of them). The count
    is divided by its maximum over the rows flagged `scored`, a one-row aggregate.
    """
    p = F.col(p_column)
    scored = look_back(cuts, max_seq_len, {
        "max_score": lambda w: F.max(p).over(w),
        "hits": lambda w: F.sum((p > 0.5).cast("double")).over(w),
    }, block).filter("scored")
    top = scored.agg(F.greatest(F.coalesce(F.max("hits"), F.lit(0.0)), F.lit(1.0)).alias("_top"))
    return scored.crossJoin(F.broadcast(top)).withColumn("count_score", F.col("hits") / F.col("_top")).drop("hits", "_top")


def instance_summary(forecast: DataFrame) -> DataFrame:
    """Counts by split plus a total row (split = 'all')."""
    return forecast.rollup("split").agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_positive"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"), F.grouping("split").alias("is_total"),
    ).select(F.when(F.col("is_total") == 1, "all").otherwise(F.col("split")).alias("split"),
             "n", "n_positive", "positive_rate")


def forecast_gate(forecast: DataFrame, min_instances: int = 10) -> DataFrame:
    """One row: whether ranking metrics are defined, with reasons if not."""
    def n(split, label=None):
        cond = F.col("split") == split
        return F.count(F.when(cond if label is None else cond & (F.col("label") == label), True))

    row = forecast.agg(
        F.count("*").alias("n_total"), n("train").alias("n_train"), n("val").alias("n_val"), n("test").alias("n_test"),
        n("train", 1).alias("pos_train"), n("test", 1).alias("pos_test"),
    )
    reasons = [F.when(F.col("n_total") == 0, F.lit("no forecast instances"))]
    some = F.col("n_total") > 0
    reasons.append(F.when(some & (F.col("n_train") < min_instances), F.lit("too few train instances")))
    for s in ("train", "test"):
        empty = F.col(f"n_{s}") == 0
        single = (F.col(f"pos_{s}") == 0) | (F.col(f"pos_{s}") == F.col(f"n_{s}"))
        reasons.append(F.when(some & empty, F.lit(f"no {s} instances")))
        reasons.append(F.when(some & ~empty & single, F.lit(f"{s} has one class only")))
    return row.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn(
        "valid", F.size("reasons") == 0
    )


def asset_timelines(labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per asset: observed windows, 0-based position of the first impact, windows before it."""
    placed = with_first_impact(labels, block)
    at_impact = F.when(F.col("window_id") == F.col("first_impact"), F.col("pos"))
    return placed.groupBy("asset_id").agg(
        F.count("*").alias("n_windows"), F.min(at_impact).alias("first_impact_pos"),
    ).withColumn("n_pre_impact", F.coalesce(F.col("first_impact_pos"), F.lit(0)).cast("bigint"))
