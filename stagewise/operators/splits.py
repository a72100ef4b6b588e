"""Seeded asset-disjoint split and asset-grouped folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.scalar import hash_hex
from stagewise.operators.blocks import HEX_PREFIX
from stagewise.settings import Settings

SPLITS = ["train", "val", "test"]


def asset_hash(seed) -> Column:
    return hash_hex(seed, F.col("asset_id"))


@dataclass(frozen=True)
class SplitCut:
    """The split as two texts: the hash of the last train asset and of the last val asset."""

    seed: int
    train_to: str
    val_to: str

    def column(self) -> Column:
        h = asset_hash(self.seed)
        return F.when(h <= self.train_to, "train").when(h <= self.val_to, "val").otherwise("test")


def split_cut(assets: DataFrame, settings: Settings) -> SplitCut:
    """Order the assets by seeded hash and cut at half-even rounded counts; the remainder is test.

    Assets are counted per hash prefix first, so only the two prefixes that hold a cut are
    ever sorted. The two border texts are all that is fetched: afterwards the split is a
    comparison with literals, and no asset table has to be joined anywhere.
    """
    hashed = assets.select("asset_id").distinct().select(
        asset_hash(settings.seed).alias("hash_key")
    ).withColumn("_pre", F.substring("hash_key", 1, HEX_PREFIX))
    counts = hashed.groupBy("_pre").agg(F.count("*").alias("_n"))  # at most 16**HEX_PREFIX rows
    ordered = Window.orderBy("_pre")
    n = F.sum("_n").over(Window.partitionBy())
    n_train = F.bround(n * F.lit(settings.train_frac), 0).cast("bigint")
    n_val = F.bround(n * F.lit(settings.val_frac), 0).cast("bigint")
    blocks = counts.select(
        "_pre", "_n", (F.sum("_n").over(ordered) - F.col("_n")).alias("_off"),
        n_train.alias("_cut_train"), (n_train + n_val).alias("_cut_val"),
    )
    holds = lambda cut: (F.col(cut) > F.col("_off")) & (F.col(cut) <= F.col("_off") + F.col("_n"))
    ranked = hashed.join(
        F.broadcast(blocks.filter(holds("_cut_train") | holds("_cut_val"))), "_pre"
    ).withColumn("_rank", F.col("_off") + F.row_number().over(Window.partitionBy("_pre").orderBy("hash_key")))
    at = lambda cut: F.max(F.when(F.col("_rank") == F.col(cut), F.col("hash_key")))
    row = ranked.agg(at("_cut_train").alias("train_to"), at("_cut_val").alias("val_to")).first()
    return SplitCut(settings.seed, row.train_to or "", row.val_to or row.train_to or "")


def attach_split(df: DataFrame, cut: SplitCut) -> DataFrame:
    """Add `split`: a projection, and every asset has a split by construction."""
    return df.withColumn("split", cut.column())


def asset_split(assets: DataFrame, settings: Settings) -> DataFrame:
    """(asset_id, split) for every distinct asset."""
    return attach_split(assets.select("asset_id").distinct(), split_cut(assets, settings))


def attach_split_map(df: DataFrame, split_map: DataFrame) -> DataFrame:
    """Attach a split given from outside as (asset_id, split) rows."""
    return df.join(split_map.select("asset_id", "split"), "asset_id", "left")


def unassigned_assets(df: DataFrame, split_map: DataFrame) -> DataFrame:
    """Assets a split map forgot; must be empty before the split is attached."""
    return df.select("asset_id").distinct().join(split_map, "asset_id", "left_anti")


def require_assigned(df: DataFrame, split_map: DataFrame) -> None:
    missing = [r.asset_id for r in unassigned_assets(df, split_map).orderBy("asset_id").limit(5).collect()]
    if missing:
        raise ValueError(f"assets without a split, e.g. {missing}")


def attach_folds(rows: DataFrame, n_folds: int, seed: int = 42) -> DataFrame:
    """Add `fold`: whole assets per fold, rows balanced over folds. Fails with fewer than two assets.

    Assets are hashed to a fixed number of buckets; buckets are dealt to folds by falling row
    count in a snake order, so a bucket with a heavy asset is dealt among the first. The
    table of buckets is bounded and broadcast, and the rows themselves do not move.
    """
    bucket = F.substring(hash_hex(seed, F.col("asset_id")), 1, HEX_PREFIX)
    stats = rows.agg(F.count_distinct("asset_id").alias("_assets")).select(
        F.when(F.col("_assets") >= 2, F.least(F.lit(n_folds), F.col("_assets"))).otherwise(
            F.raise_error(F.lit("need at least two assets for folds")).cast("bigint")).alias("k"))
    sizes = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("n"))  # at most 16**HEX_PREFIX rows
    place = F.row_number().over(Window.orderBy(F.desc("n"), "_bucket")) - 1
    lap, step = F.floor(place / F.col("k")), F.pmod(place, F.col("k"))
    dealt = sizes.crossJoin(F.broadcast(stats)).select(
        "_bucket", F.when(lap % 2 == 0, step).otherwise(F.col("k") - 1 - step).cast("int").alias("fold")
    )
    return rows.withColumn("_bucket", bucket).join(F.broadcast(dealt), "_bucket").drop("_bucket")


def asset_folds(rows: DataFrame, n_folds: int, seed: int = 42) -> DataFrame:
    """(asset_id, fold) of every asset."""
    return attach_folds(rows, n_folds, seed).select("asset_id", "fold").distinct()
