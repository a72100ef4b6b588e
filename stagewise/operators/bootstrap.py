"""Bootstrap intervals on sufficient statistics instead of copied rows.

Draws come from a seeded hash, so every engine and every retry sees the same resample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.scalar import hash_hex, hash_index, hash_unit
from stagewise.operators.blocks import hash_position
from stagewise.operators.metrics import CELLS, confusion_counts, macro_f1_of_cells
from stagewise.operators.resample_curves import POINT, POISSON_CDF, curve_samples, pr_auc, roc_auc, times_of

ASSETS_AT_ONCE = 512  # assets x iterations multiplicities are held at a time
STEPS_AT_ONCE = 1024  # picks hashed at a time


def _draws(df: DataFrame, n: int, iterations: int, seed) -> DataFrame:
    """(iteration, pick): n uniform picks from [0, n) per iteration, generated where they are used."""
    spark = df.sparkSession
    ids = spark.range(n * iterations)
    iteration = F.expr(f"id div {max(n, 1)}")
    step = F.expr(f"id % {max(n, 1)}")
    return ids.select(
        iteration.alias("iteration"), hash_index(hash_hex(seed, iteration, step), F.lit(n)).alias("pick")
    )


def instance_bootstrap(df: DataFrame, iterations: int, seed=42) -> DataFrame:
    """Confusion counts of `iterations` resamples of the rows, with replacement.

    A metric of the confusion counts cannot tell rows of one cell apart. So rows count
    as ordered by cell, and a pick is placed by comparing it with 16 running counts:
    no row is numbered, joined or copied, and nothing but 16 sums per task is shuffled.
    A task takes ranges of steps through all iterations; the picks are those of `_draws`.
    """
    totals = confusion_counts(df=df).first()  # one row
    ends = list(accumulate(totals[c] for c in CELLS))
    n = ends[-1]
    names = ", ".join(f"{c} bigint" for c in CELLS)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's sums: one row per iteration, however many steps it takes."""
        import numpy as np

        total = np.zeros((iterations, len(CELLS)), np.int64)
        for frame in frames:
            for start in frame["id"].tolist():
                tails = [b"%d" % step for step in range(start, min(start + STEPS_AT_ONCE, n))]
                for iteration in range(iterations):
                    head = f"{seed}|{iteration}|".encode()
                    digests = b"".join([md5(head + tail).digest() for tail in tails])
                    picks = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)) % np.uint64(n)  # as hash_index: 60 bits
                    total[iteration] += np.bincount(np.searchsorted(ends, picks.astype(np.int64), side="right"), minlength=len(CELLS))
        drawn = total.any(axis=1)
        yield pd.DataFrame(total[drawn], columns=CELLS).assign(iteration=np.flatnonzero(drawn))

    sums = df.sparkSession.range(0, n, STEPS_AT_ONCE).mapInPandas(draw, f"{names}, iteration bigint")
    return sums.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in CELLS])


def instance_bootstrap_multinomial(df: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """The same distribution at a cost that does not depend on the number of rows.

    n picks with replacement are one multinomial draw over the 16 cells.
    """
    totals = confusion_counts(df=df)
    work = df.sparkSession.range(iterations).withColumnRenamed("id", "iteration").crossJoin(F.broadcast(totals))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            counts = batch[CELLS].to_numpy()
            out = np.zeros_like(counts)
            for i, iteration in enumerate(batch["iteration"]):
                n = counts[i].sum()
                if n:
                    out[i] = np.random.default_rng([seed, int(iteration)]).multinomial(n, counts[i] / n)
            yield pd.DataFrame(out, columns=CELLS).assign(iteration=batch["iteration"].to_numpy())

    schema = ", ".join(f"{c} bigint" for c in CELLS) + ", iteration bigint"
    return work.mapInPandas(draw, schema)


def asset_bootstrap(df: DataFrame, iterations: int, seed=42) -> DataFrame:
    """Confusion counts of resamples of whole assets, with replacement.

    Each asset is reduced to its 16 counts first. Picks are counted per asset and joined
    with that small row; a picked asset enters with its multiplicity.
    """
    per_asset = confusion_counts(["asset_id"], df).withColumn("hash_key", hash_hex(seed, F.col("asset_id")))
    n = per_asset.count()
    picked = _draws(df, n, iterations, seed).groupBy("iteration", "pick").agg(F.count("*").alias("times"))
    numbered = hash_position(per_asset).drop("hash_key", "asset_id")
    return picked.join(numbered, picked.pick == numbered.hash_pos).groupBy("iteration").agg(*[
        F.sum(F.col(c) * F.col("times")).alias(c) for c in CELLS
    ])


def poisson_times(seed, iteration: Column, *key: Column) -> Column:
    """Poisson(1) multiplicity of a unit in an iteration, from its hash."""
    u = hash_unit(hash_hex(seed, iteration, *key))
    return sum((u >= F.lit(edge)).cast("int") for edge in POISSON_CDF)


def asset_bootstrap_poisson(df: DataFrame, iterations: int, seed=42) -> DataFrame:
    """Asset resampling with independent Poisson(1) multiplicities.

    The usual choice for very many assets: no picks to shuffle, no join. The resample
    size varies around the number of assets instead of equalling it.
    """
    per_asset = confusion_counts(["asset_id"], df)
    names = ", ".join(f"{c} bigint" for c in CELLS)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's sums: one row per iteration, however many assets it holds."""
        import numpy as np

        total = np.zeros((iterations, len(CELLS)), np.int64)
        for frame in frames:
            for at in range(0, len(frame), ASSETS_AT_ONCE):
                part = frame.iloc[at:at + ASSETS_AT_ONCE]
                times = times_of(seed, [None if pd.isna(a) else a for a in part["asset_id"]], iterations)
                total += times.T @ part[CELLS].to_numpy(np.int64)
        drawn = total.any(axis=1)
        yield pd.DataFrame(total[drawn], columns=CELLS).assign(iteration=np.flatnonzero(drawn))

    sums = per_asset.select(F.col("asset_id").cast("string").alias("asset_id"), *CELLS).mapInPandas(weigh, f"{names}, iteration bigint")
    return sums.groupBy("iteration").agg(*[F.sum(c).alias(c) for c in CELLS])


def interval(resamples: DataFrame, point: DataFrame, metric: Callable[[], Column] = macro_f1_of_cells,
             ci: float = 0.95) -> DataFrame:
    """(point, lower, upper, n_valid_iterations). `metric` builds a Column over the cell columns.

    One row per iteration reaches the exact percentile, so its memory is bounded.
    """
    alpha = (1 - ci) / 2
    values = resamples.select(metric().alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    bounds = values.agg(
        F.percentile("value", F.lit(alpha)).alias("lower"), F.percentile("value", F.lit(1 - alpha)).alias("upper"),
        F.count("value").alias("n_valid_iterations"),
    )
    return point.select(metric().alias("point")).crossJoin(F.broadcast(bounds))


def ranking_bootstrap(df: DataFrame, iterations: int, seed=42, unit: str = "asset_id", ci: float = 0.95) -> DataFrame:
    """Intervals of ROC-AUC and average precision under resampling of whole units, with Poisson(1) multiplicities."""
    samples = curve_samples(df, [roc_auc(), pr_auc()], iterations, seed, unit)
    alpha = (1 - ci) / 2
    drawn = {m: F.when(F.col("iteration") != POINT, F.col(m)) for m in ("roc_auc", "pr_auc")}
    return samples.agg(*[
        f for m, value in drawn.items() for f in (
            F.max(F.when(F.col("iteration") == POINT, F.col(m))).alias(m),
            F.percentile(value, F.lit(alpha)).alias(f"{m}_lower"), F.percentile(value, F.lit(1 - alpha)).alias(f"{m}_upper"),
            F.count(value).alias(f"{m}_n_valid"))
    ])
