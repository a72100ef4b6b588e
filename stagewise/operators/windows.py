"""(asset, window) instances and the interactions between assets."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.scalar import quoted
from stagewise.functions.timecols import window_id
from stagewise.functions.vectors import stage_of

NUMERIC_SUFFIXES = ("__mean", "__std", "__max", "__sum", "__nunique")


def with_window(records: DataFrame, delta_t_seconds: float) -> DataFrame:
    return records.withColumn("window_id", window_id(F.col("timestamp"), delta_t_seconds))


def numeric_aggregates(columns: list[str]) -> list[Column]:
    """mean / sample std (0 for one value) / max / sum (0 if all missing) per column."""
    out = []
    for c in columns:
        x = quoted(c)
        out += [
            F.avg(x).alias(f"{c}__mean"),
            F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{c}__std"),
            F.max(x).alias(f"{c}__max"),
            F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{c}__sum"),
        ]
    return out


def instances(
    records: DataFrame, numeric: list[str], categorical: list[str], keys: list[str] | None = None
) -> DataFrame:
    """One row per (asset, window) with aggregated features and the worst stage.

    `records` needs asset_id, window_id, timestamp and severity. `keys` may hold further leading columns, e.g. a
    sweep parameter. {c}__nunique and {c}__mode count a column's values; the smallest value wins a tie.

    Numbers and categories go separate ways: a record moves its numbers once, and only a count for each categorical value it
    has. Values are counted on (group, column, value) first, so a group with very many distinct values is spread out and
    pre-counted before its final row forms.
    """
    keys = keys or ["asset_id", "window_id"]
    whole = records.groupBy(*keys).agg(
        F.count("*").alias("n_records"),
        F.min("timestamp").alias("window_start_time"),
        *numeric_aggregates(numeric),
        F.max("severity").alias("severity"),
    )
    if categorical:
        named = [f"_key_{i}" for i in range(len(keys))]
        counted = _texts(records, keys, categorical).groupBy(*keys, "_feature", "_text").agg(F.count("*").alias("n_records"))
        texts = counted.groupBy(*keys).agg(*_text_features(categorical)).withColumnsRenamed(dict(zip(keys, named)))
        met = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)])
        joined = whole.join(texts, met, "left").drop(*named)
        whole = joined.withColumns({f"{c}__nunique": F.coalesce(quoted(f"{c}__nunique"), F.lit(0).cast("bigint")) for c in categorical})
    return whole.withColumn("stage_label", stage_of(F.col("severity")))


def _texts(records: DataFrame, keys: list[str], categorical: list[str]) -> DataFrame:
    """One row for each categorical value that a record has."""
    texts = [F.struct(F.lit(i).alias("feature"), quoted(c).cast("string").alias("text")) for i, c in enumerate(categorical)]
    cells = records.select(*keys, F.explode(F.array(*texts)).alias("_cell")).filter(F.col("_cell.text").isNotNull())
    return cells.select(*keys, F.col("_cell.feature").alias("_feature"), F.col("_cell.text").alias("_text"))


def _text_features(categorical: list[str]) -> list[Column]:
    """Distinct count and mode of each column over counted values."""
    out = []
    for i, c in enumerate(categorical):
        mine = F.col("_feature") == i
        out += [
            F.count(F.when(mine, True)).alias(f"{c}__nunique"),
            F.min(F.when(mine, F.struct(-F.col("n_records"), F.col("_text")))).getField("_text").alias(f"{c}__mode"),
        ]
    return out


def _cells(records: DataFrame, keys: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """A record's cells: one for its numbers (feature -1), and one for each categorical value it has."""
    used = [c for c in dict.fromkeys(["timestamp", "severity", *numeric]) if c not in keys]
    texts = [F.struct(F.lit(i).alias("feature"), quoted(c).cast("string").alias("text")) for i, c in enumerate(categorical)]
    cells = records.select(*keys, *[quoted(c) for c in used], F.explode(F.array(
        F.struct(F.lit(-1).alias("feature"), F.lit(None).cast("string").alias("text")), *texts)).alias("_cell"))
    numbers = F.col("_cell.feature") < 0
    return cells.filter(numbers | F.col("_cell.text").isNotNull()).select(
        *keys, F.col("_cell.feature").alias("_feature"), F.col("_cell.text").alias("_text"),
        *[F.when(numbers, quoted(c)).alias(c) for c in used])


def _gathered(counted: DataFrame, keys: list[str], categorical: list[str]) -> DataFrame:
    """The final row of each group from its counted cells."""
    made = [c for c in counted.columns if c not in [*keys, "_feature", "_text"]]
    own = F.col("_feature") < 0
    picked = [*[F.max(F.when(own, quoted(c))).alias(c) for c in made], *_text_features(categorical)]
    return counted.groupBy(*keys).agg(*picked).withColumn("stage_label", stage_of(F.col("severity")))


def window_labels(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Only what sequences, edges and counts need: (asset, window) with its worst stage."""
    return records.groupBy(*(keys or ["asset_id", "window_id"])).agg(
        F.max("severity").alias("severity")
    ).withColumn("stage_label", stage_of(F.col("severity")))


def record_level_instances(records: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One instance per record: every aggregate is trivial, so this is a projection without a shuffle.

    `window_id` is the record id of the source, or else Spark's row id over the scan.
    """
    record_id = F.col("record_id") if "record_id" in records.columns else F.monotonically_increasing_id()
    features = []
    for c in numeric:
        x = quoted(c)
        features += [
            x.alias(f"{c}__mean"), F.lit(0.0).alias(f"{c}__std"), x.alias(f"{c}__max"),
            F.coalesce(x, F.lit(0.0)).alias(f"{c}__sum"),
        ]
    for c in categorical:
        features += [
            quoted(c).isNotNull().cast("bigint").alias(f"{c}__nunique"), quoted(c).alias(f"{c}__mode"),
        ]
    return records.select(
        "asset_id", record_id.alias("window_id"), F.lit(1).cast("bigint").alias("n_records"),
        F.col("timestamp").alias("window_start_time"), *features, "severity", "stage_label",
    )


def finest_width(widths: tuple) -> int:
    """Seconds that all widths are multiples of; 1 where one is fractional, as times count in whole seconds there."""
    whole = all(float(w).is_integer() for w in widths)
    return gcd(*[int(w) for w in widths]) if whole else 1


def _wider(widths: tuple, fine: int) -> Column:
    """(delta_t, window_id) of each width for a cell of width `fine` that begins at _fine * fine seconds."""
    start = (F.col("_fine") * fine).cast("double")
    return F.explode(F.array(*[
        F.struct(F.lit(float(w)).alias("delta_t"), F.floor(start / F.lit(float(w))).cast("bigint").alias("window_id")) for w in widths
    ]))


def _merged_std(parts: Column) -> Column:
    """Sample standard deviation from (count, mean, squares around the mean) of parts, merged pair by pair in order of
    their cells: no difference of large sums is ever taken. 0 for one value or none."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def meet(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"),
            (a["squares"] + b["squares"] + gap * gap * (a["n"].cast("double") * b["n"] / n)).alias("squares"))

    return F.aggregate(F.array_sort(parts), zero, meet, lambda a: F.when(a["n"] > 1, F.sqrt(a["squares"] / (a["n"] - 1))).otherwise(0.0))


def delta_t_sweep(
    records: DataFrame, widths: tuple, numeric: list[str], categorical: list[str]
) -> DataFrame:
    """Instances for several window widths; the width is a key column.

    Records are aggregated once, to mergeable cells of the finest width. Only cells are repeated per width; a wide
    window takes in at most width / finest width of them.
    """
    fine = finest_width(widths)
    keys = ["delta_t", "asset_id", "window_id"]
    own = F.col("_feature") < 0
    placed = records.withColumn("_fine", window_id(F.col("timestamp"), float(fine)))
    names = [f"_{i}" for i in range(len(numeric))]
    numbers = []
    for c, name in zip(numeric, names):
        x = quoted(c)
        part = F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"))
        numbers += [part.alias(f"{name}p"), F.max(x).alias(f"{name}m"), F.sum(x).alias(f"{name}s")]
    cells = _cells(placed, ["asset_id", "_fine"], numeric, categorical).groupBy("asset_id", "_fine", "_feature", "_text").agg(
        F.count("*").alias("n_records"), F.min("timestamp").alias("window_start_time"), F.max("severity").alias("severity"), *numbers)
    swept = cells.withColumn("_wide", _wider(widths, fine)).select("*", "_wide.*").drop("_wide")
    merged = [F.sum("n_records").alias("n_records"), F.min("window_start_time").alias("window_start_time"), F.max("severity").alias("severity")]
    for name in names:
        part = F.col(f"{name}p")
        held = F.when(own & (part["n"] > 0), F.struct("_fine", part["n"].alias("n"), part["mean"].alias("mean"), part["squares"].alias("squares")))
        merged += [F.collect_list(held).alias(f"{name}p"), F.max(f"{name}m").alias(f"{name}m"), F.sum(f"{name}s").alias(f"{name}s"),
                   F.sum(F.when(own, part["n"])).alias(f"{name}n")]
    wide = swept.groupBy(*keys, "_feature", "_text").agg(*merged)
    features = []
    for c, name in zip(numeric, names):
        features += [
            (F.col(f"{name}s") / F.nullif(F.col(f"{name}n"), F.lit(0))).alias(f"{c}__mean"), F.when(own, _merged_std(F.col(f"{name}p"))).alias(f"{c}__std"),
            F.col(f"{name}m").alias(f"{c}__max"), F.when(own, F.coalesce(F.col(f"{name}s"), F.lit(0.0))).alias(f"{c}__sum"),
        ]
    counted = wide.select(*keys, "_feature", "_text", "n_records", "window_start_time", *features, "severity")
    return _gathered(counted, keys, categorical)


def sweep_labels(records: DataFrame, widths: tuple) -> DataFrame:
    """(delta_t, asset, window) with its worst stage, merged from labels of the finest width."""
    fine = finest_width(widths)
    cells = records.groupBy("asset_id", window_id(F.col("timestamp"), float(fine)).alias("_fine")).agg(F.max("severity").alias("severity"))
    swept = cells.withColumn("_wide", _wider(widths, fine)).select("asset_id", "severity", "_wide.*")
    return window_labels(swept, ["delta_t", "asset_id", "window_id"])


def feature_columns(columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns of an instance table, told by suffix."""
    numeric = [c for c in columns if c.endswith(NUMERIC_SUFFIXES)]
    return numeric + [c for c in columns if c == "n_records"], [c for c in columns if c.endswith("__mode")]


def interactions(records: DataFrame) -> DataFrame:
    """Distinct (asset, peer, window) contacts."""
    return records.filter(F.col("peer_id").isNotNull()).select("asset_id", "peer_id", "window_id").distinct()


def count_stages(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per stage with zeros kept."""
    from stagewise.functions.vectors import STAGES

    by = by or []
    pivoted = df.groupBy(*by).agg(*[
        F.count(F.when(F.col("stage_label") == s, True)).alias(s) for s in STAGES
    ])
    cells = F.array(*[F.struct(F.lit(s).alias("stage_label"), F.col(s).alias("n")) for s in STAGES])
    return pivoted.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")


def split_stage_crosstab(df: DataFrame) -> DataFrame:
    """One row per split, one column per stage."""
    from stagewise.functions.vectors import STAGES

    return df.groupBy("split").pivot("stage_label", STAGES).count().na.fill(0, STAGES)


def chronology_violations(instance_rows: DataFrame, block: int = 4096) -> DataFrame:
    """Windows of an asset whose start lies before that of the preceding window (none expected)."""
    from stagewise.operators.blocks import timeline

    seen = timeline(instance_rows.select("asset_id", "window_id", "window_start_time"), block=block,
                    carry={"window_start_time": "previous_start"})
    return seen.filter(F.col("window_start_time") < F.col("previous_start")).select(
        "asset_id", "window_id"
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
