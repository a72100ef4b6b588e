"""Classification metrics over labelled rows. Columns `y` and `pred` hold severities 0..3.

Everything goes through one row of 16 confusion counts per group, so a group of any
size is reduced before the shuffle and several models and splits share one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.scalar import f1, ratio
from stagewise.functions.vectors import STAGES, stage_of

N = len(STAGES)


def cell(y: int, p: int) -> str:
    return f"c{y}{p}"


CELLS = [cell(i, j) for i in range(N) for j in range(N)]


def confusion_counts(by: list[str] | None = None, df: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """One row per group with the 16 cell counts as columns c<y><pred>."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*(by or [])).agg(*[
        F.coalesce(F.sum(F.when((F.col("y") == i) & (F.col("pred") == j), w)), F.lit(0)).cast("bigint").alias(cell(i, j))
        for i in range(N) for j in range(N)
    ])


def confusion_matrix(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long form with all 16 cells and the share of each cell in its row (0 for an empty row)."""
    by = by or []
    wide = confusion_counts(by, df)
    rows = F.array(*[
        F.struct(F.lit(STAGES[i]).alias("actual"), F.lit(STAGES[j]).alias("predicted"), F.col(cell(i, j)).alias("n"),
                 ratio(F.col(cell(i, j)), sum(F.col(cell(i, k)) for k in range(N))).alias("row_share"))
        for i in range(N) for j in range(N)
    ])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def _class_parts(k: int) -> tuple[Column, Column, Column]:
    tp = F.col(cell(k, k))
    fp = sum(F.col(cell(i, k)) for i in range(N) if i != k)
    fn = sum(F.col(cell(k, j)) for j in range(N) if j != k)
    return tp, fp, fn


def class_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per class: precision, recall, F1, support; 0 where undefined."""
    by = by or []
    rows = []
    for k, name in enumerate(STAGES):
        tp, fp, fn = _class_parts(k)
        rows.append(F.struct(
            F.lit(name).alias("stage"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
            f1(tp, fp, fn).alias("f1"), (tp + fn).alias("support"), (tp + fp).alias("n_predicted"),
        ))
    return confusion_counts(by, df).select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def macro_f1_of_cells() -> Column:
    """Mean F1 over all classes, as an expression over the cell columns."""
    return sum(f1(*_class_parts(k)) for k in range(N)) / N


def present_macro_f1_of_cells() -> Column:
    """Mean F1 over the classes that occur as label or prediction."""
    seen = lambda k: (sum(_class_parts(k)) > 0).cast("int")
    return ratio(sum(f1(*_class_parts(k)) for k in range(N)), sum(seen(k) for k in range(N)))


def macro_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro scores over all four classes, and F1 over the classes present."""
    wide = confusion_counts(by, df)
    mean = lambda pick: sum(pick(*_class_parts(k)) for k in range(N)) / N
    return wide.select(
        *(by or []), sum(F.col(c) for c in CELLS).alias("n_samples"),
        mean(lambda tp, fp, fn: ratio(tp, tp + fp)).alias("macro_precision"),
        mean(lambda tp, fp, fn: ratio(tp, tp + fn)).alias("macro_recall"),
        macro_f1_of_cells().alias("macro_f1"),
        present_macro_f1_of_cells().alias("macro_f1_present"),
    )


def long_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Class metrics as (…, stage, metric, value) rows."""
    return class_metrics(df, by).unpivot(
        [*by, "stage"], ["precision", "recall", "f1"], "metric", "value"
    )


def mean_brier(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score of each class against the rest, averaged. `proba` is the 4-entry array."""
    per_class = [
        F.avg(F.pow(F.element_at("proba", k + 1) - (F.col("y") == k).cast("double"), 2)) for k in range(N)
    ]
    return df.groupBy(*(by or [])).agg((sum(per_class) / N).alias("mean_brier"))


def class_weights(labels: DataFrame, y: str = "y") -> DataFrame:
    """Both weightings per class: fixed class count with empty classes clamped, and `balanced`."""
    wide = labels.agg(F.count("*").alias("n"), *[F.count(F.when(F.col(y) == k, True)).alias(f"n{k}") for k in range(N)])
    present = sum((F.col(f"n{k}") > 0).cast("int") for k in range(N))
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("y"), F.col(f"n{k}").alias("n_class"),
            (F.col("n") / (N * F.greatest(F.col(f"n{k}"), F.lit(1)))).alias("fixed_weight"),
            (F.col("n") / F.nullif((present * F.col(f"n{k}")).cast("double"), F.lit(0.0))).alias("balanced_weight"),
        ) for k in range(N)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def positive_weight(labels: DataFrame, label: str = "label") -> DataFrame:
    pos = F.coalesce(F.sum(F.col(label)), F.lit(0))
    return labels.agg(((F.count("*") - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def over_seeds(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation of a metric over seeds."""
    return results.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count(value).alias("n_seeds"),
    )


def pivot_results(results: DataFrame, row: str, column: str, names: list[str], value: str) -> DataFrame:
    return results.groupBy(row).pivot(column, names).agg(F.first(value))


def best_by_validation(results: DataFrame, model: str = "model", order: str = "grid_no") -> DataFrame:
    """Per model the row with the best val score; the earliest grid point wins a tie."""
    w = Window.partitionBy(model).orderBy(F.desc("val_score"), order)
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def stage_names(df: DataFrame) -> DataFrame:
    return df.withColumn("stage_label", stage_of(F.col("y")))
