"""Stage classifiers and the impact forecaster on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.vectors import STAGES, argmax, mean_of, pad, total
from stagewise.operators import metrics
from stagewise.operators.graph import induced_subgraph
from stagewise.operators.propagation import attend_vectors, convolve_vectors, mean_vectors
from stagewise.operators.splits import attach_folds
from stagewise.session import cut_lineage, cut_step, is_cut

KEY = ["asset_id", "window_id"]
N = len(STAGES)
ROWS_A_TASK = 200_000  # rows that a task of an iterative linear fit passes over
ROWS_SIDE_BY_SIDE = 12_000_000  # rows of all fits that run at a time: each keeps its own in its own form

# Model parameters of the published configuration (depth 30 is Spark's limit for unlimited).
FOREST = {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 2}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8}
META_LR = {"maxIter": 2000, "tol": 1e-4, "standardization": False}
META_MLP = {"hidden": [32], "maxIter": 500}
META_BOOSTED = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.05}

# A fitted scorer: rows with column `vec` -> rows plus 4-entry array column `proba`.
Scorer = Callable[[DataFrame], DataFrame]


def vectorized(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("vec", array_to_vector(F.col(x)))


def weighted(train: DataFrame, kind: str = "balanced_weight") -> DataFrame:
    """Class-balanced row weight; the four weights become literals."""
    weight = F.lit(None).cast("double")
    for r in metrics.class_weights(train).select("y", F.col(kind).alias("w")).collect():
        weight = F.when(F.col("y") == r.y, F.lit(r.w)).otherwise(weight)
    return train.withColumn("weight", weight)


def _spark_scorer(model) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        helpers = ["rawPrediction", "probability", "prediction"]
        return model.transform(df).withColumn("proba", pad(vector_to_array("probability"))).drop(*helpers)

    return score


def fit_forest(train: DataFrame, seed: int, **params) -> Scorer:
    rf = RandomForestClassifier(featuresCol="vec", labelCol="y", weightCol="weight", seed=seed, **{**FOREST, **params})
    return _spark_scorer(rf.fit(weighted(train)))


def fit_boosted(train: DataFrame, seed: int, balanced: bool = False, **params) -> Scorer:
    """Four one-against-rest boosted models; their probabilities are normalised to sum to 1.

    Classes absent from train get probability 0. The fits run side by side as long as their rows are few.
    """
    rows = weighted(train) if balanced else train.withColumn("weight", F.lit(1.0))
    counts = {int(r.y): r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    seen = sorted(counts)

    def one(k: int):
        gbt = GBTClassifier(featuresCol="vec", labelCol="is_k", weightCol="weight", seed=seed, **{**BOOSTED, **params})
        return gbt.fit(rows.withColumn("is_k", (F.col("y") == k).cast("double")))

    if len(seen) > 1:
        with ThreadPoolExecutor(_side_by_side(N, sum(counts.values()))) as pool:
            fitted = dict(zip(seen, pool.map(one, seen)))
    else:
        fitted = {}

    def score(df: DataFrame) -> DataFrame:
        out = df
        for k, model in fitted.items():
            out = model.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop(
                "rawPrediction", "probability", "prediction")
        constant = lambda k: F.lit(1.0 if k in seen else 0.0)
        raw = F.array(*[F.col(f"_p{k}") if k in fitted else (F.lit(0.0) if fitted else constant(k)) for k in range(N)])
        return out.withColumn("_raw", raw).withColumn(
            "proba", F.transform("_raw", lambda v: v / F.greatest(total(F.col("_raw")), F.lit(1e-300)))
        ).drop("_raw", *[f"_p{k}" for k in fitted])

    return score


def _side_by_side(fits: int, n: int) -> int:
    """How many of the fits over n rows each run at a time."""
    return max(1, min(fits, ROWS_SIDE_BY_SIDE // max(n, 1)))


def fit_logistic(train: DataFrame, seed: int = 0, balanced: bool = True, **params) -> Scorer:
    """Multinomial regression with unit inverse penalty: 1/n in Spark's per-row scaling."""
    rows = weighted(train) if balanced else train.withColumn("weight", F.lit(1.0))
    n = train.count()
    lr = LogisticRegression(featuresCol="vec", labelCol="y", weightCol="weight", family="multinomial",
                            **{**META_LR, "regParam": 1.0 / max(n, 1), **params})
    return _spark_scorer(lr.fit(_gathered(rows, n)))


def _gathered(rows: DataFrame, n: int) -> DataFrame:
    """The rows in partitions worth a task each: a fit runs over them a hundred times, and a small task costs as much as its work."""
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))
    return rows.coalesce(wanted)


def fit_perceptron(train: DataFrame, seed: int, hidden: list[int] | None = None, **params) -> Scorer:
    width = len(train.select("vec").first().vec)
    layers = [width, *(hidden or META_MLP["hidden"]), N]
    mlp = MultilayerPerceptronClassifier(featuresCol="vec", labelCol="y", layers=layers, seed=seed,
                                         **{"maxIter": META_MLP["maxIter"], **params})
    return _spark_scorer(mlp.fit(train))


META_FITS = {
    "logistic_regression": fit_logistic,
    "mlp": fit_perceptron,
    "gradient_boosting": lambda train, seed, **p: fit_boosted(train, seed, **{**META_BOOSTED, **p}),
}


def fit_meta(train: DataFrame, kind: str, seed: int = 42, **params) -> Scorer:
    if kind not in META_FITS:
        raise ValueError(f"unknown meta-learner '{kind}'")
    return META_FITS[kind](train, seed, **params)


PROPAGATIONS = {
    "convolve": convolve_vectors,
    "mean": mean_vectors,
    "attend": attend_vectors,
}


def graph_features(rows: DataFrame, edges: DataFrame, kind: str = "convolve") -> DataFrame:
    """Propagate the feature array `x` over the edges; result in `gx`. The plan does not grow with the array."""
    return PROPAGATIONS[kind](rows, edges).withColumnRenamed("x", "gx")


def fit_graph_classifier(rows: DataFrame, edges: DataFrame, kind: str, seed: int,
                         on: Column | None = None, **params) -> DataFrame:
    """Propagate, fit on train rows (or those selected by `on`), and score every row. The features are not among the result's columns."""
    named = rows.drop("x", "vec")
    spread = cut_step(lambda: named.join(graph_features(rows, edges, kind), KEY)).withColumn("vec", array_to_vector("gx"))
    fit = fit_logistic(spread.filter(F.col("split") == "train" if on is None else on), seed, **{"maxIter": 100, **params})
    return fit(spread).drop("vec", "gx")


def base_scores(rows: DataFrame, edges: DataFrame, width: int | None = None, n_folds: int = 5, seed: int = 42,
                forest: dict | None = None, kind: str = "convolve") -> DataFrame:
    """(KEY, split, y, proba, gproba): forest and graph scores, out-of-fold on train.

    Val and test rows are scored by models fitted on all train rows. Folds are
    asset-disjoint, and out-of-fold graph scores use the subgraph among train nodes, so
    features of val and test assets cannot reach them. Fold fits run side by side as long as their rows are few. The width of `x` is taken from the rows.
    Vectors are made from the arrays where they are read, and what led to a table of scores is dropped once that is written.
    """
    return cut_step(lambda: _base_scores(rows, edges, n_folds, seed, forest or {}, kind))


def _base_scores(rows: DataFrame, edges: DataFrame, n_folds: int, seed: int, forest: dict, kind: str) -> DataFrame:
    rows = rows if is_cut(rows) else cut_lineage(rows)
    train, held_out = (vectorized(rows.filter(f"split {sign} 'train'")) for sign in ("=", "<>"))
    wanted = [*KEY, "split", "y", "proba"]

    graph_full = cut_step(lambda: fit_graph_classifier(rows, edges, kind, seed).filter("split <> 'train'").select(*wanted))
    forest_full = cut_step(lambda: fit_forest(train, seed, **forest)(held_out).select(*wanted))

    def spread_train() -> DataFrame:
        inner = cut_lineage(induced_subgraph(edges, train))
        folded = attach_folds(train.drop("vec"), n_folds, seed)
        return folded.join(graph_features(train, inner, kind), KEY)

    spread = cut_step(spread_train).withColumns({"vec": array_to_vector("x"), "gvec": array_to_vector("gx")})
    last, n = spread.agg(F.max("fold"), F.count("*")).first()
    n_eff = last + 1

    def one_fold(i: int):
        fit_rows, out_rows = spread.filter(F.col("fold") != i), spread.filter(F.col("fold") == i)
        f = fit_forest(fit_rows, seed, **forest)(out_rows).select(*wanted)
        swap = lambda d: d.drop("vec").withColumnRenamed("gvec", "vec")
        g = fit_logistic(swap(fit_rows), seed, maxIter=100)(swap(out_rows)).select(*wanted)
        return f, g

    with ThreadPoolExecutor(_side_by_side(min(4, n_eff), n)) as pool:
        parts = list(pool.map(one_fold, range(n_eff)))
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b), dfs)
    graph_all = union([graph_full] + [g for _, g in parts]).select(*KEY, F.col("proba").alias("gproba"))
    return union([forest_full] + [f for f, _ in parts]).join(graph_all, KEY)


def stacked(base: DataFrame, meta: str = "logistic_regression", seed: int = 42, **params) -> DataFrame:
    """Meta-learner on both score vectors, fitted on the out-of-fold train rows."""
    rows = base.withColumn("vec", array_to_vector(F.concat("proba", "gproba"))).drop("proba", "gproba")
    scorer = fit_meta(rows.filter("split = 'train'"), meta, seed, **params)
    return scorer(rows).select(*KEY, "split", "y", "proba")


def base_views(base: DataFrame) -> dict[str, DataFrame]:
    """The single models and their late fusion as scored rows."""
    wanted = [*KEY, "split", "y"]
    return {
        "forest": base.select(*wanted, "proba"),
        "graph": base.select(*wanted, F.col("gproba").alias("proba")),
        "late_fusion": base.select(*wanted, mean_of(F.col("proba"), F.col("gproba")).alias("proba")),
    }


def history_rows(with_x: DataFrame, columns: list[str], max_seq_len: int) -> DataFrame:
    """Own-past summary per (asset, window): last, mean, max, change, count. Output in `hx`."""
    from stagewise.operators.blocks import timeline
    from stagewise.operators.sequences import prefix_stats

    placed = prefix_stats(timeline(with_x), max_seq_len, columns)
    made = [f"{c}__hist_{s}" for c in columns for s in ("mean", "max", "delta")]
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*columns, *made, "history_len"]]
    return placed.withColumn("hx", F.array(*parts))


def fit_history_classifier(with_x: DataFrame, columns: list[str], max_seq_len: int, seed: int, **params) -> DataFrame:
    rows = cut_lineage(history_rows(with_x, columns, max_seq_len).withColumn("vec", array_to_vector("hx")))
    return fit_logistic(rows.filter("split = 'train'"), seed, **{"maxIter": 100, **params})(rows).select(
        *KEY, "split", "y", "proba")


def forecaster_rows(cuts: DataFrame, streams: list[str], max_seq_len: int) -> DataFrame:
    """Per cut: last, mean and max of every gated stream column over the prefix, in `fx`."""
    from stagewise.operators.blocks import look_back

    builds = {}
    for c in streams:
        builds[f"{c}__mean"] = lambda w, c=c: F.avg(c).over(w)
        builds[f"{c}__max"] = lambda w, c=c: F.max(c).over(w)
    seen = look_back(cuts, max_seq_len, builds)
    return seen.withColumn("fx", F.array(*[F.col(c).cast("double") for c in [*streams, *builds]]))


def fit_forecaster(rows: DataFrame, seed: int = 42, **params) -> DataFrame:
    """P(impact within the horizon) for every row, positives weighted by neg/pos of train."""
    rows = cut_lineage(rows.withColumn("vec", array_to_vector("fx")))
    train = rows.filter("split = 'train'")
    w = metrics.positive_weight(train).first().pos_weight
    weighted_rows = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(w)).otherwise(F.lit(1.0)))
    lr = LogisticRegression(featuresCol="vec", labelCol="label", weightCol="weight", **{"maxIter": 100, "regParam": 1e-4, **params})
    return lr.fit(weighted_rows).transform(rows).withColumn("score", vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction", "vec", "fx")


def with_prediction(scored: DataFrame) -> DataFrame:
    return scored.withColumn("pred", argmax(F.col("proba")))


def tune(train: DataFrame, evaluate: DataFrame, model: str, grid: list[dict], fit) -> DataFrame:
    """(model, grid_no, params, val_score, test_score) for each grid point on the given split."""
    parts = []
    for i, params in enumerate(grid):
        scored = with_prediction(fit(train, **params)(evaluate))
        wide = metrics.macro_metrics(scored, ["split"]).groupBy().agg(
            F.max(F.when(F.col("split") == "val", F.col("macro_f1_present"))).alias("val_score"),
            F.max(F.when(F.col("split") == "test", F.col("macro_f1_present"))).alias("test_score"))
        parts.append(wide.select(F.lit(model).alias("model"), F.lit(i).alias("grid_no"),
                                 F.lit(str(params)).alias("params"), "val_score", "test_score"))
    return reduce(lambda a, b: a.unionByName(b), parts)
