"""Exact ranking metrics. Rows carry a 0/1 label and a score; `groups` is a parameter grid.

Rows are first counted per distinct score, then accumulated with `running_totals`, so
there is neither binning nor a global sort in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.scalar import f1, ratio
from stagewise.functions.vectors import SEVERITY
from stagewise.operators.blocks import hash_position, running_totals
from stagewise.session import keep

ALERT_STAGES = ["IAD", "LMEP", "IMP"]
N_THRESHOLDS = 99  # 0.01 .. 0.99


def score_curve(df: DataFrame, groups: list[str] | None = None, y: str = "label", score: str = "score",
                weight: Column | None = None) -> DataFrame:
    """Per distinct score: its positives and negatives, and both accumulated from the top."""
    w = F.lit(1) if weight is None else weight
    groups = groups or []
    counted = df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.col(y) * w).cast("bigint").alias("pos"), F.sum((1 - F.col(y)) * w).cast("bigint").alias("neg")
    )
    return running_totals(counted, groups, "score", ["pos", "neg"])


def curve_metrics(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; NULL with one class only."""
    defined = (F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)
    above = F.col("cum_pos") - F.col("pos")
    won = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    step = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return curve.groupBy(*(groups or [])).agg(
        F.max(F.col("tot_pos") + F.col("tot_neg")).alias("n_samples"), F.max("tot_pos").alias("n_positive"),
        F.when(defined, won / F.nullif(F.max(F.col("tot_pos") * F.col("tot_neg")).cast("double"), F.lit(0.0))).alias("roc_auc"),
        F.when(defined, step / F.nullif(F.max("tot_pos").cast("double"), F.lit(0.0))).alias("pr_auc"),
    )


def pr_points(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score used as threshold."""
    return curve.select(
        *(groups or []), "score",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
    )


def roc_points(curve: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return curve.select(
        *(groups or []), "score",
        ratio(F.col("cum_neg"), F.col("tot_neg")).alias("false_positive_rate"),
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("true_positive_rate"),
    )


def capture_at(df: DataFrame, percents: tuple, groups: list[str] | None = None, y: str = "label",
               score: str = "score", hash_key: str = "hash_key", curve: DataFrame | None = None) -> DataFrame:
    """Share of positives among the top max(1, ceil(n*p/100)) scores, per percent.

    Scores equal to the one at the cut are taken in hash order. Those above it come
    straight from the accumulated counts; only the tied rows at the cut are ranked.
    """
    ungrouped = not groups
    groups = groups or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if ungrouped else df
    curve = score_curve(rows, groups, y, score) if curve is None else curve
    n = F.col("tot_pos") + F.col("tot_neg")
    upto = F.col("cum_pos") + F.col("cum_neg")
    before = upto - F.col("pos") - F.col("neg")
    grid = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    k = F.greatest(F.lit(1), F.ceil(n * F.col("percent") / 100.0))
    cut = curve.withColumn("percent", grid).filter((before < k) & (k <= upto)).select(
        *groups, "percent", F.col("score").alias("_at"), (k - before).alias("_take"),
        (F.col("cum_pos") - F.col("pos")).alias("_sure"), F.col("tot_pos").alias("_positives"),
    )
    cut_keys = F.broadcast(cut)  # one row per group and percent
    tied = rows.select(*groups, F.col(y).alias("_y"), F.col(score).alias("_score"), hash_key).join(cut_keys, groups).filter(
        F.col("_score") == F.col("_at")
    )
    taken = hash_position(tied, hash_key, [*groups, "percent"]).groupBy(*groups, "percent").agg(
        F.sum(F.when(F.col("hash_pos") < F.col("_take"), F.col("_y")).otherwise(0)).alias("_tied"),
        F.first("_sure").alias("_sure"), F.first("_positives").alias("_positives"),
    )
    return taken.select(
        *([] if ungrouped else groups), "percent",
        ((F.col("_sure") + F.col("_tied")) / F.nullif(F.col("_positives").cast("double"), F.lit(0.0))).alias("capture"),
    )


def forecast_metrics(df: DataFrame, percents: tuple, groups: list[str] | None = None, threshold: float = 0.5,
                     y: str = "label", score: str = "score") -> DataFrame:
    """The full bundle per group; all ranking metrics are NULL, with a note, for a single class."""
    groups = groups or ["_all"]
    rows = df if "_all" not in groups else df.withColumn("_all", F.lit(0))
    curve = keep(score_curve(rows, groups, y, score))
    ranked = curve_metrics(curve, groups)
    hit = F.col(score) >= threshold
    fixed = rows.groupBy(*groups).agg(f1(
        F.count(F.when(hit & (F.col(y) == 1), True)), F.count(F.when(hit & (F.col(y) == 0), True)),
        F.count(F.when(~hit & (F.col(y) == 1), True)),
    ).alias("f1"))
    captured = capture_at(rows, percents, groups, y, score, curve=curve).groupBy(*groups).agg(*[
        F.max(F.when(F.col("percent") == float(p), F.col("capture"))).alias(f"capture_at_{p}pct") for p in percents
    ])
    out = ranked.join(fixed, groups).join(captured, groups)
    mixed = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_samples"))
    guarded = ["f1"] + [f"capture_at_{p}pct" for p in percents]
    return out.select(
        *[c for c in out.columns if c not in guarded and c != "_all"],
        *[F.when(mixed, F.col(c)).alias(c) for c in guarded],
        F.when(~mixed, "insufficient class diversity").alias("note"),
    )


def one_vs_rest(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (…, stage, label, score), one per alert stage, from a probability array."""
    cells = F.array(*[
        F.struct(F.lit(s).alias("stage"), (F.col("y") == SEVERITY[s]).cast("int").alias("label"),
                 F.element_at("proba", SEVERITY[s] + 1).alias("score"))
        for s in ALERT_STAGES
    ])
    return scored.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def _thresholds_passed(score: Column) -> Column:
    """How many of the grid thresholds k/100 lie at or below the score (exact at the borders)."""
    guess = F.floor(score * 100).cast("int")
    fixed = F.when(score >= (guess + 1) / F.lit(100.0), guess + 1).when(
        score < guess / F.lit(100.0), guess - 1).otherwise(guess)
    return F.least(F.greatest(fixed, F.lit(0)), F.lit(N_THRESHOLDS))


def validation_thresholds(ovr: DataFrame) -> DataFrame:
    """Per stage the grid threshold with the best F1 on VAL rows only; the lowest wins a tie.

    0.5 for a stage without positives. At most 100 buckets per stage leave the scan.
    """
    buckets = ovr.filter(F.col("split") == "val").groupBy(
        "stage", _thresholds_passed(F.col("score")).alias("passed")
    ).agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    totals = buckets.groupBy("stage").agg(F.sum("pos").alias("all_pos"))
    at = buckets.filter("passed >= 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("passed")))).groupBy(
        "stage", "step").agg(F.sum("pos").alias("tp"), F.sum(F.col("n") - F.col("pos")).alias("fp"))
    scored = at.join(F.broadcast(totals), "stage").withColumn(
        "f1", f1(F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp"))
    )
    best = scored.withColumn("_rn", F.row_number().over(
        Window.partitionBy("stage").orderBy(F.desc("f1"), "step"))).filter("_rn = 1")
    return totals.join(best.select("stage", "step"), "stage", "left").select(
        "stage", F.when(F.col("all_pos") == 0, F.lit(0.5)).otherwise(
            F.coalesce(F.col("step"), F.lit(1)) / F.lit(100.0)).alias("threshold"),
    )


def alerting_metrics(ovr: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per (stage, split): precision, recall, F1 at the val threshold, and average precision."""
    groups = ["stage", "split"]
    marked = ovr.join(F.broadcast(thresholds), "stage")
    hit = F.col("score") >= F.col("threshold")
    tp = F.count(F.when(hit & (F.col("label") == 1), True))
    fp = F.count(F.when(hit & (F.col("label") == 0), True))
    fn = F.count(F.when(~hit & (F.col("label") == 1), True))
    at = marked.groupBy(*groups).agg(
        F.max("threshold").alias("threshold"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"), F.sum("label").cast("bigint").alias("n_positive"), F.count("*").alias("n_total"),
    )
    area = curve_metrics(score_curve(ovr, groups), groups).select(*groups, "pr_auc")
    return at.join(area, groups)
