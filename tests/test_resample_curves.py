"""Array-weight bootstrap against copying the rows of each resample."""

import random

import numpy as np
import pytest

from stagewise.operators import bootstrap, resample_curves as rc
from pyspark.sql import functions as F

METRICS = [rc.roc_auc(), rc.pr_auc(), rc.capture(5), rc.capture(50), rc.f1_at(0.5)]


def copied(rows, seed, iterations):
    """Every metric of every resample, one row copy at a time."""
    from hashlib import md5

    out = {}
    for it in [-1, *range(iterations)]:
        drawn = []
        for unit, label, score in rows:
            if label is None or score is None or score != score:
                continue
            text = f"{seed}|{it}" + ("" if unit is None else f"|{unit}")
            u = int(md5(text.encode()).hexdigest()[:8], 16) / 2 ** 32
            times = 1 if it < 0 else sum(u >= edge for edge in rc.POISSON_CDF)
            tie = md5((f"{seed}" + ("" if unit is None else f"|{unit}")).encode()).hexdigest()
            drawn += [(-score, tie, -label)] * times
        drawn.sort()
        y = np.array([-d[2] for d in drawn])
        s = np.array([-d[0] for d in drawn])
        n, pos = len(y), int(y.sum())
        roc = ap = None
        if 0 < pos < n:
            gap = s[y == 1][:, None] - s[y == 0][None, :]
            roc = ((gap > 0).sum() + (gap == 0).sum() / 2) / gap.size
            ap = sum((y[s == t].sum()) * y[s >= t].sum() / (s >= t).sum() for t in set(s)) / pos
        caps = [y[:max(1, int(np.ceil(n * p / 100.0)))].sum() / pos if pos else None for p in (5, 50)]
        tp, fp = y[s >= 0.5].sum(), (1 - y[s >= 0.5]).sum()
        f = (2 * tp / (tp + fp + pos) if tp + fp + pos else 0.0) if n else None
        out[it] = [roc, ap, *caps, f]
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
def test_equals_copied_rows(spark, hot, partitions):
    rng = random.Random(int(hot * 10))
    rows = [(None if rng.random() < .02 else f"a{rng.randint(0, 90)}", int(rng.random() < .3), .5 if rng.random() < hot else rng.randint(0, 20) / 20) for _ in range(900)]
    rows += [("a1", None, .3), ("a2", 1, None), ("a3", 0, float("nan"))]
    df = spark.createDataFrame(rows, "asset_id string, label int, score double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.iteration: list(r)[1:] for r in rc.curve_samples(df, METRICS, 130, 7).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = copied(rows, 7, 130)
    assert got.keys() == want.keys()
    for it, values in want.items():
        assert got[it] == pytest.approx(values, abs=1e-9), it


def test_one_class_and_empty(spark):
    schema = "asset_id string, label int, score double"
    none = rc.curve_intervals(spark.createDataFrame([], schema), METRICS, 20).collect()
    assert none == []
    ones = {r.metric: r for r in rc.curve_intervals(spark.createDataFrame([("a", 1, .9), ("b", 1, .2)], schema), METRICS, 50).collect()}
    assert ones["roc_auc"].point is None and ones["roc_auc"].n_valid_iterations == 0
    assert ones["capture_at_50pct"].point == 0.5 and 0 < ones["capture_at_50pct"].n_valid_iterations < 50
    assert {r.n_unique_units for r in ones.values()} == {2}


def test_any_metric(spark):
    """A metric of the caller's own: the share of positives above a score of a half."""
    own = rc.CurveMetric("own", lambda at: [(at.pos * (at.score > .5)[:, None]).sum(0)], lambda sums, pos, neg: sums[0] / np.maximum(pos, 1))
    df = spark.createDataFrame([(f"a{i}", i % 2, i / 40) for i in range(40)], "asset_id string, label int, score double")
    row = rc.curve_intervals(df, [own], 200).first()
    assert row.point == 0.5 and row.lower < 0.5 < row.upper and row.n_valid_iterations == 200


def test_poisson_weights_are_the_plan_ones(spark):
    units = ["a", "b|c", "ü", None]
    df = spark.createDataFrame([(u,) for u in units], "u string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(49))))
    want = {(r.u, r.i): r.t for r in df.select("u", "i", bootstrap.poisson_times(42, F.col("i"), F.col("u")).alias("t")).collect()}
    got = rc.times_of(42, units, 50)
    assert all(got[k, i] == want[u, i] for k, u in enumerate(units) for i in range(50))


def test_no_rows_times_rounds_in_the_plan(spark):
    df = spark.createDataFrame([("a", 1, .9)], "asset_id string, label int, score double")
    plan = rc.curve_samples(df, METRICS, 30)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
