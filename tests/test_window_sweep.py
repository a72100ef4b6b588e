"""The width sweep by merged cells against one aggregation per width."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagewise.operators import windows

SCHEMA = "asset_id string, timestamp timestamp_ntz, severity int, `v.x` double, w double, kind string, tag string"


def records(spark, n=500):
    rng = random.Random(5)
    start = datetime(1969, 12, 31, 23, 50)
    rows = []
    for _ in range(n):
        rows.append((rng.choice("abc"), start + timedelta(seconds=rng.randint(0, 4000), microseconds=rng.randint(0, 999999)), rng.randint(0, 3),
                     None if rng.random() < .2 else 1e9 + rng.random(), None, rng.choice(["x", "y", "z", None]), None if rng.random() < .9 else "t"))
    return spark.createDataFrame(rows, SCHEMA)


def flat(df):
    names = sorted(df.columns)
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    return names, sorted(rows, key=str)


@pytest.mark.parametrize("widths", [(30, 60, 120, 300), (7.5, 20), (45,), (100, 250)])
def test_sweep_equals_each_width_alone(spark, widths):
    df = records(spark)
    names, got = flat(windows.delta_t_sweep(df, widths, ["v.x", "w"], ["kind", "tag"]))
    alone = windows.union_all([
        windows.instances(windows.with_window(df, w), ["v.x", "w"], ["kind", "tag"]).withColumn("delta_t", F.lit(float(w))) for w in widths])
    want_names, want = flat(alone)
    assert names == want_names and len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(y, float) else x == y
    labels = windows.sweep_labels(df, widths)
    assert {tuple(r) for r in labels.select("delta_t", "asset_id", "window_id", "severity").collect()} == {
        tuple(r) for r in alone.select("delta_t", "asset_id", "window_id", "severity").collect()}


def test_sweep_of_no_records_and_no_features(spark):
    df = records(spark)
    assert windows.delta_t_sweep(df.limit(0), (30, 60), ["w"], ["kind"]).count() == 0
    bare = windows.delta_t_sweep(df, (60,), [], [])
    assert bare.agg(F.sum("n_records")).first()[0] == 500


def test_records_are_repeated_once_only(spark):
    """Widths repeat cells: no Generate over a width lies below the first aggregate."""
    plan = windows.delta_t_sweep(records(spark), (30, 60), ["w"], ["kind"])._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Generate" in line or "Aggregate" in line]
    kinds = ["Aggregate" if "Aggregate" in line else "Generate" for line in lines]
    assert kinds == ["Aggregate", "Aggregate", "Generate", "Aggregate", "Generate"]
