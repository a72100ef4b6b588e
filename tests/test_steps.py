"""What steps leave on disk, and propagation and fits that go part by part."""

from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise import session
from stagewise.operators import graph, models, propagation
from stagewise.plans import queries
from test_ablations import EVENTS, event_rows

NODES = "asset_id string, window_id bigint, split string, y double, x array<double>"
EDGES = "src_asset string, src_window bigint, dst_asset string, dst_window bigint, edge_type string"


def tables_on_disk(spark):
    session.ensure_checkpoint_dir(spark)
    return {p.name for p in Path(urlparse(spark.sparkContext.getCheckpointDir()).path).glob("rdd-*")}


def test_a_step_leaves_its_result_only(spark):
    before, outside = tables_on_disk(spark), session.keep(spark.range(9))

    def inner():
        first = session.cut_lineage(spark.range(20))
        return first.join(session.keep(first.filter("id > 4")), "id")

    def outer():
        second = session.cut_step(inner)
        assert len(tables_on_disk(spark) - before) == 1 and session.is_cut(second) and session.keep(second) is second
        return second.filter("id % 2 = 0")

    out = session.cut_step(outer)
    assert [r.id for r in out.orderBy("id").collect()] == [6, 8, 10, 12, 14, 16, 18]
    assert len(tables_on_disk(spark) - before) == 1 and session._KEPT == [outside] and not session._STEPS
    given = session.cut_step(lambda: out)  # cut outside: no second copy, and no step drops it
    assert given is out and session.cut_step(lambda: session.cut_step(lambda: out).filter("id > 6")).count() == 6 and out.count() == 7
    with pytest.raises(ZeroDivisionError):
        session.cut_step(lambda: 1 / 0)
    assert not session._STEPS


def test_messages_go_part_by_part(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 30
    a = np.triu(rng.random((n, n)) < .2, 1)
    a = (a | a.T).astype(float)
    x = rng.normal(size=(n, 3))
    nodes = spark.createDataFrame([(f"a{i % 7}", i, "train", 0.0, list(map(float, x[i]))) for i in range(n)] + [(None, 5, "train", 0.0, [1.0, 1.0, 1.0])], NODES)
    pairs = [(f"a{i % 7}", i, f"a{j % 7}", j, "interaction") for i in range(n) for j in range(n) if a[i, j]]
    stray = [("a1", 1, "nobody", 1, "interaction")]  # a target that is no node gets no row
    hat = a + np.eye(n)
    d = np.diag([(hat[i].sum() + (i == 1)) ** -.5 for i in range(n)])
    wanted = np.linalg.matrix_power(d @ hat @ d, 2) @ x
    edges = spark.createDataFrame(pairs + stray, EDGES)
    passes = []
    arrived = propagation._arrived
    monkeypatch.setattr(propagation, "_arrived", lambda *args: passes.append(args[-2:]) or arrived(*args))
    for most, parts in ((10**6, 1), (len(pairs) // 3, 4)):
        monkeypatch.setattr(propagation, "MESSAGES_A_PASS", most)
        passes.clear()
        got = propagation.convolve_vectors(nodes.select("asset_id", "window_id", "x"), edges).orderBy("window_id").collect()
        assert passes == [(k, parts) for k in range(parts)] * 2
        assert [(r.asset_id, r.window_id) for r in got] == [(f"a{i % 7}", i) for i in range(n)]
        assert np.allclose([r.x for r in got], wanted)


def test_base_scores_leave_one_table_on_disk(spark):
    rows = [(f"a{i % 15}", i // 15, ["train", "train", "train", "val", "test"][i % 5], float(i % 3), [float(i % 3), (i % 7) / 7]) for i in range(150)]
    df = spark.createDataFrame(rows, NODES)
    edges = graph.temporal_edges(df)
    before = tables_on_disk(spark)
    base = models.base_scores(df, edges, n_folds=2, forest={"numTrees": 3, "maxDepth": 3})
    assert len(tables_on_disk(spark) - before) == 1 and not session._KEPT
    assert base.columns == ["asset_id", "window_id", "split", "y", "proba", "gproba"] and base.count() == 150


def test_meta_ablation_leaves_one_table_on_disk(spark, tmp_path):
    rows = event_rows(600, 20, 17)
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    before = tables_on_disk(spark)
    out = queries.QUERIES["meta_ablation"](spark, str(tmp_path))
    assert len(tables_on_disk(spark) - before) == 1  # boosting removes its own
    got = out.collect()
    assert [r.meta for r in got] == ["logistic_regression", "mlp", "gradient_boosting"] and all(0 < r.macro_f1 <= 1 and 0 <= r.mean_brier < 1 for r in got)


def test_fits_over_many_rows_run_one_after_the_other(spark, monkeypatch):
    assert [models._side_by_side(4, n) for n in (0, 100, 6_000_000, 7_000_000, 10**9)] == [4, 4, 2, 1, 1]
    df = models.vectorized(spark.createDataFrame([(f"a{i}", i, "train", float(i % 3), [float(i % 3), i / 60]) for i in range(60)], NODES))
    scored = {}
    for most in (10**6, 1):
        monkeypatch.setattr(models, "ROWS_SIDE_BY_SIDE", most)
        scored[most] = [r.proba for r in models.fit_boosted(df, 1, maxIter=2, maxDepth=2)(df).orderBy("window_id").collect()]
    assert scored[1] == scored[10**6] and all(abs(sum(p) - 1) < 1e-9 and p[3] == 0 for p in scored[1])
