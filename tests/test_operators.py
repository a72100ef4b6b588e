"""Literal fixtures with hand-computed answers, and blocked operators against plain windows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stagewise.functions import vectors
from stagewise.functions.scalar import hash_hex
from stagewise.operators import audits, blocks, bootstrap, features, graph, metrics, propagation, ranking, sequences, splits, summary, windows
from stagewise.settings import Settings

STAGE = {0: "Benign", 1: "IAD", 2: "LMEP", 3: "IMP"}


def labelled(spark, rows):
    """(asset, window, severity) rows as a label table."""
    return spark.createDataFrame([(a, w, s, STAGE[s]) for a, w, s in rows],
                                 "asset_id string, window_id bigint, severity int, stage_label string")


@pytest.fixture(scope="module")
def skewed(spark):
    """One asset holds most windows, others few; windows have gaps."""
    rng = random.Random(3)
    rows = [("hot", w, 0) for w in sorted(rng.sample(range(-500, 3000), 700))]
    for i in range(40):
        rows += [(f"a{i}", w, rng.choice([0, 0, 1, 2, 3])) for w in sorted(rng.sample(range(300), rng.randint(1, 9)))]
    return labelled(spark, rows)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    count = lambda df: collections.Counter(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert count(a) == count(b)


def test_instances_by_hand(spark):
    rows = [("a", 1, 0, 1.0, "x", 10), ("a", 1, 2, 3.0, "y", 9), ("a", 1, 1, None, "y", 11), ("b", 1, 0, None, "z", 5), ("b", 1, 0, None, "w", 6)]
    df = spark.createDataFrame(rows, "asset_id string, window_id bigint, severity int, v double, c string, s int").withColumn(
        "timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    a, b = windows.instances(df, ["v"], ["c"]).orderBy("asset_id").collect()
    assert (a.n_records, a.v__mean, a.v__max, a.v__sum, a.c__nunique, a.c__mode, a.stage_label) == (3, 2.0, 3.0, 4.0, 2, "y", "LMEP")
    assert a.v__std == pytest.approx(2 ** 0.5) and a.window_start_time.second == 9
    assert (b.v__mean, b.v__std, b.v__max, b.v__sum, b.c__mode) == (None, 0.0, None, 0.0, "w")
    numeric, categorical = windows.feature_columns(windows.instances(df, ["v"], ["c"]).columns)
    assert "n_records" in numeric and "c__nunique" in numeric and categorical == ["c__mode"]
    flat = windows.record_level_instances(df.withColumn("record_id", F.col("s").cast("bigint")).withColumn("stage_label", F.lit("IAD")), ["v"], ["c"])
    assert flat.count() == 5 and set(flat.columns) == set(windows.instances(df, ["v"], ["c"]).columns)


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_timeline_equals_plain_window(spark, skewed, block):
    w = Window.partitionBy("asset_id").orderBy("window_id")
    whole = Window.partitionBy("asset_id")
    plain = skewed.select(
        "*", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.lead("window_id").over(w).alias("next_window_id"),
        F.max("window_id").over(whole).alias("last_window_id"), F.lag("severity").over(w).alias("before"),
        F.min(F.when(F.col("severity") == 3, F.col("window_id"))).over(whole).alias("imp"))
    blocked = blocks.timeline(skewed, block=block, marks={"imp": F.col("severity") == 3}, carry={"severity": "before"})
    same(blocked, plain)


@pytest.mark.parametrize("block, length", [(5, 5), (16, 3), (4096, 60)])
def test_look_back_equals_plain_frame(spark, skewed, block, length):
    placed = blocks.timeline(skewed, block=32)
    frame = Window.partitionBy("asset_id").orderBy("pos").rowsBetween(-(length - 1), 0)
    same(blocks.look_back(placed, length, {"s": lambda w: F.sum("window_id").over(w), "n": lambda w: F.count("*").over(w)}, block),
         placed.select("*", F.sum("window_id").over(frame).alias("s"), F.count("*").over(frame).alias("n")))


def test_look_back_beyond_a_block(skewed):
    placed = blocks.timeline(skewed, block=5)
    total = {"n": lambda w: F.count("*").over(w)}
    wide, narrow = blocks.look_back(placed, 10, total, 4096), blocks.look_back(placed, 10, total, block=5)
    same(wide.select("asset_id", "window_id", "n"), narrow.select("asset_id", "window_id", "n"))
    with pytest.raises(ValueError):
        blocks.look_back(placed, 0, total)


def test_hash_position_and_sample(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id").withColumn("hash_key", hash_hex(1, F.col("id")))
    plain = F.row_number().over(Window.partitionBy("g").orderBy("hash_key")) - 1
    same(blocks.hash_position(df, by=["g"]).withColumn("hash_pos", F.col("hash_pos").cast("int")), df.withColumn("hash_pos", plain))
    same(blocks.first_by_hash(df, 40, ["g"]), df.withColumn("_r", plain).filter("_r < 40").drop("_r"))


@pytest.mark.parametrize("n_blocks", [2, 16, 128])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_plain_window(spark, n_blocks, descending):
    rng = random.Random(5)
    rows = {(g, round(rng.random() ** 6, 5)) for g in "ab" for _ in range(400)}
    df = spark.createDataFrame([(g, s, i % 4) for i, (g, s) in enumerate(sorted(rows))], "g string, s double, n bigint")
    order = F.desc("s") if descending else F.asc("s")
    w = Window.partitionBy("g").orderBy(order)
    plain = df.select("*", F.sum("n").over(w).alias("cum_n"), F.sum("n").over(Window.partitionBy("g")).alias("tot_n"))
    same(blocks.running_totals(df, ["g"], "s", ["n"], descending, n_blocks), plain)


def test_split_covers_each_asset_once(spark):
    assets = spark.range(150).select(F.concat(F.lit("asset-"), (F.col("id") % 50).cast("string")).alias("asset_id"))
    rows = splits.asset_split(assets, Settings(seed=1)).collect()
    assert len({r.asset_id for r in rows}) == len(rows) == 50
    assert collections.Counter(r.split for r in rows) == {"train": 30, "val": 10, "test": 10}
    want = sorted({f"asset-{i}" for i in range(50)}, key=lambda a: __import__("hashlib").md5(f"1|{a}".encode()).hexdigest())
    assert {r.asset_id for r in rows if r.split == "train"} == set(want[:30])
    assert splits.asset_split(assets, Settings(seed=2)).filter("split = 'train'").exceptAll(
        splits.asset_split(assets, Settings(seed=1)).filter("split = 'train'")).count() > 0


def test_tiny_splits(spark):
    one = spark.createDataFrame([("a",)], "asset_id string")
    assert splits.asset_split(one, Settings()).first().split == "train"
    assert splits.split_cut(one.filter("false"), Settings()).train_to == ""
    with pytest.raises(ValueError):
        splits.require_assigned(one, spark.createDataFrame([("b", "val")], "asset_id string, split string"))


def test_folds_keep_assets_whole_and_spread_heavy_ones(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 2400, F.concat(F.lit("big"), (F.col("id") % 4).cast("string")))
                                    .otherwise(F.concat(F.lit("s"), (F.col("id") % 400).cast("string"))).alias("asset_id"))
    folds = splits.asset_folds(rows, 4).collect()
    assert len({f.asset_id for f in folds}) == len(folds) == 404
    assert {f.fold for f in folds} == {0, 1, 2, 3}
    assert len({f.fold for f in folds if f.asset_id.startswith("big")}) == 4
    with pytest.raises(Exception, match="two assets"):
        splits.asset_folds(spark.createDataFrame([("x",)], "asset_id string"), 3).collect()


def test_graph_by_hand(spark):
    nodes = labelled(spark, [("a", 1, 0), ("b", 1, 0), ("a", 5, 0), ("c", 5, 3)])
    met = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("a", "a", 1), ("a", "x", 1), ("a", "b", 5), ("c", "a", 5), ("a", "nan", 1)],
                                "asset_id string, peer_id string, window_id bigint")
    edges = graph.build_edges(met, nodes)
    got = {tuple(r) for r in edges.collect()}
    assert got == {("a", 1, "b", 1, "interaction"), ("b", 1, "a", 1, "interaction"), ("c", 5, "a", 5, "interaction"),
                   ("a", 5, "c", 5, "interaction"), ("a", 1, "a", 5, "temporal"), ("a", 5, "a", 1, "temporal")}
    assert graph.edges_for_mode(edges, "temporal_only").count() == 2
    with pytest.raises(ValueError):
        graph.edges_for_mode(edges, "typed")
    assert {tuple(r)[:4] for r in graph.representative_edges(met, nodes).collect()} == {
        ("a", 1, "b", 1), ("b", 1, "a", 1), ("a", 1, "c", 5), ("c", 5, "a", 1)}
    assert graph.induced_subgraph(edges, nodes.filter("asset_id = 'a'")).count() == 2
    assert {r.mode: (r.n_edges, r.average_degree) for r in graph.graph_stats(edges, nodes).collect()}["both"] == (3, 1.5)
    assert audits.edges_well_formed(edges, nodes).first()["pass"]
    assert not audits.edges_well_formed(edges.limit(1), nodes).first()["pass"]
    assert [r.node_id for r in graph.node_ids(nodes).collect()] == [0, 1, 2, 3]


def test_forecast_labels_by_hand(spark):
    rows = [("a", w, 3 if w == 8 else 0) for w in (1, 5, 7, 8, 9)] + [("b", w, 0) for w in (1, 2, 6)]
    lab = labelled(spark, rows)
    got = {(r.asset_id, r.window_id): (r.label, r.seq_len) for r in sequences.forecast_instances(lab, 3, 2).collect()}
    assert got == {("a", 1): (0, 1), ("a", 5): (1, 2), ("a", 7): (1, 2), ("b", 1): (0, 1), ("b", 2): (0, 2)}
    kept = sequences.forecast_instances(lab, 3, 2, drop_unconfirmed=False)
    assert {(r.asset_id, r.window_id): r.label for r in kept.collect()}[("b", 6)] == 0
    pre = {(r.asset_id, r.window_id): [s.window_id for s in r.prefix]
           for r in sequences.prefixes(sequences.forecast_instances(lab, 3, 2), 2, ["window_id", "stage_label"]).collect()}
    assert pre[("a", 7)] == [5, 7] and pre[("b", 1)] == [1]
    assert {r.asset_id: (r.n_windows, r.first_impact_pos, r.n_pre_impact) for r in sequences.asset_timelines(lab).collect()} == {
        "a": (5, 3, 3), "b": (3, None, 0)}


def test_gate_reasons(spark):
    schema = "split string, label int"
    gate = lambda rows: sequences.forecast_gate(spark.createDataFrame(rows, schema)).first()
    assert gate([]).reasons == ["no forecast instances"]
    assert gate([("train", 1)]).reasons == ["too few train instances", "train has one class only", "no test instances"]
    assert gate([("train", i % 2) for i in range(10)] + [("test", 0), ("test", 1)]).valid


def test_ranking_by_hand(spark):
    rows = [(1, .9), (0, .8), (1, .8), (0, .3), (1, .1)]
    df = spark.createDataFrame([(y, s, f"{i:032x}") for i, (y, s) in enumerate(rows)], "label int, score double, hash_key string")
    m = ranking.curve_metrics(ranking.score_curve(df)).first()
    assert m.pr_auc == pytest.approx(0.755556, abs=1e-6) and m.roc_auc == pytest.approx((2 + 1.5 + 0) / 6)
    single = ranking.curve_metrics(ranking.score_curve(df.filter("label = 1"))).first()
    assert single.roc_auc is None and single.pr_auc is None
    caps = {r.percent: r.capture for r in ranking.capture_at(df, (1, 40, 60)).collect()}
    assert caps == {1.0: pytest.approx(1 / 3), 40.0: pytest.approx(1 / 3), 60.0: pytest.approx(2 / 3)}
    bundle = ranking.forecast_metrics(df.filter("label = 1"), (1,)).first()
    assert bundle.note and bundle.f1 is None and bundle.capture_at_1pct is None
    assert ranking.forecast_metrics(df, (1,)).first().f1 == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))


def test_ranking_against_brute_force_with_hot_ties(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < .3), .5 if i % 3 == 0 else round(rng.random() ** 8, 7)) for i in range(900)]
    df = spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], "id int, label int, score double").withColumn("hash_key", hash_hex(0, F.col("id")))
    m = ranking.curve_metrics(ranking.score_curve(df)).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert m.roc_auc == pytest.approx(auc)
    order = [r.label for r in df.orderBy(F.desc("score"), "hash_key").collect()]
    for r in ranking.capture_at(df, (1, 10, 25)).collect():
        k = max(1, int(np.ceil(900 * r.percent / 100)))
        assert r.capture == pytest.approx(sum(order[:k]) / len(pos))


def test_macro_f1_definitions(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1)], "y int, pred int")
    m = metrics.macro_metrics(df).first()
    assert (m.macro_f1, m.macro_f1_present, m.n_samples) == (0.5, 1.0, 3)
    cm = {(r.actual, r.predicted): (r.n, r.row_share) for r in metrics.confusion_matrix(df).collect()}
    assert len(cm) == 16 and cm[("Benign", "Benign")] == (2, 1.0) and cm[("IMP", "IMP")] == (0, 0.0)
    w = {r.y: (r.fixed_weight, r.balanced_weight) for r in metrics.class_weights(df).collect()}
    assert w[0] == (3 / 8, 3 / 4) and w[3] == (3 / 4, None)


def test_thresholds(spark):
    grid = [i / 100 for i in range(1, 100)]
    scores = spark.createDataFrame([(s,) for s in grid + [0.0, 1.0, 0.295]], "s double")
    for r in scores.select("s", ranking._thresholds_passed(F.col("s")).alias("k")).collect():
        assert r.k == sum(r.s >= t for t in grid)
    rows = [("IMP", "val", 1, .42), ("IMP", "val", 0, .30), ("IMP", "test", 1, .1), ("IAD", "val", 0, .9), ("LMEP", "val", 1, .001)]
    ovr = spark.createDataFrame(rows, "stage string, split string, label int, score double")
    got = {r.stage: r.threshold for r in ranking.validation_thresholds(ovr).collect()}
    assert got == {"IMP": 0.31, "IAD": 0.5, "LMEP": 0.01}
    assert audits.thresholds_ignore_test(ovr).first()["pass"]
    reads_test = lambda rows: ranking.validation_thresholds(rows.withColumn("split", F.lit("val")))
    assert audits.thresholds_ignore_test(ovr, reads_test).first().detail.startswith("1 ")  # IMP alone has a test row


@pytest.mark.parametrize("make", [bootstrap.instance_bootstrap, bootstrap.instance_bootstrap_multinomial, bootstrap.asset_bootstrap,
                                  bootstrap.asset_bootstrap_poisson])
def test_bootstrap_resamples(spark, make):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"a{i % 60}", rng.randint(0, 3), rng.randint(0, 3)) for i in range(600)], "asset_id string, y int, pred int")
    rows = make(df, 200).collect()
    totals = [sum(r[c] for c in metrics.CELLS) for r in rows]
    assert len(rows) == 200 and abs(np.mean(totals) - 600) < 12
    if make is not bootstrap.asset_bootstrap_poisson:
        assert set(totals) == {600}
    ci = bootstrap.interval(make(df, 200), metrics.confusion_counts(df=df)).first()
    assert ci.lower < ci.point < ci.upper and ci.n_valid_iterations == 200


def test_features_fit_on_train_only(spark):
    rows = [("train", 1.0, "x", None), ("train", 2.0, "x", None), ("train", 3.0, "y", None), ("train", 10.0, None, None), ("train", None, "y", None), ("test", 900.0, "z", 1.0)]
    df = spark.createDataFrame(rows, "split string, v double, c string, empty double")
    enc = features.FeatureEncoder(["v", "empty"], ["c"])
    with pytest.raises(features.NotFitted):
        enc.transform(df)
    enc.fit(df.filter("split = 'train'"))
    assert enc.medians == {"v": 2.5} and enc.modes == {"c": "x"} and enc.sizes == {"c": 2}
    assert sorted(map(tuple, enc.values.collect())) == [("c", "x", 0), ("c", "y", 1)]
    full = np.array([1, 2, 3, 10, 2.5])
    assert enc.scales["v"] == (pytest.approx(full.mean()), pytest.approx(full.std()))
    got = [r.x for r in enc.transform(df).collect()]
    assert got[5][1:] == [0.0, 0.0] and got[3][1:] == [1.0, 0.0] and enc.width == 3
    assert audits.encoder_is_train_only(enc, df).first()["pass"]
    assert not audits.encoder_is_train_only(features.FeatureEncoder(["v"], []).fit(df), df).first()["pass"]


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_many_categories_make_sparse_vectors(spark, broadcast, monkeypatch):
    monkeypatch.setattr(features, "BROADCAST_VALUES", broadcast)
    n = 50_000
    df = spark.range(n + 10).select(F.format_string("host%06d", F.col("id")).alias("c"), F.lit(None).cast("string").alias("empty"), (F.col("id") % 7).cast("double").alias("v"))
    enc = features.FeatureEncoder(["v"], ["c", "empty"]).fit(df.limit(n).filter("c < 'host050000'"))
    assert enc.width == n + 1 and enc.sizes == {"c": n}
    asked = df.filter("c IN ('host000000', 'host049999', 'host050003')")
    got = {r.c: r.vec for r in enc.encode(asked).collect()}
    assert {c: (v.size, list(v.indices), list(v.values)[1:]) for c, v in got.items() if c != "host050003"} == {
        "host000000": (n + 1, [0, 1], [1.0]), "host049999": (n + 1, [0, n], [1.0])}
    assert list(got["host050003"].indices) == [0]
    numbers = enc.values.agg(F.count("*"), F.countDistinct("number"), F.max("number")).first()
    assert tuple(numbers) == (n, n, n - 1)
    assert enc.entries(asked, ["c"]).filter("position > 0").count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 4001, 20000])
def test_exact_median(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([0.0, rng.gauss(0, 9)]), float(rng.randint(0, 3))) for _ in range(n)]
    got = {r.feature: r.median for r in features.exact_medians(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    assert got == {i: pytest.approx(np.median([r[i] for r in rows])) for i in (0, 1)}


@pytest.mark.parametrize("hub_edges", [1_000_000, 1])
def test_propagation_against_matrices(spark, hub_edges, monkeypatch):
    monkeypatch.setattr(propagation, "HUB_EDGES", hub_edges)  # 1: every source with two edges is joined in parts
    rng = np.random.default_rng(0)
    keys = [("n%d" % i, i % 2) for i in range(8)]
    x = rng.normal(size=(8, 2))
    a = np.zeros((8, 8))
    for i, j in [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (0, 6)]:
        a[i, j] = a[j, i] = 1
    nodes = spark.createDataFrame([(*k, *map(float, v)) for k, v in zip(keys, x)], "asset_id string, window_id bigint, f0 double, f1 double")
    edges = spark.createDataFrame([(*keys[i], *keys[j], "interaction") for i in range(8) for j in range(8) if a[i, j]],
                                  "src_asset string, src_window bigint, dst_asset string, dst_window bigint, edge_type string")
    read = lambda df, cols: np.array([[r[c] for c in cols] for r in df.orderBy("asset_id").collect()])
    hat = a + np.eye(8)
    d = np.diag(hat.sum(1) ** -.5)
    prop = d @ hat @ d
    assert np.allclose(read(propagation.convolve(nodes, edges, ["f0", "f1"]), ["f0", "f1"]), prop @ prop @ x)
    deg = a.sum(1, keepdims=True)
    assert np.allclose(read(propagation.mean_neighbours(nodes, edges, ["f0", "f1"]), ["nb_f0", "nb_f1"]), np.divide(a @ x, deg, out=np.zeros((8, 2)), where=deg > 0))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.exp(unit @ unit.T) * hat
    assert np.allclose(read(propagation.attend(nodes, edges, ["f0", "f1"]), ["f0", "f1"]), w / w.sum(1, keepdims=True) @ x)
    packed = nodes.select("asset_id", "window_id", F.array("f0", "f1").alias("x"))
    vectors = lambda df: np.array([r.x for r in df.orderBy("asset_id").collect()])
    assert np.allclose(vectors(propagation.convolve_vectors(packed, edges)), prop @ prop @ x)
    means = np.divide(a @ x, deg, out=np.zeros((8, 2)), where=deg > 0)
    assert np.allclose(vectors(propagation.mean_vectors(packed, edges)), np.hstack([x, means]))
    assert np.allclose(vectors(propagation.attend_vectors(packed, edges)), w / w.sum(1, keepdims=True) @ x)


def test_hub_with_a_third_of_all_edges_is_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(propagation, "HUB_EDGES", 500)
    n = 6000
    sources = F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 900))
    edges = spark.range(n).select(sources.alias("src_asset"), F.lit(0).cast("bigint").alias("src_window"), F.concat(F.lit("t"), F.col("id") % 700).alias("dst_asset"),
                                  F.lit(0).cast("bigint").alias("dst_window"), F.lit("interaction").alias("edge_type"))
    nodes = edges.select(F.col("src_asset").alias("asset_id"), F.col("src_window").alias("window_id")).distinct().withColumn("x", F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)))
    hubs = propagation._hubs(edges)
    assert [(r.asset_id, r._parts) for r in hubs.collect()] == [("hub", 4)]
    monkeypatch.setattr(propagation, "BROADCAST_HUBS", 0)
    for side in (hubs, propagation._hubs(edges)):
        sums = {r.asset_id: r.x for r in propagation.sum_vectors(propagation._messages(edges, nodes, side)).collect()}
        assert len(sums) == 700 and sum(v[0] for v in sums.values()) == n and all(v == [v[0], 2 * v[0], 0.0] for v in sums.values())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups that cross batches
    again = {r.asset_id: r.x for r in propagation.sum_vectors(propagation._messages(edges, nodes, hubs)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == sums


def test_vectors(spark):
    p = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = spark.range(1).select(
        vectors.argmax(p(.3, .3, .2, .2)).alias("first"), vectors.pad(p(.5, .5)).alias("pad"), vectors.evidence_gates(p(0, 0, 0, 1)).alias("closed"),
        vectors.gated_stream(F.lit(.5), p(2, 4)).alias("stream"), vectors.softmax(p(1, 1)).alias("soft"), vectors.sigmoid(F.lit(0.0)).alias("sig"),
        vectors.one_hot_label(F.lit(2)).alias("hot"), vectors.mean_of(p(0, 1), p(1, 1)).alias("mean")).first()
    assert row.first == 0 and row.pad == [.5, .5, 0, 0] and row.closed == [0, 0, 0] and row.stream == [.5, 1, 2]
    assert row.soft == [.5, .5] and row.sig == .5 and row.hot == [0, 0, 1, 0] and row["mean"] == [.5, 1]


def test_windows_per_asset_and_flags(spark):
    lab = labelled(spark, [("a", 1, 0), ("b", 1, 0), ("b", 2, 3), ("b", 4, 0), ("c", 1, 1)])
    r = summary.windows_per_asset(lab).first()
    assert (r.n_min, r.n_median, r.n_q75, r.n_max, r.n_single_window, r.n_multi_window) == (1, 1.0, 2.0, 3, 2, 1)
    assert summary.suspicious_windowing(lab).first().flags == []
    assert len(summary.suspicious_windowing(lab.filter("window_id = 1")).first().flags) == 3


def test_audits_notice_violations(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test")], "asset_id string, split string")
    assert not audits.asset_in_one_split(rows).first()["pass"]
    pre = spark.createDataFrame([([("IMP",)],)], "prefix array<struct<stage_label:string>>")
    assert not audits.no_impact_in_prefix(pre).first()["pass"]
    assert not audits.probabilities_sum_to_one(spark.createDataFrame([([.5, .4],)], "proba array<double>")).first()["pass"]
    assert not audits.provenance_present({"t": rows}).first()["pass"]


def test_hot_asset_is_spread_over_tasks(spark):
    """Time line and look-back of an asset with all rows must use many partitions, each small."""
    n, block = 20_000, 512
    hot = spark.range(n).select(F.lit("hot").alias("asset_id"), (F.col("id") * 2).alias("window_id"), F.lit("Benign").alias("stage_label"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        placed = sequences.with_first_impact(hot, block=block)
        out = blocks.look_back(placed, 60, {"n": lambda w: F.count("*").over(w)}, block)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) < n / 4
        assert out.filter(F.col("n") == 60).count() == n - 59
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rounds_of_propagation_do_not_repeat_the_rounds_before(spark):
    edges = spark.createDataFrame([("a", 0, "b", 0, "t"), ("b", 0, "a", 0, "t")], "src_asset string, src_window bigint, dst_asset string, dst_window bigint, edge_type string")
    nodes = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0)], "asset_id string, window_id bigint, f double")
    scans = lambda rounds: propagation.convolve(nodes, edges, ["f"], rounds)._jdf.queryExecution().withCachedData().collectLeaves().size()
    assert scans(4) == scans(2)


def test_kept_tables_have_partitions_by_size(spark):
    from stagewise.session import configure, keep

    configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    kept = keep(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and kept.rdd.getNumPartitions() < 64
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_instance_bootstrap_takes_the_seeded_picks(spark):
    pairs = [(i % 4, i * 7 % 5 % 4) for i in range(1030)]  # more than a task's steps at once
    rows = bootstrap.instance_bootstrap(spark.createDataFrame(pairs, "y int, pred int"), 2, 42)
    assert "md5(" not in rows._jdf.queryExecution().optimizedPlan().toString()  # the hash of text columns took most of the time
    for r in rows.collect():
        picks = [sorted(pairs)[int(hashlib.md5(f"42|{r.iteration}|{s}".encode()).hexdigest()[:15], 16) % len(pairs)] for s in range(len(pairs))]
        assert all(r[metrics.cell(y, p)] == picks.count((y, p)) for y in range(4) for p in range(4))
    assert bootstrap.instance_bootstrap(spark.createDataFrame([], "y int, pred int"), 2).count() == 0


def test_numbers_of_a_record_move_once(spark):
    rows = [("a", 1, "x", "p", 1.0, 0), ("a", 1, "y", "p", 3.0, 2), ("a", 1, "y", None, None, 1), ("a", None, None, None, 5.0, 0), (None, None, "x", "q", 2.0, 3)]
    df = spark.createDataFrame(rows, "asset_id string, window_id bigint, c string, d string, v double, severity int").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    made = windows.instances(df, ["v"], ["c", "d"])
    got = {(r.asset_id, r.window_id): (r.n_records, r.v__sum, r.v__max, r.severity, r.c__nunique, r.c__mode, r.d__nunique, r.d__mode) for r in made.collect()}
    assert got == {("a", 1): (3, 4.0, 3.0, 2, 2, "y", 1, "p"), ("a", None): (1, 5.0, 5.0, 0, 0, None, 0, None), (None, None): (1, 2.0, 2.0, 3, 1, "x", 1, "q")}
    counted = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "_text" in line]
    assert counted and not any("avg(" in line for line in counted)
