"""Golden counts on the test tables, a streamed twin of the window aggregate, and small model fits."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stagewise.operators import graph, models, sequences, windows
from stagewise.plans.prepare import Prepared, choose_path
from stagewise.settings import EVENTS_SETTINGS, Settings
from stagewise.sources import readers
from stagewise.sources.specs import EVENTS, PACKET
from stagewise.streaming.windows import stream_instances

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def events(spark):
    return Prepared(readers.read_events(spark, FOLDER), EVENTS, EVENTS_SETTINGS)


@needs_tables
def test_golden_counts(events):
    counts = lambda df, *by: {tuple(r)[:-1] if len(by) > 1 else r[0]: r[-1] for r in df.groupBy(*by).count().collect()}
    assert counts(events.labelled, "stage_label") == {"Benign": 567, "IAD": 199, "LMEP": 201, "IMP": 33}
    assert counts(events.labels, "stage_label") == {"Benign": 374, "IAD": 181, "LMEP": 185, "IMP": 33}
    assert counts(events.with_split(events.labels), "split") == {"train": 469, "val": 138, "test": 166}
    assert events.interactions.count() == 996
    assert counts(events.edges, "edge_type") == {"interaction": 122, "temporal": 2 * 758}
    assert graph.representative_edges(events.interactions, events.nodes).count() == 2 * 75
    fc = events.with_split(sequences.forecast_instances(events.labels, 3, 60))
    assert counts(fc, "split", "label") == {("train", 0): 211, ("train", 1): 9, ("val", 0): 60, ("val", 1): 3, ("test", 0): 67, ("test", 1): 5}


@needs_tables
def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.count() == 773 and "stage_label" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_small_blocks_change_nothing(events):
    a = sequences.forecast_instances(events.labels, 3, 60, block=8).select("asset_id", "window_id", "label", "seq_len")
    b = sequences.forecast_instances(events.labels, 3, 60).select("asset_id", "window_id", "label", "seq_len")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_untrusted_time_falls_back_to_records(spark):
    rows = [(" 2021 22:14:30.9", f"h{i % 6}", f"h{(i + 1) % 6}", "DDoS_UDP" if i % 2 else "Normal", "1.5") for i in range(12)]
    raw = spark.createDataFrame(rows, "`frame.time` string, `ip.src_host` string, `ip.dst_host` string, Attack_type string, `tcp.len` string")
    p = choose_path(raw, PACKET, Settings())
    assert p.record_level and p.instances.count() == 12
    blank = raw.withColumn("frame.time", F.when(F.col("`tcp.len`").isNotNull(), "6.0")).limit(4)
    assert choose_path(raw.unionByName(blank), PACKET, Settings()).instances.count() == 12
    assert choose_path(raw.unionByName(blank), PACKET, Settings(), drop_bad_timestamps=False).instances.count() == 16
    assert {r.edge_type for r in p.edges.collect()} == {"interaction"} and p.edges.count() == 12


@needs_tables
def test_stream_equals_batch(spark, events, tmp_path):
    source = str(tmp_path / "in")
    events.labelled.select("timestamp", "asset_id", "severity", "value").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    live = stream_instances(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 21600, "30 days", ["value"])
    query = live.writeStream.format("memory").queryName("live_windows").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    cols = ["asset_id", "window_id", "n_records", "window_start_time", "severity", "stage_label"]
    rounded = lambda df: df.select(*cols, F.round("value__sum", 6).alias("s"))
    a, b = rounded(spark.table("live_windows")), rounded(windows.instances(events.records, ["value"], []))
    assert a.count() == 773 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_models_learn_and_fill_missing_classes(spark):
    rows = [(f"a{i % 12}", i, ["train", "val", "test"][i % 12 // 4], 0 if i % 2 else 2, [float(i % 2), (i % 7) / 7]) for i in range(120)]
    df = spark.createDataFrame(rows, "asset_id string, window_id bigint, split string, y int, x array<double>").withColumn("y", F.col("y").cast("double"))
    vec = models.vectorized(df)
    train, rest = vec.filter("split = 'train'"), vec.filter("split <> 'train'")
    for fit in (lambda t: models.fit_forest(t, 1, numTrees=5, maxDepth=3), lambda t: models.fit_boosted(t, 1, maxIter=2, maxDepth=2),
                lambda t: models.fit_logistic(t, maxIter=20), lambda t: models.fit_meta(t, "mlp", maxIter=20)):
        for r in models.with_prediction(fit(train)(rest)).collect():
            assert len(r.proba) == 4 and abs(sum(r.proba) - 1) < 1e-6 and r.proba[1] < .34 and r.pred == r.y
    with pytest.raises(ValueError):
        models.fit_meta(train, "nothing")


def test_stacking_scores_every_row_once(spark):
    rows = [(f"a{i % 15}", i // 15, ["train", "train", "train", "val", "test"][i % 5], float(i % 3), [float(i % 3), (i % 7) / 7]) for i in range(150)]
    df = spark.createDataFrame(rows, "asset_id string, window_id bigint, split string, y double, x array<double>")
    edges = graph.temporal_edges(df)
    base = models.base_scores(df, edges, 2, n_folds=2, forest={"numTrees": 3, "maxDepth": 3})
    assert base.count() == base.select("asset_id", "window_id").distinct().count() == 150
    out = models.stacked(base)
    assert out.filter(F.size("proba") != 4).count() == 0 and out.count() == 150
    assert set(models.base_views(base)) == {"forest", "graph", "late_fusion"}


def test_linear_fits_pass_over_tasks_worth_their_rows(spark, monkeypatch):
    assert models._gathered(spark.range(100).repartition(64), 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "ROWS_A_TASK", 10)
    assert models._gathered(spark.range(100).repartition(64), 100).rdd.getNumPartitions() == 10
