"""Registered queries over the test catalogue. Each takes (spark, folder) and is one plan over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.scalar import hash_hex
from stagewise.functions.timecols import epoch_micros
from stagewise.functions.vectors import argmax, evidence_gates, gated_stream, mean_of
from stagewise.operators import (
    audits,
    blocks,
    bootstrap,
    features,
    graph,
    labels,
    metrics,
    models,
    propagation,
    ranking,
    resample_curves,
    sequences,
    splits,
    summary,
    windows,
)
from stagewise.plans.prepare import Prepared, choose_path
from stagewise.session import configure, cut_lineage, cut_step, ensure_checkpoint_dir, keep, release
from stagewise.settings import EVENTS_SETTINGS, Settings
from stagewise.sources import readers, sinks
from stagewise.sources.label_maps import LABEL_MAPS
from stagewise.sources.normalize import normalize
from stagewise.sources.specs import EVENTS, FLOW, LINEITEMS, PACKET, SourceSpec

S = EVENTS_SETTINGS
LINEITEM_SETTINGS = Settings(delta_t_seconds=30 * 86400.0)
PREFIX_COLUMNS = ["n_records", "value__max"]
BOOTSTRAP_ROUNDS = S.bootstrap_iterations
STAMP = {"timestamp_utc": "2024-01-01T00:00:00Z"}
GRID = {"w": [0.5, 1.0, 1.5]}
SEEDS = [42, 43, 44]
FLAT_FEATURES = ["n_records", "value__mean", "value__std", "value__max", "value__sum", "event_type__nunique"]


def prepared(spark: SparkSession, folder: str, settings: Settings = S, **kw) -> Prepared:
    configure(spark)
    return Prepared(readers.read_events(spark, folder), EVENTS, settings, **kw)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as the comparison side does."""
    return df.select(*[
        F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


def bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- records ---------------------------------------------------------------------------------


def normalized_records(spark, folder):
    n = prepared(spark, folder).normalized
    return n.records.select("record_id", "timestamp", "asset_id", "peer_id", "raw_attack_type", "binary_label", "value", "event_type")


def binary_label_fallback(spark, folder):
    """The event table without its attack text: a coarse label from a binary column."""
    configure(spark)
    raw = readers.read_events(spark, folder).withColumn("is_attack", (F.col("attack_type") != "normal").cast("string")).drop("attack_type")
    raw = raw.withColumn("is_attack", F.when(F.col("is_attack") == "true", "1").when(F.col("event_type") == "view", "?").otherwise("0"))
    spec = SourceSpec(name="events", timestamp=("ts",), asset=("USER-ID",), peer=("peer",), binary_label=("Is.Attack",),
                      time_format="ntz", record_id="event_id")
    return normalize(raw, spec).records.groupBy("raw_attack_type", "binary_label").agg(F.count("*").alias("n"))


def csv_shards(spark, folder):
    """Write the events as two CSV shards with unlike headers (one lacks the peer), then scan and normalise them."""
    configure(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    raw = readers.read_events(spark, folder).withColumn("ts", epoch_micros(F.col("ts")) / 1e6)
    first = raw.filter("event_id % 2 = 0").select(
        F.col("ts").alias(" ts "), F.col("user_id").alias("Source_IP"), F.col("peer").alias("dst_ip"),
        F.col("attack_type").alias("type"), "value", "event_type", "event_id")
    second = raw.filter("event_id % 2 = 1").select(
        "event_type", F.col("attack_type").alias("type"), F.col("user_id").alias("Source_IP"), F.col("ts"), "event_id",
        F.format_string("%.17g", "value").alias("value"))
    sinks.write_csv(first, f"{base}/a.csv")
    sinks.write_csv(second, f"{base}/b.csv")
    shards = readers.read_csv_shards(spark, [f"{base}/a.csv", f"{base}/b.csv"])
    spec = SourceSpec(name="events", timestamp=("time", "ts"), asset=("src_ip", "source_ip"), peer=("dst_ip",), attack_type=("type",),
                      numeric=("value", "duration"), categorical=("event_type",), time_format="epoch_seconds", record_id="event_id")
    return normalize(shards, spec).records.select(
        "record_id", "asset_id", "peer_id", "raw_attack_type", F.col("value"), "event_type",
        F.date_trunc("second", "timestamp").cast("timestamp_ntz").alias("second"))


def unmapped_labels(spark, folder):
    """Event types read as attack texts: all of them are unknown to the flow mapping."""
    configure(spark)
    raw = readers.read_events(spark, folder).withColumn("attack_type", F.col("event_type"))
    return labels.unmapped_labels(normalize(raw, EVENTS).records, LABEL_MAPS["events"]["primary"])


def stage_counts(spark, folder):
    return windows.count_stages(prepared(spark, folder).labelled)


def raw_type_counts(spark, folder):
    return prepared(spark, folder).normalized.records.groupBy("raw_attack_type").agg(F.count("*").alias("n"))


def quality_row(spark, folder):
    q = rounded(prepared(spark, folder).quality())
    return q.withColumn("reasons", F.array_join("impact_forecasting_invalid_reasons", "; ")).drop("impact_forecasting_invalid_reasons")


def quality_gate(spark, folder):
    """The gates on a packet-like source whose time text lacks a date on some rows and has no peer."""
    configure(spark)
    text = F.when(F.col("event_type") == "view", F.date_format("ts", " yyyy HH:mm:ss.SSSSSS")).otherwise(
        F.date_format("ts", "MMM d, yyyy HH:mm:ss.SSSSSS"))
    raw = readers.read_events(spark, folder).withColumn("frame.time", text).drop("ts", "peer")
    spec = SourceSpec(name="edgeiiotset", timestamp=("frame_time",), asset=("user_id",), attack_type=("attack_type",), date_gated=True)
    q = Prepared(raw, spec, S).quality()
    return rounded(q.select(
        "n_rows_raw", "n_rows_kept", "n_distinct_assets", "timestamp_parseable_frac", "timestamp_calendar_date_frac",
        "has_peer_id", "timestamp_reliable_for_windowing", "impact_forecasting_valid",
        F.size("impact_forecasting_invalid_reasons").cast("bigint").alias("n_reasons")))


# --- instances -------------------------------------------------------------------------------


def asset_window_instances(spark, folder):
    return rounded(prepared(spark, folder).instances)


def lineitem_instances(spark, folder):
    """Suppliers as assets, parts as peers: few assets, very many rows and peers each."""
    configure(spark)
    p = Prepared(readers.read_lineitems(spark, folder), LINEITEMS, LINEITEM_SETTINGS)
    return rounded(p.instances)


def lineitem_interactions(spark, folder):
    configure(spark)
    p = Prepared(readers.read_lineitems(spark, folder), LINEITEMS, LINEITEM_SETTINGS)
    return p.interactions.groupBy("asset_id", "window_id").agg(F.count("*").alias("n_peers"))


def lineitem_edges(spark, folder):
    configure(spark)
    return Prepared(readers.read_lineitems(spark, folder), LINEITEMS, LINEITEM_SETTINGS).edges


def window_sweep(spark, folder):
    p = prepared(spark, folder)
    swept = windows.delta_t_sweep(p.labelled, S.candidate_delta_t_seconds, p.numeric, p.categorical)
    return rounded(swept.drop("window_start_time", "severity"))


def window_sweep_summary(spark, folder):
    p = prepared(spark, folder)
    return windows.count_stages(windows.sweep_labels(p.labelled, S.candidate_delta_t_seconds), ["delta_t"])


def mapping_variants(spark, folder):
    p = prepared(spark, folder)
    keyed = windows.with_window(p.normalized.records, S.delta_t_seconds)
    return labels.variant_window_labels(keyed, LABEL_MAPS["events"], ["asset_id", "window_id"]).drop("severity")


def record_level_instances(spark, folder):
    return rounded(prepared(spark, folder, record_level=True).instances)


def flow_capture_instances(spark, folder):
    """The events under the published flow headers, from choice of path to instances."""
    configure(spark)
    raw = readers.read_events(spark, folder).select(
        (epoch_micros(F.col("ts")) / 1e6).alias("ts"), F.col("user_id").alias("src_ip"), F.col("peer").alias("dst_ip"),
        F.col("attack_type").alias("type"), F.col("value").alias("duration"), F.col("event_type").alias("proto"))
    p = choose_path(raw, FLOW, S)
    return rounded(p.instances.withColumn("window_start_time", F.date_trunc("second", "window_start_time").cast("timestamp_ntz")))


# The packet format's words for the attack texts of the event table.
PACKET_LABELS = {"normal": "Normal", "scanning": "Port_Scanning", "backdoor": "Backdoor", "ransomware": "Ransomware"}


def packet_capture_records(spark, folder):
    """The events under the published packet headers, views without a date: the path taken is record-level instances."""
    configure(spark)
    events = readers.read_events(spark, folder)
    time = F.when(F.col("event_type") == "view", F.date_format("ts", " yyyy HH:mm:ss.SSSSSS")).otherwise(
        F.date_format("ts", "MMM d, yyyy HH:mm:ss.SSSSSS"))
    time = F.when(F.col("event_id") % 10 == 3, "6.0").otherwise(time)  # a placeholder that captures hold in place of a time
    attack = F.col("attack_type")
    for text, word in PACKET_LABELS.items():
        attack = F.when(F.col("attack_type") == text, F.lit(word)).otherwise(attack)
    raw = events.select(
        time.alias("frame.time"), F.col("user_id").alias("ip.src_host"), F.col("peer").alias("ip.dst_host"),
        attack.alias("Attack_type"), F.col("value").alias("tcp.len"), F.col("event_type").alias("http.request.method"))
    p = choose_path(raw, PACKET, S)
    return rounded(p.with_split(p.instances).groupBy("split", "stage_label", F.col("`http.request.method__mode`").alias("method")).agg(
        F.lit(p.record_level).alias("record_level"), F.count("*").alias("n_instances"), F.countDistinct("window_id").alias("n_ids"),
        F.countDistinct("asset_id").alias("n_assets"), F.max("`tcp.len__max`").alias("len_max"), F.sum("`tcp.len__sum`").alias("len_sum")), 4)


def windows_per_asset(spark, folder):
    return rounded(summary.windows_per_asset(prepared(spark, folder).labels))


def suspicious_windowing(spark, folder):
    row = summary.suspicious_windowing(prepared(spark, folder).labels)
    return row.withColumn("flags", F.array_join("flags", "; "))


def data_volume(spark, folder):
    return summary.volume(prepared(spark, folder).records)


def chronology_violations(spark, folder):
    return windows.chronology_violations(prepared(spark, folder).instances).agg(F.count("*").alias("n_violations"))


# --- splits ----------------------------------------------------------------------------------


def asset_split(spark, folder):
    return splits.asset_split(prepared(spark, folder).normalized.records, S)


def split_stage_crosstab(spark, folder):
    p = prepared(spark, folder)
    return windows.split_stage_crosstab(p.with_split(p.labels))


def split_masks(spark, folder):
    """Instances of one split, as the model fits select them."""
    p = prepared(spark, folder)
    return p.with_split(p.labels).filter("split = 'val'").select("asset_id", "window_id", "stage_label")


def asset_folds(spark, folder):
    p = prepared(spark, folder)
    return splits.asset_folds(p.with_split(p.labels).filter("split = 'train'"), 5, S.seed)


# --- graph -----------------------------------------------------------------------------------


def interactions_distinct(spark, folder):
    return prepared(spark, folder).interactions


def interaction_edges(spark, folder):
    p = prepared(spark, folder)
    return graph.interaction_edges(p.interactions, p.nodes)


def temporal_edges(spark, folder):
    return graph.temporal_edges(prepared(spark, folder).nodes)


def graph_edges(spark, folder):
    return graph.edges_for_mode(prepared(spark, folder).edges, "both")


def representative_edges(spark, folder):
    p = prepared(spark, folder)
    return graph.representative_edges(p.interactions, p.nodes)


def record_level_edges(spark, folder):
    return prepared(spark, folder, record_level=True).edges


def train_subgraph(spark, folder):
    p = prepared(spark, folder)
    return graph.induced_subgraph(p.edges, p.with_split(p.nodes).filter("split = 'train'"))


def graph_stats(spark, folder):
    p = prepared(spark, folder)
    return graph.graph_stats(p.edges, p.nodes)


def node_degree(spark, folder):
    return graph.node_degree(prepared(spark, folder).edges)


def node_ids(spark, folder):
    return graph.node_ids(prepared(spark, folder).nodes)


# --- sequences -------------------------------------------------------------------------------


def first_impact(spark, folder):
    placed = sequences.with_first_impact(prepared(spark, folder).labels)
    return placed.select("asset_id", "window_id", "pos", "first_impact", "last_window_id", "next_window_id")


def _forecast(p: Prepared) -> DataFrame:
    return p.with_split(sequences.forecast_instances(p.labels, S.horizon_multiple, S.max_seq_len, S.drop_unconfirmed_negatives))


def forecast_instances(spark, folder):
    return sequences.instances_to_frame(_forecast(prepared(spark, folder)))


def forecast_unconfirmed_kept(spark, folder):
    p = prepared(spark, folder)
    kept = sequences.forecast_instances(p.labels, S.horizon_multiple, S.max_seq_len, drop_unconfirmed=False)
    return sequences.instances_to_frame(p.with_split(kept))


def prefix_steps(spark, folder):
    """The causal prefix of every forecast instance, one row per step."""
    p = prepared(spark, folder)
    with_prefix = sequences.prefixes(_forecast(p), S.max_seq_len, ["window_id", "stage_label"])
    return sequences.flatten_prefixes(with_prefix, ["asset_id", "cut_window_id"]).withColumn("step", F.col("step").cast("bigint"))


def _cheap_instances(p: Prepared) -> DataFrame:
    """(asset, window) with its record count, largest value and worst stage only."""
    rows = p.records.groupBy("asset_id", "window_id").agg(
        F.count("*").alias("n_records"), F.max("value").alias("value__max"), F.max("severity").alias("severity"))
    return keep(rows.withColumn("stage_label", windows.stage_of(F.col("severity"))))


def history_stats(spark, folder):
    placed = blocks.timeline(_cheap_instances(prepared(spark, folder)))
    out = sequences.prefix_stats(placed, 10, PREFIX_COLUMNS)
    return rounded(out.select("asset_id", "window_id", "history_len", *[
        f"{c}__hist_{s}" for c in PREFIX_COLUMNS for s in ("mean", "max", "delta")]))


def horizon_sweep(spark, folder):
    p = prepared(spark, folder)
    return sequences.horizon_sweep(p.labels, S.candidate_horizon_multiples, S.max_seq_len).select(
        "horizon", "asset_id", F.col("window_id").alias("cut_window_id"), "label", "seq_len")


def forecast_summary(spark, folder):
    return rounded(sequences.instance_summary(_forecast(prepared(spark, folder))))


def forecast_gate(spark, folder):
    gate = sequences.forecast_gate(_forecast(prepared(spark, folder)), S.min_forecast_instances)
    return gate.withColumn("reasons", F.array_join("reasons", "; "))


def skip_report(spark, folder):
    gate = sequences.forecast_gate(_forecast(prepared(spark, folder)).filter("label = 0"), S.min_forecast_instances)
    return sinks.skip_report_from_gate(gate, "events", "impact_forecasting").withColumn("reasons", F.array_join("reasons", "; "))


def asset_timelines(spark, folder):
    return sequences.asset_timelines(prepared(spark, folder).labels)


def impact_assets(spark, folder):
    return summary.impact_assets(prepared(spark, folder).labels)


def ordinal_baselines(spark, folder):
    """Unlearned forecast scores from the evidence score of each window in the prefix."""
    p = prepared(spark, folder)
    rows = _cheap_instances(p).withColumn("p_evidence", score_of("value__max"))
    cuts = sequences.eligible_cuts(sequences.with_first_impact(rows)).withColumn(
        "label", sequences.forecast_label(S.horizon_multiple))
    cuts = p.with_split(cuts).withColumn("scored", F.col("label").isNotNull() & (F.col("split") == "test"))
    out = sequences.ordinal_baselines(cuts, "p_evidence", S.max_seq_len)
    return rounded(out.select("asset_id", "window_id", "label", "max_score", "count_score"))


# --- features --------------------------------------------------------------------------------


def _split_instances(p: Prepared) -> DataFrame:
    return p.with_split(p.instances)


def train_feature_params(spark, folder):
    train = keep(_split_instances(prepared(spark, folder)).filter("split = 'train'"))
    return rounded(features.numeric_params(train, FLAT_FEATURES).drop("feature"))


def train_category_modes(spark, folder):
    train = _split_instances(prepared(spark, folder)).filter("split = 'train'")
    return features.category_modes(features.category_counts(train, ["event_type__mode"]))


def encoded_features(spark, folder):
    """Scaled numeric features and one-hot categories in long form, parameters from train only."""
    rows = keep(_split_instances(prepared(spark, folder)))
    encoder = features.FeatureEncoder(["n_records", "value__max"], ["event_type__mode"]).fit(rows.filter("split = 'train'"))
    return rounded(encoder.entries(rows, ["asset_id", "window_id"]))


def encoded_peers(spark, folder):
    """Peers of records as a category of many values, numbered in train: how often each occurs by split."""
    p = prepared(spark, folder)
    rows = keep(p.with_split(p.records))
    encoder = features.FeatureEncoder([], ["peer_id"]).fit(rows.filter("split = 'train'"))
    counts = encoder.entries(rows, ["split"]).groupBy("split", "position", "feature").agg(F.count("*").alias("n"))
    return counts.withColumn("width", F.lit(encoder.width).cast("bigint"))


def class_weights(spark, folder):
    p = prepared(spark, folder)
    train = p.with_split(p.labels).filter("split = 'train'").withColumn("y", F.col("severity"))
    return rounded(metrics.class_weights(train))


def positive_weight(spark, folder):
    return rounded(metrics.positive_weight(_forecast(prepared(spark, folder)).filter("split = 'train'")))


# --- deterministic scores for the metric queries ---------------------------------------------


def score_of(column: str) -> Column:
    return F.round(F.col(column) / (F.col(column) + 50), 6)


def _probabilities(w: float = 1.0) -> Column:
    """Four class scores from order-independent aggregates, normalised."""
    m = F.col("value__max") / (F.col("value__max") + 50)
    c = F.col("event_type__nunique") / (F.col("n_records") + 1)
    parts = [F.lit(0.45), w * c, m, 1.3 * m * m]
    mass = sum(parts)
    return F.array(*[F.round(x / mass, 9) for x in parts])


def _class_inputs(p: Prepared) -> DataFrame:
    return p.records.groupBy("asset_id", "window_id").agg(
        F.count("*").alias("n_records"), F.max("value").alias("value__max"),
        F.countDistinct("event_type").alias("event_type__nunique"), F.max("severity").alias("y"))


def _scored_rows(rows: DataFrame, w: float = 1.0) -> DataFrame:
    """(asset, window, split, y, proba, pred) from rows that hold what the scores are made of."""
    return rows.withColumn("proba", _probabilities(w)).withColumn("pred", argmax(F.col("proba"))).select(
        "asset_id", "window_id", "split", "y", "proba", "pred")


def _scored_instances(p: Prepared, w: float = 1.0) -> DataFrame:
    """(asset, window, split, y, proba, pred) without any fit."""
    return keep(_scored_rows(p.with_split(_class_inputs(p)), w))


def _scored_cuts(p: Prepared) -> DataFrame:
    """Forecast instances of all splits with a score from the cut window."""
    cuts = p.with_split(sequences.forecast_instances(_cheap_instances(p), S.horizon_multiple, S.max_seq_len))
    return keep(cuts.withColumn("score", score_of("value__max")).withColumn(
        "hash_key", hash_hex(S.seed, F.col("asset_id"), F.col("window_id"))
    ).select("asset_id", "cut_window_id", "split", "label", "score", "hash_key"))


def confusion_matrix(spark, folder):
    return rounded(metrics.confusion_matrix(_scored_instances(prepared(spark, folder)), ["split"]))


def class_metrics(spark, folder):
    return rounded(metrics.class_metrics(_scored_instances(prepared(spark, folder)), ["split"]))


def macro_metrics(spark, folder):
    return rounded(metrics.macro_metrics(_scored_instances(prepared(spark, folder)), ["split"]))


def long_metrics(spark, folder):
    return rounded(metrics.long_metrics(_scored_instances(prepared(spark, folder)), ["split"]))


def mean_brier(spark, folder):
    return rounded(metrics.mean_brier(_scored_instances(prepared(spark, folder)), ["split"]))


def ranking_metrics(spark, folder):
    cuts = _scored_cuts(prepared(spark, folder))
    return rounded(ranking.curve_metrics(ranking.score_curve(cuts, ["split"]), ["split"]))


def pr_curve(spark, folder):
    return rounded(ranking.pr_points(ranking.score_curve(_scored_cuts(prepared(spark, folder)), ["split"]), ["split"]))


def roc_curve(spark, folder):
    return rounded(ranking.roc_points(ranking.score_curve(_scored_cuts(prepared(spark, folder)), ["split"]), ["split"]))


def capture_at_k(spark, folder):
    return rounded(ranking.capture_at(_scored_cuts(prepared(spark, folder)), S.capture_at_percents, ["split"]))


def forecast_metrics(spark, folder):
    return rounded(ranking.forecast_metrics(_scored_cuts(prepared(spark, folder)), S.capture_at_percents, ["split"]))


def _ovr(p: Prepared) -> DataFrame:
    return ranking.one_vs_rest(_scored_instances(p), ["asset_id", "window_id", "split"])


def val_thresholds(spark, folder):
    return rounded(ranking.validation_thresholds(_ovr(prepared(spark, folder))))


def ovr_alerting(spark, folder):
    ovr = _ovr(prepared(spark, folder))
    return rounded(ranking.alerting_metrics(ovr, ranking.validation_thresholds(ovr)))


def predictions(spark, folder):
    return sinks.prediction_table(_scored_cuts(prepared(spark, folder)))


def late_fusion(spark, folder):
    """Mean of two score vectors per instance, and the class it picks."""
    p = prepared(spark, folder)
    fused = _class_inputs(p).withColumn("proba", mean_of(_probabilities(), _probabilities(1.5)))
    return rounded(fused.select("asset_id", "window_id", "y", *[F.element_at("proba", k + 1).alias(f"p{k}") for k in range(4)]))


def _sweep_results(spark, folder) -> DataFrame:
    """(model, seed, split, macro_f1): three score rules as models, seeds as different splits.

    Rule and seed are columns, so the whole sweep is one scan and one aggregation.
    """
    p = prepared(spark, folder)
    cuts = {seed: splits.split_cut(p.labels, replace(S, seed=seed)) for seed in SEEDS}
    by_seed = F.array(*[F.struct(F.lit(seed).alias("seed"), cut.column().alias("split")) for seed, cut in cuts.items()])
    by_rule = F.array(*[
        F.struct(F.lit(f"rule{i}").alias("model"), argmax(_probabilities(w)).alias("pred")) for i, w in enumerate(GRID["w"])])
    rows = _class_inputs(p).select("y", "asset_id", F.explode(by_rule).alias("r")).select("y", "r.*", F.explode(by_seed).alias("s"))
    return metrics.macro_metrics(rows.select("y", "model", "pred", "s.*"), ["model", "seed", "split"])


def seed_mean_std(spark, folder):
    test = _sweep_results(spark, folder).filter("split = 'test'")
    return rounded(metrics.over_seeds(test, ["model"], "macro_f1"))


def result_pivot(spark, folder):
    test = _sweep_results(spark, folder).filter("split = 'test'")
    return rounded(metrics.pivot_results(test, "seed", "model", ["rule0", "rule1", "rule2"], "macro_f1"))


def best_by_validation(spark, folder):
    """Per seed the score rule with the best val score; test is only reported."""
    wide = _sweep_results(spark, folder).groupBy("seed", "model").agg(
        F.max(F.when(F.col("split") == "val", F.round("macro_f1", 9))).alias("val_score"),
        F.max(F.when(F.col("split") == "test", F.col("macro_f1"))).alias("test_score"))
    best = metrics.best_by_validation(wide.withColumn("grid_no", F.col("model")), model="seed")
    return rounded(best.select("seed", "model", "val_score", "test_score"))


# --- bootstrap -------------------------------------------------------------------------------


def _test_rows(p: Prepared) -> DataFrame:
    return _scored_instances(p).filter("split = 'test'")


def bootstrap_instance(spark, folder):
    test = _test_rows(prepared(spark, folder))
    draws = bootstrap.instance_bootstrap(test, BOOTSTRAP_ROUNDS, S.seed)
    return rounded(bootstrap.interval(draws, metrics.confusion_counts(df=test)))


def bootstrap_instance_multinomial(spark, folder):
    test = _test_rows(prepared(spark, folder))
    draws = bootstrap.instance_bootstrap_multinomial(test, S.bootstrap_iterations, S.seed)
    return rounded(bootstrap.interval(draws, metrics.confusion_counts(df=test)))


def bootstrap_asset(spark, folder):
    test = _test_rows(prepared(spark, folder))
    draws = bootstrap.asset_bootstrap(test, BOOTSTRAP_ROUNDS, S.seed)
    return rounded(bootstrap.interval(draws, metrics.confusion_counts(df=test), metrics.present_macro_f1_of_cells))


def bootstrap_asset_poisson(spark, folder):
    test = _test_rows(prepared(spark, folder))
    draws = bootstrap.asset_bootstrap_poisson(test, BOOTSTRAP_ROUNDS, S.seed)
    return rounded(bootstrap.interval(draws, metrics.confusion_counts(df=test)))


def bootstrap_ranking(spark, folder):
    test = _scored_cuts(prepared(spark, folder)).filter("split = 'test'")
    return rounded(bootstrap.ranking_bootstrap(test, BOOTSTRAP_ROUNDS, S.seed))


def bootstrap_forecast(spark, folder):
    test = _scored_cuts(prepared(spark, folder)).filter("split = 'test'")
    wanted = [resample_curves.roc_auc(), resample_curves.pr_auc(), resample_curves.f1_at(S.alert_threshold),
              *[resample_curves.capture(p) for p in (5, 10)]]
    return rounded(resample_curves.curve_intervals(test, wanted, BOOTSTRAP_ROUNDS, S.seed).withColumnRenamed("n_unique_units", "n_unique_assets"))


# --- propagation -----------------------------------------------------------------------------


def _node_features(p: Prepared) -> DataFrame:
    rows = _cheap_instances(p)
    return rows.select("asset_id", "window_id", F.col("n_records").cast("double").alias("f0"), (F.col("value__max") / 100).alias("f1"))


def graph_convolve(spark, folder):
    p = prepared(spark, folder)
    return rounded(propagation.convolve(_node_features(p), p.edges, ["f0", "f1"]))


def graph_mean_neighbours(spark, folder):
    p = prepared(spark, folder)
    return rounded(propagation.mean_neighbours(_node_features(p), p.edges, ["f0", "f1"]))


def graph_attend(spark, folder):
    p = prepared(spark, folder)
    return rounded(propagation.attend(_node_features(p), p.edges, ["f0", "f1"]))


def train_only_propagation(spark, folder):
    p = prepared(spark, folder)
    train = p.with_split(_node_features(p)).filter("split = 'train'").drop("split")
    return rounded(propagation.convolve(train, graph.induced_subgraph(p.edges, train), ["f0", "f1"], rounds=1))


def gated_streams(spark, folder):
    p = prepared(spark, folder)
    rows = _scored_instances(p).select("asset_id", "window_id", "proba").join(_node_features(p), ["asset_id", "window_id"])
    gates = evidence_gates(F.col("proba"))
    x = F.array("f0", "f1")
    out = rows.withColumn("iad", gated_stream(F.element_at(gates, 2), x)).withColumn("lmep", gated_stream(F.element_at(gates, 3), x))
    return rounded(out.select("asset_id", "window_id", *[
        F.element_at(s, i + 1).alias(f"{s}_{i}") for s in ("iad", "lmep") for i in range(3)]))


# --- reports and audits ----------------------------------------------------------------------


def dataset_summary(spark, folder):
    p = prepared(spark, folder)
    labelled = p.with_split(p.labels)
    width = p.fit_features(_split_instances(p)).width
    return summary.dataset_summary(
        p.records, p.raw, labelled, p.edges, _forecast(p), feature_dimension=width, delta_t=S.delta_t_seconds)


def busiest_asset(spark, folder):
    p = prepared(spark, folder)
    return summary.busiest_asset(p.records, p.labels)


def first_impact_asset(spark, folder):
    p = prepared(spark, folder)
    return summary.first_impact_asset(p.records, p.labels)


def cross_split_edges(spark, folder):
    p = prepared(spark, folder)
    return audits.cross_split_edges(p.edges, p.with_split(p.nodes))


def stamped_results(spark, folder):
    table = windows.count_stages(prepared(spark, folder).labelled)
    return sinks.stamped(table, sinks.stamps("events", S, **STAMP))


def json_results(spark, folder):
    """Stage counts through the JSON sink and back."""
    configure(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    table = windows.count_stages(prepared(spark, folder).labelled)
    sinks.write_json(sinks.stamped(table, sinks.stamps("events", S, **STAMP)), path)
    return sinks.read_results(spark, path, "json").select("dataset", "seed", "config_hash", "stage_label", "n")


def leakage_audit(spark, folder):
    p = prepared(spark, folder)
    rows, edges, ovr = keep(_split_instances(p)), keep(p.edges), keep(_ovr(p))
    encoder = features.FeatureEncoder(["n_records", "value__max"], []).fit(rows.filter("split = 'train'"))
    nodes = p.with_split(p.nodes)
    with_prefix = sequences.prefixes(_forecast(p), S.max_seq_len, ["window_id", "stage_label"])
    encoded = encoder.transform(rows)
    return audits.report([
        audits.asset_in_one_split(nodes),
        audits.encoder_is_train_only(encoder, rows),
        audits.fold_graph_is_train_only(edges, nodes),
        audits.no_impact_in_prefix(with_prefix),
        audits.no_impact_mass_in_features(encoded, encoder.width),
        audits.thresholds_ignore_test(ovr),
        audits.chronological(windows.chronology_violations(rows)),
        audits.edges_well_formed(edges, p.nodes),
        audits.probabilities_sum_to_one(_scored_instances(p)),
        audits.provenance_present({"stamped": stamped_results(spark, folder)}),
    ])


def audit_violations(spark, folder):
    """The audit over rows with planted faults: every check must turn red and count them all."""
    p = prepared(spark, folder)
    nodes = p.with_split(p.nodes)
    moved = nodes.filter("cast(asset_id AS bigint) % 10 = 0").withColumn("split", F.when(F.col("split") == "test", "train").otherwise("test"))
    loops = p.nodes.filter("window_id % 7 = 0").select(
        F.col("asset_id").alias("src_asset"), F.col("window_id").alias("src_window"), F.col("asset_id").alias("dst_asset"),
        F.col("window_id").alias("dst_window"), F.lit("temporal").alias("edge_type"))
    early = F.when(F.col("window_id") % 2 == 0, F.col("window_start_time") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("window_start_time"))
    doubled = F.when(F.col("y") == 1, F.transform("proba", lambda v: 2 * v)).otherwise(F.col("proba"))
    rows, edges = keep(_split_instances(p)), keep(p.edges)
    scored = _scored_rows(rows.withColumn("y", F.col("severity")))  # the same aggregates as in the instances
    fitted_on_all = features.FeatureEncoder(["n_records", "value__max"], []).fit(rows)
    reached = F.when(F.col("window_id") % 5 == 0, F.lit("IMP")).otherwise(F.lit("Benign"))
    with_impact = sequences.prefixes(_forecast(p).withColumn("stage_label", reached), S.max_seq_len, ["window_id", "stage_label"])
    # A third of the rows have their mass on a stage before impact, so one of their gates opens.
    certain = F.when(F.col("window_id") % 3 == 0, F.array(*map(F.lit, (0.0, 0.0, 1.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    on_all_rows = lambda ovr: ranking.validation_thresholds(ovr.withColumn("split", F.lit("val")))
    return audits.report([
        audits.no_impact_mass_in_features(fitted_on_all.transform(rows), fitted_on_all.width, certain),
        audits.thresholds_ignore_test(ranking.one_vs_rest(scored, ["asset_id", "window_id", "split"]), on_all_rows),
        audits.provenance_present({"stamped": stamped_results(spark, folder), "counts": windows.count_stages(p.labelled)}),
        audits.encoder_is_train_only(fitted_on_all, rows),
        audits.fold_graph_is_train_only(edges, nodes.unionByName(moved)),
        audits.no_impact_in_prefix(with_impact),
        audits.asset_in_one_split(nodes.unionByName(moved)),
        audits.chronological(windows.chronology_violations(rows.withColumn("window_start_time", early))),
        audits.edges_well_formed(edges.select(*loops.columns).unionByName(loops), p.nodes),
        audits.probabilities_sum_to_one(scored.withColumn("proba", doubled)),
    ])


def audit_verdict(spark, folder):
    return audits.verdict(leakage_audit(spark, folder))


# --- learned models (rows-only checks) -------------------------------------------------------

SMALL_FOREST = {"numTrees": 20, "maxDepth": 8}
SMALL_BOOSTED = {"maxIter": 10, "maxDepth": 4}


def _vector_rows(p: Prepared) -> DataFrame:
    """Rows with split, y and the sparse vector vec."""
    rows = cut_lineage(_split_instances(p))
    encoded = p.fit_features(rows).encode(rows).withColumn("y", F.col("severity").cast("double"))
    return cut_lineage(encoded.select("asset_id", "window_id", "split", "y", "vec"))


def _model_rows(p: Prepared) -> tuple[DataFrame, int]:
    """(rows with split, y, x; feature width)"""
    rows = cut_lineage(_split_instances(p))
    encoder = p.fit_features(rows)
    encoded = encoder.transform(rows).withColumn("y", F.col("severity").cast("double"))
    return encoded.select("asset_id", "window_id", "split", "y", "x"), encoder.width


def _base_scores(p: Prepared, n_folds: int) -> DataFrame:
    """The base scores of the model rows; the rows and edges behind them are dropped."""

    def edges() -> DataFrame:
        keep(p.labels)  # those of the rows' step are dropped
        return p.edges

    def scores() -> DataFrame:
        rows = cut_step(lambda: _model_rows(p)[0])
        return models.base_scores(rows, cut_step(edges), n_folds=n_folds, seed=S.seed, forest=SMALL_FOREST)

    return cut_step(scores)


def _report(scored: DataFrame, model: str) -> DataFrame:
    return rounded(metrics.macro_metrics(models.with_prediction(scored), ["split"]).withColumn("model", F.lit(model)))


def forest_stage(spark, folder):
    rows = _vector_rows(prepared(spark, folder))
    return _report(models.fit_forest(rows.filter("split = 'train'"), S.seed, **SMALL_FOREST)(rows), "forest")


def boosted_stage(spark, folder):
    rows = _vector_rows(prepared(spark, folder))
    return _report(models.fit_boosted(rows.filter("split = 'train'"), S.seed, **SMALL_BOOSTED)(rows), "boosted")


def stacked_stage(spark, folder):
    base = _base_scores(prepared(spark, folder), 5)
    views = {**models.base_views(base), "stacked": models.stacked(base, seed=S.seed)}
    return windows.union_all([_report(df, name) for name, df in views.items()])


def graph_stage(spark, folder):
    p = prepared(spark, folder)
    rows, width = _model_rows(p)
    rows, edges = cut_lineage(rows), cut_lineage(p.edges)
    return windows.union_all([
        _report(models.fit_graph_classifier(rows, edges, kind, S.seed), kind) for kind in ("mean", "attend")])


def history_stage(spark, folder):
    p = prepared(spark, folder)
    rows, width = _model_rows(p)
    flat = rows.select("asset_id", "window_id", "split", "y", *[F.col("x")[i].alias(f"f{i}") for i in range(width)])
    return _report(models.fit_history_classifier(flat, [f"f{i}" for i in range(width)], S.max_seq_len, S.seed), "history")


def impact_forecast(spark, folder):
    """Gated evidence streams over the prefix -> P(impact within the horizon); metric bundle per split.

    Stage scores are those of the stacked detector, out-of-fold on train rows: no row is scored by a model that saw its asset.
    """
    p = prepared(spark, folder)
    rows, width = _model_rows(p)
    rows = cut_lineage(rows)
    base = models.base_scores(rows, cut_lineage(p.edges), n_folds=5, seed=S.seed, forest=SMALL_FOREST)
    proba = models.stacked(base, seed=S.seed).select("asset_id", "window_id", "proba").join(rows.select("asset_id", "window_id", "x"), ["asset_id", "window_id"])
    gates = evidence_gates(F.col("proba"))
    streams = {
        f"{name}{i}": F.element_at(gated_stream(F.element_at(gates, k), F.col("x")), i + 1)
        for name, k in (("iad", 2), ("lmep", 3)) for i in range(width + 1)}
    gated = proba.select("asset_id", "window_id", *[c.alias(n) for n, c in streams.items()])
    cuts = _forecast(p).join(gated, ["asset_id", "window_id"])
    scored = models.fit_forecaster(models.forecaster_rows(cuts, list(streams), S.max_seq_len), S.seed)
    scored = scored.withColumn("hash_key", hash_hex(S.seed, F.col("asset_id"), F.col("window_id")))
    return rounded(ranking.forecast_metrics(scored, S.capture_at_percents, ["split"]))


def val_tuning(spark, folder):
    """Hyper-parameters chosen on val; test is only reported."""
    rows = _vector_rows(prepared(spark, folder))
    train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    forest = models.tune(train, rest, "forest", [{"numTrees": 10, "maxDepth": 5}, {"numTrees": 20, "maxDepth": 8}],
                         lambda t, **p: models.fit_forest(t, S.seed, **p))
    boosted = models.tune(train, rest, "boosted", [{"maxIter": 5, "maxDepth": 3}, {"maxIter": 10, "maxDepth": 4}],
                          lambda t, **p: models.fit_boosted(t, S.seed, **p))
    return rounded(metrics.best_by_validation(forest.unionByName(boosted)))


def meta_ablation(spark, folder):
    """Each meta-learner on the same base scores: macro F1 and mean Brier on test."""
    base = _base_scores(prepared(spark, folder), 3)
    small = {"logistic_regression": {}, "mlp": {"maxIter": 50}, "gradient_boosting": {"maxIter": 10}}
    parts = []
    for kind, params in small.items():
        test = models.with_prediction(models.stacked(base, kind, S.seed, **params).filter("split = 'test'"))
        parts.append(metrics.macro_metrics(test).select("macro_f1").crossJoin(metrics.mean_brier(test)).withColumn("meta", F.lit(kind)))
    return rounded(windows.union_all(parts))


def graph_mode_ablation(spark, folder):
    """The graph classifier on each edge set, with the set's nodes, undirected edges and average degree."""
    p = prepared(spark, folder)
    rows, width = _model_rows(p)
    rows, edges = cut_lineage(rows), cut_lineage(p.edges)
    reports = windows.union_all([
        _report(models.fit_graph_classifier(rows, graph.edges_for_mode(edges, mode), "convolve", S.seed), mode)
        for mode in graph.MODES])
    sizes = graph.graph_stats(edges, rows).withColumnRenamed("mode", "model")  # a row per mode
    return reports.join(F.broadcast(sizes), "model").select(*reports.columns, "n_nodes", "n_edges", "average_degree")


def registered(query):
    """Drop what the query before kept, so only one query's working tables are held at a time."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        release()
        return query(spark, folder)

    return run


QUERIES = {f.__name__: registered(f) for f in (
    normalized_records, binary_label_fallback, csv_shards, unmapped_labels, stage_counts, raw_type_counts, quality_row, quality_gate,
    asset_window_instances, lineitem_instances, lineitem_interactions, lineitem_edges, window_sweep, window_sweep_summary,
    mapping_variants, record_level_instances, flow_capture_instances, packet_capture_records, windows_per_asset, suspicious_windowing, data_volume, chronology_violations,
    asset_split, split_stage_crosstab, split_masks, asset_folds,
    interactions_distinct, interaction_edges, temporal_edges, graph_edges, representative_edges,
    record_level_edges, train_subgraph, graph_stats, node_degree, node_ids,
    first_impact, forecast_instances, forecast_unconfirmed_kept, prefix_steps, history_stats, horizon_sweep, forecast_summary,
    forecast_gate, skip_report, asset_timelines, impact_assets, ordinal_baselines,
    train_feature_params, train_category_modes, encoded_features, encoded_peers, class_weights, positive_weight,
    confusion_matrix, class_metrics, macro_metrics, long_metrics, mean_brier, ranking_metrics, pr_curve, roc_curve, capture_at_k,
    forecast_metrics, val_thresholds, ovr_alerting, predictions, late_fusion, seed_mean_std, result_pivot, best_by_validation,
    bootstrap_instance, bootstrap_instance_multinomial, bootstrap_asset, bootstrap_asset_poisson, bootstrap_ranking,
    bootstrap_forecast,
    graph_convolve, graph_mean_neighbours, graph_attend, train_only_propagation, gated_streams,
    dataset_summary, busiest_asset, first_impact_asset, cross_split_edges, stamped_results, json_results, leakage_audit, audit_violations, audit_verdict,
    forest_stage, boosted_stage, stacked_stage, graph_stage, history_stage, impact_forecast, val_tuning, meta_ablation,
    graph_mode_ablation,
)}
