"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from stagewise.plans.queries import QUERIES
from stagewise.session import build, release

HEADLINE = [
    "asset_window_instances", "lineitem_instances", "window_sweep", "asset_split", "interaction_edges", "lineitem_edges", "graph_edges",
    "train_subgraph", "forecast_instances", "prefix_steps", "horizon_sweep", "train_feature_params", "macro_metrics", "ranking_metrics",
    "capture_at_k", "ovr_alerting", "bootstrap_asset", "bootstrap_asset_poisson", "graph_convolve", "graph_attend", "dataset_summary",
    "forest_stage",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["stage_counts"](spark, folder).collect()  # start the JVM's engine outside the timings
    seconds, rows = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release()
    n_events = spark.read.parquet(f"{folder}/events.parquet").count()
    for name in ("asset_window_instances", "interaction_edges", "forecast_instances", "bootstrap_asset"):
        rows[name] = round(n_events / seconds[name])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "events_per_sec": rows, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
