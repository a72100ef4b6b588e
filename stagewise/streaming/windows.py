"""The window aggregate over a stream of labelled records, for sources that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions.timecols import epoch_micros
from stagewise.functions.vectors import stage_of
from stagewise.operators.windows import numeric_aggregates


def stream_instances(records: DataFrame, delta_t_seconds: int, lateness: str, numeric: list[str]) -> DataFrame:
    """(asset, window) rows with numeric aggregates and the worst stage.

    Buckets are those of the batch operator (aligned to the epoch). In append mode a row
    comes out once the watermark has passed the end of its window, so state is bounded by
    the windows still open. Watermarks need an instant, so the zone-free time is read as UTC.
    """
    timed = records.withColumn("_at", F.timestamp_micros(epoch_micros(F.col("timestamp"))))
    grouped = timed.withWatermark("_at", lateness).groupBy(
        "asset_id", F.window("_at", f"{int(delta_t_seconds)} seconds").alias("_bucket")
    ).agg(
        F.count("*").alias("n_records"), F.min("timestamp").alias("window_start_time"),
        *numeric_aggregates(numeric), F.max("severity").alias("severity"),
    )
    start = F.unix_seconds(F.col("_bucket").getField("start"))
    return grouped.withColumn("window_id", F.floor(start / int(delta_t_seconds)).cast("bigint")).withColumn(
        "stage_label", stage_of(F.col("severity"))).drop("_bucket")
