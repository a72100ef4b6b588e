"""Result tables: sinks, the columns that tell where a table came from, and the skip report."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.settings import Settings

# Names that readers of result tables look for, and how many hex digits name a configuration.
REQUIRED_STAMPS = ["dataset", "seed", "config_hash", "timestamp_utc"]
METADATA = "_run_metadata"
HASH_DIGITS = 12


def settings_hash(settings: Settings | Mapping) -> Column:
    """Digits of the SHA-256 of the settings as JSON with sorted keys, as an expression of the plan."""
    text = settings.canonical_json() if isinstance(settings, Settings) else json.dumps(settings, sort_keys=True, default=str)
    return F.left(F.sha2(F.lit(text), 256), F.lit(HASH_DIGITS))


def stamps(dataset: str, settings: Settings, **more) -> dict[str, Column]:
    """Columns to add to a result table; `more` overrides them or adds to them."""
    now = F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    values = {"dataset": dataset, "seed": settings.seed, "config_hash": settings_hash(settings), "timestamp_utc": now, "mapping_variant": "primary", "is_real_data": True}
    return {name: v if isinstance(v, Column) else F.lit(v) for name, v in (values | more).items()}


def stamped(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add stamps; what the table itself says about a row, such as its split, is kept."""
    return df.withColumns({name: c for name, c in columns.items() if name not in df.columns})


def json_lines(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows as JSON text with the stamps in an object of their own."""
    held = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(F.to_json(F.struct("*", held.alias(METADATA)), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a result table again instead of recomputing it."""
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def skip_report(spark: SparkSession, dataset: str, experiment: str, reasons: list[str]) -> DataFrame:
    return spark.createDataFrame(
        [(dataset, experiment, False, reasons)], "dataset string, experiment string, run boolean, reasons array<string>")


def skip_report_from_gate(gate: DataFrame, dataset: str, experiment: str) -> DataFrame:
    """Skip report straight from a gate row with `reasons`; `run` tells whether the gate was passed."""
    return gate.select(
        F.lit(dataset).alias("dataset"), F.lit(experiment).alias("experiment"), (F.size("reasons") == 0).alias("run"), "reasons")


def prediction_table(scored: DataFrame) -> DataFrame:
    """Per-instance predictions of the held-out splits."""
    return scored.filter(F.col("split").isin("val", "test")).select(
        "split", "asset_id", "cut_window_id", F.col("label").alias("y_true"), F.col("score").alias("y_proba"))
