"""Scans: CSV shards, and the parquet tables of the test catalogue."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.scalar import quoted
from stagewise.sources import paths


# Fields that stand for a missing value in CSV files.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _csv_options(multi_line: bool, options: dict) -> dict:
    """Quoted fields may hold line breaks and doubled quotes."""
    return {"header": True, "inferSchema": False, "multiLine": multi_line, "escape": '"', **options}


def _header(spark: SparkSession, file: str, options: dict) -> tuple[str, ...]:
    return tuple(spark.read.options(**options).csv(file).columns)


def read_csv_shards(
    spark: SparkSession, files: list[str], same_header: bool = False, multi_line: bool = True, **options
) -> DataFrame:
    """All shards, every column as text, rows appended; fields that mean "missing" are NULL.

    Files are read whole by one task each, so that quoted fields may hold line breaks.
    A source known to have none can be split further with `multi_line=False`.

    Shards are grouped by header, one scan per distinct header; a column missing
    from a shard is NULL there. `same_header` skips the header comparison.
    """
    options = _csv_options(multi_line, options)
    if same_header or len(files) == 1:
        groups = {None: list(files)}
    else:
        with ThreadPoolExecutor(8) as pool:
            headers = list(pool.map(lambda f: _header(spark, f, options), files))
        groups = {}
        for file, header in zip(files, headers):
            groups.setdefault(header, []).append(file)
    out = None
    for members in groups.values():
        part = missing_as_null(trimmed_header(spark.read.options(**options).csv(members)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def trimmed_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def missing_as_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~quoted(c).isin(MISSING_TOKENS), quoted(c)).alias(c) for c in df.columns])


def read_folder(
    spark: SparkSession, folder: str, preferred: str | None = None, pattern: str = "*.csv", **options
) -> DataFrame:
    return read_csv_shards(spark, paths.resolve_files(spark, folder, preferred, pattern), **options)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with the two columns it only holds implicitly: peer and attack text."""
    attack = (
        F.when((F.col("event_type") == "purchase") & (F.col("value") >= 100), "ransomware")
        .when(F.col("event_type") == "error", "backdoor")
        .when(F.col("event_type") == "signup", "scanning")
        .otherwise("normal")
    )
    return read_table(spark, folder, "events").select(
        "event_id", "ts", "user_id", F.get_json_object("props", "$.k").alias("peer"),
        attack.alias("attack_type"), "event_type", "value",
    )


def read_lineitems(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as supplier -> part traffic; the attack text comes from flag and discount."""
    attack = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), "ransomware")
        .when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.06), "backdoor")
        .when((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.08), "scanning")
        .otherwise("normal")
    )
    return read_table(spark, folder, "lineitem").select(
        "l_shipdate", "l_suppkey", "l_partkey", attack.alias("attack_type"),
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice",
    )
