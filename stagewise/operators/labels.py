"""Stage labelling by a small lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.scalar import match_key
from stagewise.functions.vectors import STAGES, severity_of, stage_of
from stagewise.sources.label_maps import LABEL_MAPS, LabelMap
from stagewise.sources.normalize import name_key


def lookup_table(spark: SparkSession, maps: dict[str, LabelMap]) -> DataFrame:
    """(variant, key, stage) rows; a benign text beats a mapped one with the same key."""
    rows = []
    for variant, m in maps.items():
        stages = {name_key(k): s for k, s in m.stages.items()}
        stages |= {name_key(b): "Benign" for b in m.benign}
        rows += [(variant, key, stage) for key, stage in stages.items()]
    return spark.createDataFrame(rows, "variant string, label_key string, stage_label string")


def map_labels(records: DataFrame, label_map: LabelMap) -> DataFrame:
    """Add stage_label and severity. The table is a handful of literals, hence broadcast."""
    table = lookup_table(records.sparkSession, {"only": label_map}).drop("variant")
    return (
        records.withColumn("label_key", match_key(F.col("raw_attack_type")))
        .join(F.broadcast(table), "label_key", "left")
        .withColumn("stage_label", F.coalesce("stage_label", F.lit(label_map.default)))
        .withColumn("severity", severity_of(F.col("stage_label")))
        .drop("label_key")
    )


def map_labels_variants(records: DataFrame, maps: dict[str, LabelMap]) -> DataFrame:
    """Every record once per mapping variant, from one scan."""
    spark = records.sparkSession
    table = lookup_table(spark, maps)
    defaults = spark.createDataFrame(
        [(variant, m.default) for variant, m in maps.items()], "variant string, default_stage string"
    )
    return (
        records.withColumn("label_key", match_key(F.col("raw_attack_type")))
        .crossJoin(F.broadcast(defaults))
        .join(F.broadcast(table), ["variant", "label_key"], "left")
        .withColumn("stage_label", F.coalesce("stage_label", "default_stage"))
        .withColumn("severity", severity_of(F.col("stage_label")))
        .drop("label_key", "default_stage")
    )


def variant_window_labels(records: DataFrame, maps: dict[str, LabelMap], keys: list[str]) -> DataFrame:
    """(variant, keys, severity, stage) of each window: one severity column per variant, so records are not multiplied.

    The lookup is one broadcast row per known text; only the aggregated windows become a row per variant.
    """
    severity = lambda v: F.max(F.when(F.col("variant") == v, severity_of(F.col("stage_label"))))
    table = lookup_table(records.sparkSession, maps).groupBy("label_key").agg(*[severity(v).alias(f"_s_{v}") for v in maps])
    known = records.select(*keys, match_key(F.col("raw_attack_type")).alias("label_key")).join(F.broadcast(table), "label_key", "left")
    worst = known.groupBy(*keys).agg(*[
        F.max(F.coalesce(f"_s_{v}", severity_of(F.lit(m.default)))).alias(f"_s_{v}") for v, m in maps.items()])
    cells = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"_s_{v}").alias("severity")) for v in maps])
    return worst.select(F.explode(cells).alias("cell"), *keys).select("cell.variant", *keys, "cell.severity").withColumn(
        "stage_label", stage_of(F.col("severity")))


def unmapped_labels(records: DataFrame, label_map: LabelMap) -> DataFrame:
    """Distinct raw texts the mapping does not know, sorted."""
    keys = lookup_table(records.sparkSession, {"only": label_map}).select("label_key")
    return (
        records.select("raw_attack_type").distinct()
        .withColumn("label_key", match_key(F.col("raw_attack_type")))
        .join(F.broadcast(keys), "label_key", "left_anti")
        .select("raw_attack_type").orderBy("raw_attack_type")
    )


def mapping_problems(spark: SparkSession, maps: dict[str, dict[str, LabelMap]] | None = None) -> DataFrame:
    """One row per mapping table with what is wrong about it (empty array: valid)."""
    rows = [
        (source, variant, stage, m.default)
        for source, variants in (maps or LABEL_MAPS).items()
        for variant, m in variants.items()
        for stage in (list(m.stages.values()) or [None])
    ]
    table = spark.createDataFrame(rows, "source string, variant string, stage string, default_stage string")
    return table.groupBy("source", "variant").agg(
        F.count("stage").alias("n_labels"),
        F.array_compact(F.array(
            F.when(F.count("stage") == 0, F.lit("empty mapping")),
            F.when(F.sum((~F.col("stage").isin(STAGES[1:])).cast("int")) > 0, F.lit("unknown stage")),
            F.when(F.max((~F.col("default_stage").isin(STAGES)).cast("int")) > 0, F.lit("unknown default")),
        )).alias("problems"),
    )
