"""Helpers that the operators of this folder share."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.session import configure, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what counts as a word in every contract of this folder
BROADCAST_ROWS = 1 << 18  # narrow rows up to which a table is broadcast
BATCH_ROWS = 2000  # rows per Arrow batch; texts are long
SCAN_ROWS = 4096  # rows that a Parquet scan decodes at once, Spark's default
FEW_ROWS = 256  # either of them where a long job's executors keep the memory that large batches of texts once took


def ready(spark: SparkSession, batch_rows: int = BATCH_ROWS, scan_rows: int = SCAN_ROWS) -> SparkSession:
    """Plan-time options the operators were written for. Fewer rows at once take less memory of an executor, the rows stay the same."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(scan_rows))
    # Python workers that share the driver's disk find this package where the driver did; a cluster gets it by --py-files.
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share (`spark.checkpoint.dir`)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from the files.

    Later reads cost a scan instead of the plan behind the table, see the same rows even where that plan
    is not repeatable (sampled range bounds), and survive the loss of executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Remove stored tables that no later plan reads and, if asked, have the shuffle files of plans that are gone cleaned up."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if shuffles:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()  # the cleaner acts on what the driver's JVM has collected


def small_side(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is short enough. Beyond that it joins like any other."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def n_words(text: Column | str) -> Column:
    """Words of a text, 0 for a NULL one."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("bigint")


def running_sum(df: DataFrame, value: str, order: list[str], by: list[str] | None = None, out: str = "cum") -> DataFrame:
    """Add the inclusive running sum of `value` along `order`, within the groups of `by`.

    Rows are range-partitioned by (by, order) and the partition number is written down with them, so a group
    of any size is spread over as many tasks as it has ranges. A task adds up its own range; what comes before
    it is a sum over one total per range. NULLs sort first. Rows that tie in the whole order share no defined
    order among themselves; give an order that tells apart all rows whose values differ.
    """
    by = by or []
    ranged = stored(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    summed = ranged.withColumn(out, F.sum(value).over(inside)).join(offsets, same)
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_at", "_before", *[f"_by_{c}" for c in by])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with edges (a, b): rows (node, root), root the least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014). A step takes the least neighbour of each
    node by a map-side combined minimum and joins it back, so a node with very many neighbours is never one
    task's work. The edges of each step are written to the shared folder. Nodes without edges are not returned.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = None
    while True:
        # Large star: hang every greater neighbour of u on the least one of u's surroundings.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, both.a == least.u).filter("b > u").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = stored(large, "large")
        discard(now)
        # Small star: hang u and its lesser neighbours on the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
        joined = large.join(least, large.b == least.u)
        small = joined.select(F.explode(F.array(
            F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y"))
        )).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a < b").distinct()
        now = stored(small, "small")
        discard(large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
