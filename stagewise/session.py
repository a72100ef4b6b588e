"""Session defaults. Only runtime SQL options, so they also apply to a session someone else built."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT: list[DataFrame] = []
_STEPS: list[list[DataFrame]] = []  # tables cut in each step that is under way, the outermost first

# Options the operators were planned for. Every one is a plan-time SQL option.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Kept tables get partitions by their size, and hot join keys are split in them, too.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults to a running session."""
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "stagewise", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that several branches of a plan read; lost blocks are recomputed from lineage. A cut table is read from its files."""
    if is_cut(df):
        return df
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


def release() -> None:
    """Drop everything kept so far. A plan that still refers to it stays valid and recomputes."""
    while _KEPT:
        _KEPT.pop().unpersist()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only in local mode.

    Lineage is cut with ``DataFrame.checkpoint()`` into this folder, so the cut
    survives the loss of executors.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="stagewise-checkpoint-")
    sc.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared checkpoint folder and go on from there.

    Iterative fits submit hundreds of small jobs; each would otherwise carry the whole
    plan behind its input.
    """
    ensure_checkpoint_dir(df.sparkSession)
    table = df.checkpoint()
    table._file = table._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    if _STEPS:
        _STEPS[-1].append(table)
    return table


def is_cut(df: DataFrame) -> bool:
    """Whether this is a table just as `cut_lineage` or `cut_step` gave it, with nothing planned upon it."""
    return "_file" in vars(df)


def discard(*tables: DataFrame) -> None:
    """Remove the files of cut tables that no later plan reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._file)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_step(build: Callable[[], DataFrame]) -> DataFrame:
    """The table that `build` returns, cut from its lineage; nothing else that the step put on disk or in memory stays.

    What was kept or cut inside the step is dropped, so `build` must not hand out anything that reads it but its result. Shuffle
    files go once the driver has collected the plans that they belong to, some of them behind the next step only.
    """
    kept = len(_KEPT)
    _STEPS.append([])
    try:
        made = build()
        table = made if is_cut(made) else cut_lineage(made.select("*"))  # run as a plan of its own: the caller's holds no shuffle
    finally:
        spent = _STEPS.pop()
    if _STEPS and any(t is table for t in spent):
        _STEPS[-1].append(table)
    while len(_KEPT) > kept:
        _KEPT.pop().unpersist(blocking=True)
    discard(*[t for t in spent if t is not table])
    del made, spent
    gc.collect()
    table.sparkSession._jvm.System.gc()
    return table
