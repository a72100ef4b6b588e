"""File checks through Hadoop's file system API, so they hold for any storage scheme."""

from __future__ import annotations

from pyspark.sql import SparkSession

# File whose presence marks a folder as generated data.
SYNTHETIC_MARKER = ".SYNTHETIC_DATA_MARKER"


class SyntheticDataError(RuntimeError):
    pass


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs_and_path(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in found or [] if s.isFile())


def resolve_files(spark: SparkSession, folder: str, preferred: str | None, pattern: str) -> list[str]:
    """The preferred file if it exists, else every match of the pattern in name order."""
    folder = folder.rstrip("/")
    if preferred and exists(spark, f"{folder}/{preferred}"):
        return [f"{folder}/{preferred}"]
    found = glob(spark, f"{folder}/{pattern}")
    if not found:
        raise FileNotFoundError(
            f"no raw files in {folder}: neither '{preferred}' nor anything matching '{pattern}'"
        )
    return found


def is_synthetic(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder.rstrip('/')}/{SYNTHETIC_MARKER}")


def require_real(spark: SparkSession, folder: str, allow_synthetic: bool = False) -> None:
    """Refuse to go on when the source folder is marked as generated data."""
    if is_synthetic(spark, folder) and not allow_synthetic:
        raise SyntheticDataError(
            f"{folder} holds {SYNTHETIC_MARKER}; results from generated data are refused "
            "unless allow_synthetic is set"
        )
