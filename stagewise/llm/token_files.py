"""Token ids of whole texts as Parquet list columns, for selective reads of tokens and of metadata.

A file holds one row per document: `doc_id`, `n_tokens`, `ids`. Rows are in ascending `doc_id` order within and
across files. `ids` are dictionary-encoded (a vocabulary fits into one dictionary page), `doc_id` and `n_tokens`
delta-encoded. Row groups and pages are small, and the page indexes that Parquet writers add let a reader that asks
for a range of documents, or for the metadata columns alone, skip the pages of all other tokens.

NULL or empty text: the end id alone. NULL doc_id: kept, sorted first. Repeated rows: each is a document of its own.
Documents that tie in doc_id are ordered by a hash of their text. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagewise.llm.common import shared_folder
from stagewise.llm.encoding import encoder

END_ID = 2
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, n_tokens, ids), in the order of the input rows."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            texts = batch.column("text")
            start = 0
            while start < len(texts):  # a batch of very long texts goes on in parts
                parts, size, stop = [], 0, start
                while stop < len(texts) and size < 64 << 20:
                    parts.append(encode_text(texts[stop].as_py()) + end)
                    size += len(parts[-1])
                    stop += 1
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
                flat = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    ["doc_id", "n_tokens", "ids"],
                )
                start = stop

    return docs.mapInArrow(ids, "doc_id bigint, n_tokens int, ids array<int>")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of `docs` (doc_id, text) as files in ascending doc_id order.

    The text moves once, by ranges of (doc_id, hash of the text), so that no doc_id fills a file of its own.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    placed = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    encode(placed, tokenizer, end_id).write.options(**FILE_OPTIONS).parquet(folder)


def read(spark: SparkSession, folder: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Documents of the files with `file`, their file's place in the order, and `row`, theirs in the file.

    `columns` reads no others, and `where` over doc_id or n_tokens reaches the page indexes.
    """
    files = spark.read.schema("doc_id bigint, n_tokens int, ids array<int>").parquet(folder)
    files = files.select(
        *(columns or ["doc_id", "n_tokens", "ids"]),
        F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return files if where is None else files.filter(where)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32 of the ids as read back."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("row"), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    docs = read(spark, folder, ["doc_id", "ids"]).mapInArrow(crc, "doc_id bigint, file bigint, row bigint, n_tokens bigint, ids_crc32 bigint")
    # Files are even ranges, so a file's running total is one task's work; what lies before it is one total per file.
    sizes = read(spark, folder, ["n_tokens"]).groupBy("file").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, "file").select(
        "doc_id", (F.col("_before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write all documents and return the digest read back from the files."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    write(docs, folder, tokenizer, end_id)
    return digest(spark, folder)
