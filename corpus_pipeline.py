"""Corpus preparation, stage by stage. Each stage takes the documents its predecessor kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm import langid, mixing, near_copies, packing, pii
from stagewise.llm.common import FEW_ROWS, ready, stored
from stagewise.llm.queries import SURROGATE_KEY, TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model is sure of; texts without a letter and NULL texts go."""
    ready(spark, scan_rows=FEW_ROWS)
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 or more."""
    ready(spark, FEW_ROWS, FEW_ROWS)
    return near_copies.keep_one(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced, and n_chars set to the new length."""
    ready(spark, scan_rows=FEW_ROWS)
    new = pii.replaced(docs, SURROGATE_KEY)
    return new.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else new


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    ready(spark, scan_rows=FEW_ROWS)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    ready(spark, FEW_ROWS, FEW_ROWS)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii_surrogates", pii_surrogates),
    ("source_mix", source_mix),
    ("packed", packed),
]

# SQL has no trained models, XXH64 or tokenizers; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between two stages is a table in the shared folder."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
