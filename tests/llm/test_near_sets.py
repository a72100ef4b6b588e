"""Verification of near copies: sets travel as one value each, batches are short, and the rule is the exact one."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stagewise.llm import common, near_copies
from stagewise.llm.common import ready


def test_similarity_of_sorted_sets():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ({rng.randrange(40) for _ in range(rng.randrange(40))} for _ in "ab")
        if rng.random() < 0.5:
            b = set(sorted(a)[rng.randrange(4):]) | {rng.randrange(40) for _ in range(rng.randrange(3))}
        sets = [np.array(sorted(s), np.uint64).tobytes() for s in (a, b)]
        assert near_copies._similar(*sets, 0.8) == (len(a | b) > 0 and len(a & b) / len(a | b) >= 0.8)


def test_verified_sets_are_single_values_and_repeated_ids_match_any_text(spark, monkeypatch):
    ready(spark)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, "nothing of it is in the other text"), (3, " ".join(words + ["end"])), (3, None), (4, None), (5, " ".join(words[30:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep, kinds = near_copies.stored, {}

    def traced(table, name):
        kinds[name] = dict(table.dtypes)
        return keep(table, name)

    monkeypatch.setattr(near_copies, "stored", traced)
    pairs = keep(spark.createDataFrame([(1, 2), (1, 3), (3, 4), (1, 5), (1, 9)], "a long, b long"), "pairs")
    found = near_copies._verified(pairs, docs, 0.8, near_copies.SHINGLE, near_copies.SEED)
    assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 3)]
    assert kinds["sets"] == {"doc_id": "bigint", "hashes": "binary"}


def test_stage_reads_texts_in_short_batches(spark):
    rows = [(i, f"text number {i} of a few hundred words or not") for i in range(50)] + [(50, "text number 1 of a few hundred words or not")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    for option in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        assert int(spark.conf.get(option)) <= common.FEW_ROWS
    assert kept.count() == 50 and kept.agg(F.max("doc_id")).first()[0] == 49
    ready(spark)
