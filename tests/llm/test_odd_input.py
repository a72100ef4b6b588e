"""Far outliers among vectors; columns of any name and type beside the documents' own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.llm import mixing, simhash, topk
from stagewise.llm.common import ready


@pytest.fixture(autouse=True)
def _folders(spark):
    ready(spark)


def best(rows, k):
    """Exact integers, one pair at a time."""
    least, most = -2 ** 63, 2 ** 63 - 1
    scaled = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    out = set()
    for q, a in scaled.items():
        scores = sorted((-max(least, min(most, sum(x * y for x, y in zip(a, b)))), i) for i, b in scaled.items() if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("far, bins", [(8.4e6, 4096), (1e7, 100), (1e13, 4096)])
def test_far_outlier_breaks_no_query(spark, far, bins):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(12)] + [(12, [far, 0.25]), (13, [-far, 0.5]), (14, [0.0, 0.0])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v", 256)
    got = {tuple(r) for r in topk.top_k(vectors, vectors, 3, bins).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == best(rows, 3)


def documents(spark):
    rows = [(1, "a", "one two three four", "first"), (2, "b", "one two three four", "second"), (2, "b", "one two three four", "second"),
            (3, None, None, "none"), (None, "a", "", "empty"), (None, "a", "", "empty"), (4, "a", "five six seven", "other")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, note string")
    return df.select("*", F.create_map("note", "doc_id").alias("pairs"), F.lit(1).alias("copies"), F.lit(2.0).alias("finish"),
                     F.lit("x").alias("_ticket"), F.lit(3).alias("size"), F.lit(4).alias("with.dot"))


def test_mix_keeps_columns_of_any_name_and_type(spark):
    docs = documents(spark)
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "source").agg(F.sum("copies").alias("copies")).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    counts = {}
    for r in got:
        counts[r.doc_id, r.source] = counts.get((r.doc_id, r.source), 0) + 1
        assert r.pairs == {r.note: r.doc_id} and r.copies == 1 and r["with.dot"] == 4 and r._ticket == "x"
    assert counts == plan and sum(counts.values()) > 0


def test_one_of_each_component_with_a_map_column(spark):
    docs = documents(spark)
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "doc_id long, component_id long")
    kept = simhash.keep_least(docs, found)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.note) for r in kept.collect()) == [(0, "empty"), (0, "empty"), (1, "first"), (3, "none"), (4, "other")]
