"""Near copies against a brute-force version: all pairs, exact similarity of five-word shingle sets."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from near_copies_by_pairs import all_pairs  # noqa: E402
from stagewise.llm import near_copies, simhash  # noqa: E402
from stagewise.llm.common import ready  # noqa: E402

SCHEMA = "doc_id long, text string, component_id int, key string, node string, n string"


def edited(words, rng, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(600)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((40, 120, 400)))]
        if i % 3 == 0:
            base = passage + base  # a passage that many documents share
        texts.append(base)
        for _ in range(i % 4):
            texts.append(edited(base, rng, max(1, len(base) // rng.choice((25, 50, 100)))))
    hub = [rng.choice(vocabulary) for _ in range(300)]
    texts += [edited(hub, rng, rng.choice((1, 4, 6))) for _ in range(150)] + [hub] * 40  # more than any small bucket
    texts += [["a"], ["a"], ["a", "b"], [], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_copies_match_all_pairs(spark, rows):
    ready(spark)
    docs = spark.createDataFrame([(d, t.upper() if d % 2 else t, 0, "k", "x", "y") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == all_pairs(rows)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_odd_rows(spark):
    ready(spark)
    long = " ".join(f"w{i % 977}x{i}" for i in range(60000))
    rest = (None, "k", None, "1")
    rows = [(1, "one two three", *rest), (2, None, *rest), (3, "", *rest), (None, "no id", *rest), (4, long, *rest), (5, long + " end", *rest), (1, "one two three", *rest), (1, "other", *rest), (6, "other", *rest)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 1}
    assert sorted((r.doc_id or 0) for r in near_copies.keep_one(docs).collect()) == [0, 1, 2, 4]
    assert near_copies.near_copies(docs.limit(0)).count() == 0
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_shared_keys_within_two_bits():
    rng = random.Random(1)
    patterns = simhash.near_patterns()
    anchors = list(range(near_copies.ORDERS))
    for _ in range(50):
        fp = rng.getrandbits(64)
        other = fp ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        both = set(near_copies.fuzzy_keys(fp, anchors, patterns)) & set(near_copies.fuzzy_keys(other, anchors, patterns))
        assert len(both) >= near_copies.ORDERS  # a shared key in every window


def test_planted_edits_on_documents(spark):
    ready(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == all_pairs(rows)


def test_pairs_that_share_no_bucket_are_found(spark):
    ready(spark)
    # Pairs of 198 shingles each, 176 of them in common: a similarity of exactly 0.8. The buckets alone miss some.
    rows = []
    for i in range(600):
        common = [f"w{i}x{j}" for j in range(180)]
        rows += [(2 * i, " ".join(common + [f"a{i}x{j}" for j in range(22)])), (2 * i + 1, " ".join(common + [f"b{i}x{j}" for j in range(22)]))]
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: d - d % 2 for d, _ in rows}
