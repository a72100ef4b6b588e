"""Operators over ids, fingerprints, queues and vectors against plain versions, and the pipeline as a whole."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from near_copies_by_pairs import all_pairs  # noqa: E402
from stagewise.llm import mixing, packing, simhash, token_files, topk  # noqa: E402
from stagewise.llm.common import components, ready, running_sum  # noqa: E402
from stagewise.llm.encoding import encoder  # noqa: E402
from stagewise.llm.queries import TOKENIZER  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, grp int, key string"


@pytest.fixture()
def odd(spark):
    """NULLs in all columns, empty, very long and repeated texts, and columns named like the operators' own."""
    ready(spark)
    rest = ("x", "y", 1, "k")
    long = "the long text of a document " * 30000
    rows = [
        (1, "The cat and the dog.", "en", "a", 20, *rest), (2, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, *rest), (None, "no id at all", "en", "b", 3, *rest),
        (4, long, "en", "b", len(long), *rest), (1, "The cat and the dog.", "en", "a", 20, *rest), (1, "Another text.", "en", "a", 20, *rest), (5, " \n\t ", "de", "b", 9, *rest),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Encoding, token files, packing


def test_encoder_gives_the_tokenizer_s_ids(plain_tokenizer):
    encode = encoder(TOKENIZER)
    pieces = ["word", " ", "  ", "\n", "\t", ".", ",", "...", "'s", "don't", "é", "日本", "3", "1,000.5", "!", "\"x\",", "_a_", "<|endoftext|>", "<|", "\x01", "\x1c", "\xa0", "²", "🙂", "a.b", "X", " "]
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_round_trip(spark, odd, plain_tokenizer, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id > 5").unionByName(odd.select("doc_id", "text"))
    folder = str(tmp_path / "tokens")
    token_files.write(docs.repartition(7), folder, TOKENIZER)
    rows = token_files.read(spark, folder).orderBy("file", "row").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    want = Counter((r.doc_id, tuple(plain_tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    digest = sorted(map(tuple, token_files.digest(spark, folder).collect()), key=lambda r: r[1])
    at = 0
    for (doc_id, start, n, sums), row in zip(digest, rows, strict=True):
        assert (doc_id, start, n, sums) == (row.doc_id, at, len(row.ids), crc(row.ids))
        at += n
    few = token_files.read(spark, folder, ["doc_id", "n_tokens"], F.col("doc_id").between(20, 29))
    assert few.count() == docs.filter("doc_id BETWEEN 20 AND 29").count()
    assert few.columns == ["doc_id", "n_tokens", "file", "row"]


def test_token_files_have_dictionary_pages_and_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    ready(spark)
    folder = str(tmp_path / "tokens")
    token_files.write(spark.read.parquet(f"{SF}/documents.parquet"), folder, TOKENIZER)
    meta = pq.ParquetFile(next(Path(folder).glob("part-*.parquet"))).metadata.row_group(0)
    by = {meta.column(i).path_in_schema.split(".")[0]: meta.column(i) for i in range(meta.num_columns)}
    assert by["ids"].has_dictionary_page and not by["doc_id"].has_dictionary_page and by["doc_id"].has_offset_index
    assert any("DELTA" in e for e in by["doc_id"].encodings)


def test_token_files_of_an_empty_table(odd):
    assert token_files.token_files(odd.limit(0), TOKENIZER).count() == 0


def check_packing(docs, found, plain_tokenizer, most_padding):
    want = Counter()
    for doc_id, text in docs:
        ids = plain_tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.update((doc_id, at, len(ids[at:at + 1024]), crc(ids[at:at + 1024]), len(ids)) for at in range(0, len(ids), 1024))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    sequences = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 for n in sequences.values())
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sequences.values())
    assert padding <= most_padding * (padding + sum(sequences.values()))


def test_packing(spark, odd, plain_tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs, TOKENIZER).collect(), plain_tokenizer, 0.02)
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.pack(odd, TOKENIZER, group_docs=3).collect(), plain_tokenizer, 1)
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_first_fit_decreasing_is_that_of_a_plain_search():
    rng = random.Random(2)
    for n in (0, 1, 2, 300):
        lengths = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        room, want = [], []
        for x in lengths:
            b = next((i for i, r in enumerate(room) if r >= x), len(room))
            if b == len(room):
                room.append(100)
            want.append((b, 100 - room[b]))
            room[b] -= x
        assert list(zip(*packing.first_fit_decreasing(lengths, 100))) == want


# SimHash


def plain_fingerprint(text, k=3):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Least member of each fingerprint's component, by comparing all pairs."""
    least = {}
    for start in sorted(fps):
        if start not in least:
            least[start], queue = start, [start]
            while queue:
                a = queue.pop()
                for b in fps:
                    if b not in least and (a ^ b).bit_count() <= 2:
                        least[b] = start
                        queue.append(b)
    return least


def test_simhash_against_all_pairs(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id > 5").unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    root, first = plain_components({fp for _, fp in rows}), {}
    for doc_id, fp in rows:
        if doc_id is not None:
            first[root[fp]] = min(doc_id, first.get(root[fp], doc_id))
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("f"), "component_id").collect()
    assert Counter(map(tuple, found)) == Counter((d, f"{fp:016x}", first.get(root[fp])) for d, fp in rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_golay_keys_meet_for_all_words_two_bits_apart():
    patterns = simhash.near_patterns()
    assert set((patterns >= 0).sum(1).tolist()) == {1, 6}
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200).astype(np.uint64)
    for _ in range(30):
        a, b = (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64) for _ in range(2))
        for x, y in zip(simhash.bucket_keys(fps, patterns).tolist(), simhash.bucket_keys(fps ^ a ^ b, patterns).tolist()):
            assert (set(x) & set(y)) - {-1}


@pytest.mark.parametrize("copies", [150, 2])
def test_links_span_components_of_crowded_and_small_buckets(spark, copies):
    ready(spark)
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b for x in base for b in [x, *(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(copies))]} | {rng.getrandbits(64) for _ in range(50)}
    signed = {fp - (1 << 64) if fp >> 63 else fp: fp for fp in fps}
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {signed[r.node]: signed[r.root] for r in components(simhash.links(table)).collect()}
    root = plain_components(fps)
    groups, want = {}, {}
    for fp in fps:
        groups.setdefault(found.get(fp, fp), set()).add(fp)
        want.setdefault(root[fp], set()).add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4] and ids.count(None) == 1  # 2, 3 and 5 have no words
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    ready(spark)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 4999), (4999, 5000), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(301)) and all(found[i] == 1000 for i in range(1000, 1400)) and found[5000] == 4999
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_sum_over_ties_and_nulls(spark):
    ready(spark)
    rows = [(g, k, v) for g in ("a", None) for k in (None, 1, 2, 2, 3) for v in (1, 2)]
    found = running_sum(spark.createDataFrame(rows, "g string, k int, v long").repartition(5), "v", ["k", "v"], by=["g"]).collect()
    for g in ("a", None):
        own = sorted((r.cum, r.k is not None, r.k or 0, r.v) for r in found if r.g == g)
        assert [c for c, *_ in own] == np.cumsum([v for *_, v in own]).tolist() and [o[1:3] for o in own] == sorted(o[1:3] for o in own)


# Mixing


def test_mix_targets(spark):
    ready(spark)
    sized = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 490), ("d", 0)], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(sized).collect()}
    weights, size = {"a": 5.0, "b": 2.0, "c": 1.0, "d": 5.0, None: 2.0}, {"a": 1000, "b": 10, "c": 500, "d": 0, None: 490}
    target, left, open_ = dict.fromkeys(size, 0.0), 2000.0, set(size)
    while left > 1e-9 and open_:  # rounds of sharing, as a plain version
        share, left = left / sum(weights[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += share * weights[s]
            if target[s] >= 3 * size[s]:
                left += target[s] - 3 * size[s]
                target[s] = 3.0 * size[s]
                open_.discard(s)
    assert found.keys() == target.keys() and all(abs(found[s] - target[s]) < 1e-6 for s in target)


def test_mix(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    most = max(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in target) and sum(taken.values()) <= sum(r["size"] for r in rows)
    table = mixing.mixed_documents(docs)
    assert table.columns == docs.columns
    counted = Counter(r.doc_id for r in table.select("doc_id").collect())
    assert counted == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mix(odd).count() == 8 and mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0
    counted = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(odd).collect())
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.copies
    assert {d: sum(n for (i, _), n in counted.items() if i == d) for d in want if want[d]} == {d: n for d, n in want.items() if n}
    assert all(r.taken == 0 for r in mixing.mix(odd.filter("text IS NULL")).collect())


# Top-k


def plain_top(vectors, queries, k):
    out = []
    for q, a in queries.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors if v != q)
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("bins", "scale"), [(4096, 1), (8, 1), (64, 10**8)])
def test_top_k(spark, bins, scale):
    ready(spark)
    rng = np.random.default_rng(7)
    vectors = [(i, [int(x) * scale for x in rng.integers(-3, 4, 5)]) for i in range(300)] + [(300 + i, [scale, 0, 0, 0, 0]) for i in range(100)] + [(900, [scale])]
    table = spark.createDataFrame(vectors, "vec_id long, vec array<long>")
    found = topk.top_k(table, table.filter("vec_id % 50 = 0"), 5, bins).collect()
    assert sorted(map(tuple, found)) == plain_top(vectors, {v: a for v, a in vectors if v % 50 == 0}, 5)


def test_top_k_odd_rows(spark):
    ready(spark)
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (50, [0.5, 0.5], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    vectors = topk.quantized(table, "vec_id", "embedding", 256)
    found = sorted(map(tuple, topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()))
    assert [(q, v) for q, _, v, _ in found] == [(0, 50), (0, 5), (0, 5), (50, 0), (50, 5), (50, 5)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


# Pipeline


def test_pipeline_is_its_stages_one_after_another(spark, plain_tokenizer):
    ready(spark)
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packed":
            assert out.columns == first.columns and dict(out.dtypes) == dict(first.dtypes)
        held.append(out.collect())
        docs = spark.createDataFrame(held[-1], out.schema)
    kept, deduped, replaced, mixed, packed = held
    texts = {r.doc_id: r.text for r in first.collect()}
    assert {r.doc_id for r in kept} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    classes = all_pairs([(r.doc_id, r.text) for r in kept])
    assert sorted(r.doc_id for r in deduped) == sorted(set(classes.values()))
    assert {r.doc_id for r in replaced} == {r.doc_id for r in deduped} and all(r.n_chars == len(r.text) for r in replaced)
    assert {r.doc_id: r.text for r in mixed}.items() <= {r.doc_id: r.text for r in replaced}.items()
    check_packing([(r.doc_id, r.text) for r in mixed], packed, plain_tokenizer, 0.05)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in packed)


def test_pipeline_stages_take_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[0][1](spark, odd, SF).columns == odd.columns
