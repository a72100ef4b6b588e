"""Near-duplicate detection by SimHash fingerprints and Golay-code fuzzy hashing.

Two fingerprints of 64 bits are linked if they differ in at most two bits. Cut into three segments, two differing
bits leave at least one segment untouched, and the bits around it differ in two places at most. Every 23-bit word lies
within distance 3 of exactly one codeword of the binary Golay code, so two words at distance 2 have a word between
them whose codeword is within 4 of both: the indices of all codewords within 4 of a word (one to six) are its fuzzy
keys, and words at distance 2 share at least one. A bucket is a segment's exact value with a fuzzy key of the 23 bits
after it; fingerprints that share a bucket with others are candidates.

Candidates are verified by one rule, whatever a bucket holds, and never by all pairs: two fingerprints differ in two
bits or fewer exactly if some value is within one bit of both. So each candidate emits the 65 values within one bit,
and those that meet at a value are linked to the least there, which finds every link's component.

NULL or empty text has fingerprint zero and is linked like any other. Rows are independent: repeated rows get the same
answer, exact copies share a fingerprint. A NULL doc_id keeps its row; component ids are the least non-NULL doc_id.
Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import components, stored

SHINGLE = 3
SEED = 42

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, fixed value: generates the Golay code
WORD_BITS, CHECK_BITS = 23, 11
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text: bit i is set if over half of its shingles' XXH64 have it set."""
    import xxhash

    words = (data or b"").lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], "<u8")
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())), "<u8", len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for texts of any length
        counts += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, fp), fp the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial; zero for codewords."""
    left = np.array(words, np.int64)
    for bit in range(WORD_BITS - 1, CHECK_BITS - 1, -1):
        left ^= np.where((left >> bit) & 1, np.int64(GENERATOR << (bit - CHECK_BITS)), 0)
    return left


def near_patterns() -> np.ndarray:
    """For each syndrome the bit patterns of weight 4 or less that have it, -1 where there are fewer than six."""
    ones = [1 << b for b in range(WORD_BITS)]
    level, patterns = [(0, 0)], [0]
    for _ in range(4):
        level = [(p | ones[b], b + 1) for p, at in level for b in range(at, WORD_BITS)]
        patterns += [p for p, _ in level]
    patterns = np.array(patterns)
    of = syndromes(patterns)
    table = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, np.int64)
    for s, p in zip(of.tolist(), patterns.tolist()):
        table[s, used[s]] = p
        used[s] += 1
    return table


def bucket_keys(fps: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, one row of 18 each; -1 where there are fewer.

    A key is the segment's number, its exact value and the 12-bit index of a codeword near the 23 bits after it.
    """
    bits, keys = fps.astype(np.uint64), []
    for i, (first, width) in enumerate(SEGMENTS):
        exact = ((bits >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        after = np.uint64((first + width) % 64)
        turned = (bits >> after) | (bits << ((np.uint64(64) - after) % np.uint64(64))) if after else bits
        word = (turned & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        found = patterns[syndromes(word)]
        index = (word[:, None] ^ found) >> CHECK_BITS
        keys.append(np.where(found >= 0, (i << 40) | (exact[:, None] << 12) | index, -1))
    return np.concatenate(keys, axis=1)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = near_patterns()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            keys = bucket_keys(fp.view(np.uint64), patterns)
            held = keys >= 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[held]), pa.array(np.repeat(fp, held.sum(1)))], ["key", "fp"])

    return fps.mapInArrow(run, "key bigint, fp bigint")


def candidates(fps: DataFrame) -> DataFrame:
    """Those of distinct fingerprints that share a bucket with another: a superset of all that have a link."""
    keyed = _keyed(fps)
    shared = keyed.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("greatest")).filter("least < greatest").select("key")
    return keyed.join(shared, "key", "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly those connected by two-bit links.

    Each candidate is tied to the least one that it meets within one bit: at most 65 edges a fingerprint.
    """
    within_one = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    meeting = candidates(fps).select("fp", F.explode(within_one).alias("value"))
    # At most 65 fingerprints are within one bit of a value, so these lists are bounded.
    met = meeting.groupBy("value").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, fp, component_id (least doc_id reachable by links, itself included)."""
    hashed = stored(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component: that of the least doc_id (of rows that repeat it, the first by text hash).

    Rows without a doc_id cannot be named by a component; all of them stay.
    """
    named = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_near_id")).distinct()
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "doc_id"}
    others = [c for name, c in quoted.items() if name != "text"]
    tie = F.struct(F.xxhash64("text"), F.to_json(F.struct(*others)) if others else F.lit(""))  # orders columns of any type
    rows = docs.join(named, F.col("doc_id") == F.col("_near_id"), "left_semi")
    # The least row by a map-side combined minimum: a doc_id that many rows repeat is no one task's work.
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*quoted.values()), tie).alias("_near_row"))
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col("_near_row")[c].alias(c) for c in docs.columns])
    return one.unionByName(docs.filter("doc_id IS NULL"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One document of each component of fingerprints within two bits, as in `keep_least`."""
    return keep_least(docs, near_duplicates(docs, shingle, seed))
