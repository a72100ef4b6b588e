"""Near copies by verified SimHash: Golay fuzzy keys find most, a prefix filter the rest, exact five-word shingle similarity decides.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Their
fingerprints (64 bits, of distinct shingles) then differ in about ten bits, which leaves no segment of a useful width untouched.
So the exact part of a bucket key is not a segment but an anchor, the least shingle under one of a few orders, which two near
copies share with a chance equal to their similarity. Beside it stand the Golay fuzzy keys of 23 bits of the fingerprint, one
window of bits for each order (`simhash.bucket_keys` tells why words at distance 2 share a key; over half of those at distance 3
or 4 do, too). A bucket is a star: its members are compared with a few of them, drawn by hash, and each node keeps the nearest of
those it met. These links are verified and joined into classes, so a group of near copies costs a link a member.

Buckets miss pairs; those are found exactly. Of two sets as similar as asked, each with all shingles in one common order, the
first floor(0.2 n) + 1 share one. The order is from rare to frequent, by counts of slots, so that common lines come last. Documents
emit these shingles with the number of their set where they are read, no text moves for it; a shingle goes on if different sets
have it and then if different classes have it. Stars of shared shingles join what is left of large groups. Then all pairs of
different classes that could still be alike by the places of what they share (`_may_be_alike`), by their sizes and by their
parities (`_near_parities`) are verified. All three are bounds that no near copies break, so nothing is lost.

No bucket is capped. Texts with the same shingles are one node. NULL and empty texts have no shingle and are copies of each other; a
text of fewer than five words is one shingle. Rows without a doc_id are left out. Rows that repeat a doc_id are one document, linked
by any of its texts. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm import simhash
from stagewise.llm.common import components, discard, small_side, stored

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
ORDERS = 3  # anchors and windows of fingerprint bits
STARS = 4  # rows of a key that the others are compared with
STAR_ROUNDS = 2  # rounds of the exact step that compare with stars before all pairs that are left
SLOTS = 1 << 16  # counters of shingles by hash, for the order of the exact step
PARITIES = 16  # words of 64 bits that tell how many shingles, odd or even, a set has in each slot
RADIUS = 22  # differing bits beyond which a bucket's candidate is not verified; at similarity 0.8, 1 pair in 10,000 is beyond

SIGNATURE = "doc_id bigint, digest binary, set bigint, n bigint, fp bigint, anchors array<bigint>, parities array<bigint>, slots binary"


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_set(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a UTF-8 text's word shingles."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    lasts = ends[min(shingle, len(words)) - 1:].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, lasts)), np.uint64, len(lasts)))


def _bits(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITIES slots: whether a set has an odd number of shingles there."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _set_number(hashes: np.ndarray) -> int:
    """64 bits of a set's digest, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def signatures(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per document: digest, number and size of its shingle set, fingerprint, and the least shingle of each order, parities.

    Each task adds a row without a doc_id that holds its counts of shingles by slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("set", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("anchors", pa.list_(pa.int64())), ("parities", pa.list_(pa.int64())), ("slots", pa.binary())])
        salts, held = _mixed(np.arange(1, ORDERS + 1, dtype=np.uint64)), np.zeros(SLOTS, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                hashes = shingle_set(text.as_py(), shingle, seed)
                held += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                anchors = np.array([_mixed(hashes ^ s).min() for s in salts] if len(hashes) else [], np.uint64).view(np.int64)
                fp = int(np.uint64(_bits(hashes)).astype(np.int64))
                rows.append((doc_id, xxhash.xxh3_128_digest(hashes.tobytes()), _set_number(hashes), len(hashes), fp, anchors, _parities(hashes), None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([None] * 7 + [held.tobytes()], schema.types)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.filter("doc_id IS NOT NULL").mapInArrow(run, SIGNATURE)


def fuzzy_keys(fp: int, anchors: list[int], patterns: np.ndarray) -> np.ndarray:
    """Bucket keys of a fingerprint: for each order its anchor mixed with each near codeword of its window."""
    bits = np.uint64(fp % (1 << 64))
    firsts = np.arange(ORDERS, dtype=np.uint64) * np.uint64(64 // ORDERS)
    turned = (bits >> firsts) | (bits << ((np.uint64(64) - firsts) % np.uint64(64)))
    words = (turned & np.uint64((1 << simhash.WORD_BITS) - 1)).astype(np.int64)
    found = patterns[simhash.syndromes(words)]
    index = ((words[:, None] ^ found) >> simhash.CHECK_BITS).astype(np.uint64)
    order = np.arange(ORDERS, dtype=np.uint64)[:, None] << np.uint64(12)
    keys = _mixed(np.array(anchors, np.int64).view(np.uint64)[:, None] ^ _mixed((order | index) + np.uint64(1)))
    return keys[found >= 0].view(np.int64)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = simhash.near_patterns()
        for batch in batches:
            fps = batch.column("fp").to_pylist()
            keys = [fuzzy_keys(fp, a, patterns) for fp, a in zip(fps, batch.column("anchors").to_pylist())]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), *[batch.column(c).take(pa.array(at)) for c in ("node", "n", "fp")]], ["key", "node", "n", "fp"]
                )

    return nodes.filter("n > 0").select("node", "n", "fp", "anchors").mapInArrow(run, "key bigint, node bigint, n bigint, fp bigint")


def _stars(rows: DataFrame, salt: int) -> DataFrame:
    """Up to STARS rows of each key that has several, drawn by hash: key, star."""
    drawn = F.struct(F.xxhash64("key", "node", F.lit(salt)).alias("draw"), *[c for c in rows.columns if c != "key"])
    best = [F.min(F.when(F.pmod(drawn["draw"], F.lit(STARS)) == i, drawn)) for i in range(STARS)]
    stars = rows.groupBy("key").agg(F.count("*").alias("n"), F.array_compact(F.array(*best)).alias("stars")).filter("n > 1")
    return stars.select("key", F.explode("stars").alias("star"))


def _nearest(nodes: DataFrame, similarity: float) -> DataFrame:
    """For each node the nearest by fingerprint of its buckets' stars: pairs (a, b) to verify."""
    keyed = stored(_keyed(nodes), "keyed")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("star.fp")))
    alike = F.least("n", "star.n") / F.greatest("n", "star.n") >= similarity
    met = keyed.join(_stars(keyed, 0), "key").filter((F.col("star.node") != F.col("node")) & alike & (apart <= RADIUS))
    near = met.groupBy("node").agg(F.min(F.struct(apart.alias("apart"), "star.node")).alias("near"))
    found = stored(near.select(F.least("near.node", "node").alias("a"), F.greatest("near.node", "node").alias("b")).distinct(), "nearest")
    discard(keyed, shuffles=True)
    return found


def _near_parities(a: str, b: str, similarity: float) -> Column:
    """Whether two sets (n, parities) may be as similar as asked by what slots they hold shingles in.

    A shingle that one of two sets has and the other lacks turns one bit, so the sets differ in at least as many shingles as their
    parities do in bits. Sets as similar as asked differ in (1 - similarity) / (1 + similarity) of their summed sizes at most.
    """
    apart = sum(F.bit_count(F.col(f"{a}parities")[i].bitwiseXOR(F.col(f"{b}parities")[i])) for i in range(PARITIES))
    return apart <= F.floor((F.col(f"{a}n") + F.col(f"{b}n")) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _still_near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the stored pairs (a, b) of nodes that have sets with near parities."""
    a, b = (nodes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("parities").alias(f"{s}_parities")) for s in "ab")
    found = small_side(pairs).join(a, "a").join(b, "b").filter(_near_parities("a_", "b_", similarity)).select("a", "b").distinct()
    return stored(found, "near")


def _similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of sorted 8-byte hashes are as similar as asked; sets without a shingle are not."""
    both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return len(both) > common and common / (len(both) - common) >= similarity


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int, seed: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose shingle sets are as similar as asked. Only their texts are read into sets.

    A set is one value of sorted 8-byte hashes: lists of numbers would be taken apart and built again by each step on their way.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle, seed).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "hashes"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [_similar(a.as_py(), b.as_py(), similarity) for a, b in zip(batch.column("hashes_a"), batch.column("hashes_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = stored(texts.join(small_side(wanted), "doc_id", "left_semi").mapInArrow(hashed, "doc_id bigint, hashes binary"), "sets")
    left, right = (sets.select(F.col("doc_id").alias(s), F.col("hashes").alias(f"hashes_{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "hashes_a", "hashes_b")
    found = stored(both.mapInArrow(compared, "a bigint, b bigint").distinct(), "verified")
    discard(wanted, sets)
    return found


def _slot_counts(signed: DataFrame) -> np.ndarray:
    """Shingles of all documents by slot of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for slots in batch.column("slots").to_pylist():
                held += np.frombuffer(slots, np.int64)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    counts = signed.filter("slots IS NOT NULL").select("slots").mapInArrow(run, "slot bigint, n bigint")
    for r in counts.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        out[r.slot] = r.n
    return out


def prefix_size(n: int, share: float) -> int:
    """Shingles of n from the rare end of which a set with `share` of them in common must have one."""
    return n - int(np.ceil(share * n - 1e-9)) + 1 if n else 0


def _prefixes(docs: DataFrame, counts: np.ndarray, shingle: int, similarity: float, seed: int) -> DataFrame:
    """Rows (key, set, n): the first shingles of each text's set from rare to frequent, of which two near copies share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's rows
        for batch in batches:
            keys, numbers, sizes = [np.zeros(0, np.uint64)], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), shingle, seed)
                number = _set_number(hashes)
                if not len(hashes) or number in seen:
                    continue
                seen.add(number)
                order = np.lexsort((hashes, counts[(hashes % np.uint64(SLOTS)).astype(np.int64)]))
                keys.append(hashes[order[:prefix_size(len(hashes), similarity)]])
                numbers.append(number)
                sizes.append(len(hashes))
            lengths = [len(k) for k in keys[1:]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(numbers, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
            ], ["key", "set", "n"])

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "key bigint, set bigint, n int")


def _met(docs: DataFrame, counts: np.ndarray, shingle: int, similarity: float, seed: int) -> DataFrame:
    """Prefixes by exact rarity: rows (key, set, place, p, n) of shingles that several sets have in their prefixes of p."""
    prefixes = stored(_prefixes(docs, counts, shingle, similarity, seed), "prefixes")
    held = prefixes.groupBy("key").agg(F.min("set").alias("first"), F.max("set").alias("last"), F.count("*").alias("holders")).filter("first < last")
    met = prefixes.join(held.select("key", "holders"), "key")
    size = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1  # as prefix_size
    own = Window.partitionBy("set")
    place = F.col("p") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "key")) - 1
    found = stored(met.withColumn("p", size).select("key", "set", place.alias("place"), "p", "n"), "met")
    discard(prefixes, shuffles=True)
    return found


def _may_be_alike(a: str, b: str, similarity: float) -> Column:
    """Whether two rows of a key in different classes may belong to near copies that first meet at this key.

    Beyond its prefix a set has n - p shingles, so two prefixes have at least c = (what the sets must have in common) minus the
    greater of the two rests in common. Put a prefix in order of how many sets hold a shingle, counted exactly by now: the first
    common one has c - 1 behind it in both. So a pair meets at a shingle that stands at place p - c or before in both, or not at
    all; texts that share a passage and little else have too many shingles of their own before it.
    """
    def of(c: str) -> tuple[Column, Column]:
        return F.col(f"{a}{c}"), F.col(f"{b}{c}")

    (n_a, n_b), (p_a, p_b), (place_a, place_b), (class_a, class_b) = map(of, ("n", "p", "place", "class"))
    common = F.ceil(similarity / (1 + similarity) * (n_a + n_b) - 1e-9) - F.greatest(n_a - p_a, n_b - p_b)
    return (class_a != class_b) & (F.least(n_a, n_b) / F.greatest(n_a, n_b) >= similarity) & (F.least(p_a - place_a, p_b - place_b) >= common)


def _between_classes(met: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (key, set, node, class, place, p, n) of keys that several classes have."""
    rows = stored(met.join(small_side(named), "set").select("key", "set", "node", "class", "place", "p", "n"), "placed")
    several = rows.groupBy("key").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first < last")
    found = stored(rows.join(several.select("key"), "key", "left_semi"), "shared")
    discard(rows)
    return found


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their classes after links between nodes. Only what changes goes through the components."""
    of = named.select("node", "class").distinct()
    a, b = (of.select(F.col("node").alias(s), F.col("class").alias(f"class_{s}")) for s in "ab")
    edges = links.join(a, "a").join(b, "b").filter("class_a != class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    roots = components(edges).withColumnRenamed("node", "class")
    return stored(named.join(roots, "class", "left").select("set", "node", F.coalesce("root", "class").alias("class")), "named")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """Per doc_id: component_id, the least doc_id reachable by near copies, itself included."""
    signed = stored(signatures(docs, shingle, seed), "signatures")
    counts = _slot_counts(signed)
    signed = signed.filter("doc_id IS NOT NULL").select("doc_id", "digest", "set", "n", "fp", "anchors", "parities")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min(F.struct("set", "n", "fp", "anchors", "parities")).alias("s"))
    nodes = stored(nodes.select("digest", "node", "s.*"), "nodes")

    # Copies of a set go where its node goes. A doc_id with several texts links their nodes.
    placed = stored(signed.select("digest", "doc_id").join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct(), "placed")
    torn = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    torn = placed.join(torn, "doc_id").filter("a < node").select("a", F.col("node").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(_still_near(pairs, nodes, similarity), docs, similarity, shingle, seed)

    # The nearest of each node's buckets.
    named = _joined(nodes.select("set", "node", F.col("node").alias("class")), verified(_nearest(nodes, similarity)).unionByName(torn))

    # Stars of shared shingles first: they join large groups by a few links a member. Then all pairs that are left.
    met = _met(docs, counts, shingle, similarity, seed)
    for salt in range(1, STAR_ROUNDS + 1):
        shared = _between_classes(met, named)
        pairs = shared.join(_stars(shared, salt), "key").withColumns({f"star_{c}": F.col(f"star.{c}") for c in ("class", "place", "p", "n")})
        pairs = pairs.filter(_may_be_alike("", "star_", similarity)).select(F.least("node", "star.node").alias("a"), F.greatest("node", "star.node").alias("b"))
        named = _joined(named, verified(stored(pairs.filter("a < b").distinct(), "pairs")))
        discard(shared, shuffles=True)
    shared = _between_classes(met, named)
    sided = shared.join(nodes.select("set", "parities"), "set")
    a, b = (sided.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "class", "place", "p", "n", "parities")]) for s in "ab")
    pairs = a.join(b, "key").filter((F.col("a_node") < F.col("b_node")) & _may_be_alike("a_", "b_", similarity) & _near_parities("a_", "b_", similarity))
    named = _joined(named, verified(stored(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), "pairs")))
    discard(met, shared)
    return placed.join(named.select("node", "class").distinct(), "node").groupBy("doc_id").agg(F.min("class").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """One document of each group of near copies, as in `simhash.keep_least`."""
    return simhash.keep_least(docs, near_copies(docs, shingle, similarity, seed))
