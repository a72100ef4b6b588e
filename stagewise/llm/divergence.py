"""Source divergence audit by hash-consed segment trees.

Terms are runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII. Each language keeps the terms of at least ten of its
documents. For every source of a language, p of a kept term is its share of the source's kept words, smoothed by two a term, in
whole parts of 10^9 plus one; p and q of two groups differ by f = floor((p - q)^2 / (p + q)). All arithmetic is in whole numbers.

The kept terms of a language are dealt by hash into blocks of about `BLOCK` terms; a block is a segment tree over its terms (by
falling count in the language, so that absent terms lie together). Trees of all sources of a block share nodes: a node is interned
by its pair of children, a leaf by its count. Two trees are walked down together, level by level; equal pairs of nodes meet in one
entry that remembers how often they occur, so each is followed and, at the leaves, priced once. Partial sums of blocks are added up.
No task holds more than a block of terms for two groups of about `SOURCES` sources each, whatever the sizes of languages and sources.

NULL text, language and source are read as ''. Rows are independent: rows that repeat a doc_id count each, and no other column is
read. A language without kept terms has p = 1 everywhere, so its pairs differ by 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import small_side, stored

LEAST_DOCUMENTS = 10
TERM_RANKS = 10
SMOOTHING = 2
PARTS = 10**9
BLOCK = 2048  # terms of a segment tree
SOURCES = 128  # sources of one side of a task
HELD = 300_000  # entries a counting task holds before it passes them on

_ALPHABET = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTIAL = "lang string, source string, term binary, n bigint, df bigint"


# Counts


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, df): occurrences and documents. Every group has a row with term '' as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        entries = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = [b"", *n]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64()),
                ], ["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                words = text.translate(_ALPHABET).split(b" ") if text else []
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                entries -= len(n)
                n.update(words)
                df.update(set(words))
                n.pop(b"", None)
                df.pop(b"", None)
                entries += len(n)
                if entries > HELD:
                    yield from flushed()
                    entries = 0
        yield from flushed()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, _PARTIAL).withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


# Trees


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of counts in a group of `total` kept words and a language of `terms` kept terms; exact while total + 2 terms < 9 * 10^15."""
    rest, whole = counts + SMOOTHING, np.zeros(len(counts), np.int64)
    size = max(total + SMOOTHING * terms, 1)
    for _ in range(3):  # three digits at a time
        rest = rest * 1000
        whole = whole * 1000 + rest // size
        rest = rest % size
    return whole + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Trees:
    """Segment trees over the columns of a table of counts, one for each row, with all equal subtrees in common."""

    def __init__(self, counts: np.ndarray):
        terms = counts.shape[1]
        self.depth = max(terms - 1, 0).bit_length()
        self.padding = (1 << self.depth) - terms
        padded = np.zeros((len(counts), 1 << self.depth), np.int64)
        padded[:, :terms] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.leaf_of = nodes
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: left and right child of each node
        for _ in range(self.depth):
            many = int(nodes.max(initial=0)) + 1
            pairs, ids = np.unique(nodes[:, 0::2] * many + nodes[:, 1::2], return_inverse=True)
            self.children.append((pairs // many, pairs % many))
            nodes = ids.reshape(len(counts), -1)
        self.roots = nodes[:, 0]

    def met(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of leaves that two trees have at a place, and at how many; places of padding are left out."""
        x, y, times = self.roots[[a]], self.roots[[b]], np.ones(1, np.int64)
        for left, right in reversed(self.children):
            x, y = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
            times = np.concatenate([times, times])
            key = x << 32 | y
            order = np.argsort(key)
            key = key[order]
            firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            x, y, times = key[firsts] >> 32, key[firsts] & 0xFFFFFFFF, np.add.reduceat(times[order], firsts)
        if self.padding:
            zero = np.searchsorted(self.leaves, 0)
            times = times - self.padding * ((x == zero) & (y == zero))
        return x, y, times


_FOUND = "lang string, source string, part string, item string, value bigint"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a block's pairs, and its best terms of each source."""
    heads = rows[rows.term.isna()].sort_values("source", ignore_index=True)
    body = rows[rows.term.notna()]
    lang, low, high = rows.lang.iloc[0], int(rows.low.iloc[0]), int(rows.high.iloc[0])
    vocabulary = body.drop_duplicates("term")[["term", "lang_n"]]
    vocabulary = vocabulary.assign(utf8=vocabulary.term.str.encode("utf-8")).sort_values(["lang_n", "utf8"], ascending=[False, True], ignore_index=True)
    column = pd.Series(vocabulary.index, vocabulary.term)
    row = pd.Series(heads.index, heads.source)
    counts = np.zeros((len(heads) + 1, int(heads.block_terms.iloc[0])), np.int64)  # terms that none of these sources has come last
    counts[row[body.source].to_numpy(np.int64), column[body.term].to_numpy(np.int64)] = body.n.to_numpy(np.int64)
    counts[-1, :len(vocabulary)] = vocabulary.lang_n.to_numpy(np.int64)
    trees = Trees(counts)
    terms = int(heads.terms.iloc[0])
    totals = [*heads.total.astype("int64"), int(heads.lang_total.iloc[0])]
    p = [shares(trees.leaves, t, terms) for t in totals]
    source, chunk = heads.source.tolist(), heads.chunk.tolist()

    found: list[tuple] = []
    for a in range(len(heads)):
        for b in range(a + 1, len(heads)):
            if {chunk[a], chunk[b]} == {low, high}:
                x, y, times = trees.met(a, b)
                value = int((prices(p[a][x], p[b][y]) * times).sum())
                found += [(lang, source[a], "pair", source[b], value), (lang, source[b], "pair", source[a], value)]
    if low == high and len(vocabulary):
        whole = len(heads)
        for a in range(len(heads)):
            x, y, _ = trees.met(a, whole)
            own, all_ = p[a][x], p[whole][y]
            wanted = (trees.leaves[x] > 0) & (own > all_)
            price = dict(zip((x[wanted] << 32 | y[wanted]).tolist(), prices(own, all_)[wanted].tolist()))
            at = (trees.leaf_of[a] << 32 | trees.leaf_of[whole])[:len(vocabulary)].tolist()
            best = sorted((-price[k], vocabulary.utf8[i], i) for i, k in enumerate(at) if k in price)[:TERM_RANKS]
            found += [(lang, source[a], "term", vocabulary.term[i], -v) for v, _, i in best]
    return pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): all other sources of the language, and the ten terms that set a source apart."""
    counts = stored(term_counts(docs), "counts")
    groups = counts.filter("term = ''").select("lang", "source")
    kept = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("df").alias("lang_df"), F.sum("n").alias("lang_n"))
    kept = kept.filter(F.col("lang_df") >= LEAST_DOCUMENTS).select("lang", "term", "lang_n")
    used = stored(counts.filter("term != ''").drop("df").join(kept, ["lang", "term"]), "used")

    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = used.groupBy("lang", "term").agg(F.min("lang_n").alias("lang_n"))
    by_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(by_lang, "lang", "left").fillna(0, ["terms", "lang_total"])
    sizes = sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK))).withColumn("chunks", F.ceil(F.col("sources") / SOURCES))
    sizes = small_side(stored(sizes, "sizes"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Each row to all pairs of source chunks that hold its own."""
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("source"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return rows.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("other")

    heads = dealt(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(sizes, "lang"))
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.pmod(F.xxhash64("term"), "blocks").alias("block")
    filled = vocabulary.join(sizes.select("lang", "blocks"), "lang").groupBy("lang", block).agg(F.count("*").alias("block_terms"))
    heads = heads.join(small_side(stored(filled, "filled")), ["lang", "block"], "left").fillna(0, ["block_terms"])
    body = dealt(used.join(sizes.select("lang", "blocks", "chunks"), "lang")).withColumn("block", block)
    common = ["lang", "source", "chunk", "low", "high", "block"]
    blank = {"term": "string", "n": "bigint", "lang_n": "bigint", "total": "bigint", "lang_total": "bigint", "terms": "bigint", "block_terms": "bigint"}

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select(*common, *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in blank.items()])

    found = shaped(heads).unionByName(shaped(body)).groupBy("lang", "block", "low", "high").applyInPandas(_block, _FOUND)
    found = stored(found, "found")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("part = 'term'")
    ordered = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= TERM_RANKS)
    return pairs.withColumn("rank", F.row_number().over(ordered)).unionByName(best)

