"""Packing of documents into fixed-length training sequences by first-fit decreasing.

A document is its token ids and an end id. Ids beyond whole sequences are cut into pieces of full length, which
fill a sequence each; the rest of a document is one piece. Every group of documents drawn at random is packed on
its own: pieces by falling length, each into the first sequence with room, which a tournament tree over the free
room of all sequences finds in logarithmic time.

NULL or empty text: the end id alone. Repeated rows are packed once each. NULL doc_id is kept. Ties in length are
taken by doc_id, then start. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.encoding import encoder

LENGTH = 1024
END_ID = 0
GROUP_DOCS = 4096
SEED = 7

PIECES = "grp bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths must fall and not exceed the capacity.

    A tournament tree holds in each node the most free room below it, so the leftmost bin with enough room is
    found on one way down from the root.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """The pieces of every document, with the group it was drawn into."""
    groups = max(1, -(-docs.count() // group_docs))
    # Drawn by row, not by content: copies of one document spread over all groups.
    drawn = docs.select(
        F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)).alias("grp"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for grp, doc_id, text in zip(batch.column("grp").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode_text(text.as_py()) + end
                for at in range(0, len(ids), 4 * length):
                    part = ids[at:at + 4 * length]
                    rows.append((grp, doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            names = ["grp", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 6, names)

    return drawn.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Every piece with its sequence and its offset there.

    Groups are near-even random shares of about `group_docs` documents, so a task holds a bounded number of
    pieces and needs nothing from other groups. Only piece sizes move, never ids. A sequence number is the
    group's number and the bin's number within it.
    """

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="first")
        lengths = frame["length"].to_numpy()
        full = int(np.count_nonzero(lengths == length))  # each fills the next empty bin
        bins, offsets = first_fit_decreasing(lengths[full:].tolist(), length)
        frame["sequence_id"] = (frame["grp"].to_numpy() << 32) + np.concatenate([np.arange(full), np.array(bins, np.int64) + full]).astype(np.int64)
        frame["offset"] = np.concatenate([np.zeros(full), np.array(offsets, np.int64)]).astype(np.int64)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame.drop(columns="grp")

    cut = pieces(docs, tokenizer, length, end_id, group_docs, seed)
    return cut.groupBy("grp").applyInPandas(
        group, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
