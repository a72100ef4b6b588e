"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, in each of a few passes. A pass counts scores in equal
bins of the interval that is known to hold a query's k-th best score; the bin where the counts from the top reach k
is the next interval. Bins shrink to single integers, and a last pass returns what lies above each k-th score, and as
many of its ties as are wanted, by smaller id. Counts, never scores, move between tasks, and of those only the bins
down to a task's own k-th score, since the global one cannot be lower.

Vectors that are NULL, or hold NULL or non-finite components, take no part, nor do rows with a NULL id. Rows that
repeat an id are candidates each; as queries they count once (the least vector), and no candidate with the query's
own id is returned to it. Vectors of different lengths are compared as if the shorter went on with zeros. A query
with fewer than k candidates gets them all. Other columns are ignored. Quantized components must fit into a long, of any
size: far outliers only make the first bins wider. A score beyond a long counts as the greatest or least long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import stored

K = 5
BINS = 4096
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
ROUND_BLOCKS = 16  # query blocks broadcast at once: at most 16 * 1024 vectors


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (vec_id, vec) of the vectors that take part, components as integers floor(scale * x)."""
    vec = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vec"))


def _packed(frames: Iterator[pd.DataFrame], block: int, width: int) -> Iterator[pd.DataFrame]:
    """Rows (ids, matrix), each with up to `block` vectors."""
    for frame in frames:
        for at in range(0, len(frame), block):
            part = frame.iloc[at:at + block]
            matrix = np.zeros((len(part), width), "<i8")
            for row, vec in zip(matrix, part["vec"]):
                row[:len(vec)] = vec
            yield pd.DataFrame({"ids": [part["vec_id"].to_numpy("<i8").tobytes()], "matrix": [matrix.tobytes()]})


def _matrices(row, width: int, exact_in_double: bool):
    queries = np.frombuffer(row.q_matrix, "<i8").reshape(-1, width)
    candidates = np.frombuffer(row.matrix, "<i8").reshape(-1, width)
    near = queries.astype(np.float64) @ candidates.astype(np.float64).T
    scores = near.astype(np.int64) if exact_in_double else _saturated(queries @ candidates.T, near)
    q_ids, ids = np.frombuffer(row.q_ids, "<i8"), np.frombuffer(row.ids, "<i8")
    return q_ids, ids, scores, q_ids[:, None] != ids[None, :]


def _saturated(scores: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Products modulo 2**64, right wherever they fit into a long, and the limits of a long where `near`, the same
    products in doubles, shows that they do not."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    beyond = (np.abs(near) >= 2.0 ** 62) & (((scores < 0) != (near < 0)) | (np.abs(near) >= 1.5 * 2.0 ** 63))
    return np.where(beyond, np.where(near < 0, least, most), scores)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, bins: int = BINS) -> DataFrame:
    """The k best of `vectors` for each of `queries` (both vec_id, vec): query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    limits = vectors.agg(
        F.max(F.size("vec")).alias("width"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("most")
    ).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not limits.width:
        return spark.createDataFrame([], schema)
    if bins < 4:
        raise ValueError("at least four bins")
    width = limits.width
    bound = min(width * int(limits.most or 0) ** 2, 1 << 63)  # no score lies outside -bound..bound
    exact = bound < 1 << 53
    candidates = stored(vectors.repartition("vec_id").mapInPandas(lambda it: _packed(it, CANDIDATE_BLOCK, width), "ids binary, matrix binary"), "candidates")
    wanted = stored(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    n_blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    n_rounds = -(-n_blocks // ROUND_BLOCKS)
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))

    def query_blocks(state: DataFrame) -> DataFrame:
        """One row per block of queries: ids, matrix and where each query's search stands."""

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            matrix = np.zeros((len(frame), width), "<i8")
            for row, vec in zip(matrix, frame["vec"]):
                row[:len(vec)] = vec
            data = {c: [frame[c].to_numpy("<i8").tobytes()] for c in ("lo", "need")}
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "q_ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "q_matrix": [matrix.tobytes()], **data})

        return dealt.join(state, "vec_id").groupBy("block").applyInPandas(pack, "block bigint, q_ids binary, q_matrix binary, lo binary, need binary")

    def against(blocks: DataFrame, work, result: str) -> DataFrame:
        """Every candidate block with every query block. A round broadcasts a bounded number of query blocks."""
        parts = None
        for n in range(n_rounds):
            first, last = n * ROUND_BLOCKS, min(n_blocks, (n + 1) * ROUND_BLOCKS)
            numbered = candidates.withColumn("block", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last - 1).cast("bigint"))))
            part = numbered.join(F.broadcast(blocks.filter(F.col("block").between(first, last - 1))), "block").mapInPandas(work, result)
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def counting(span: int, size: int):
        return lambda frames: count(frames, span, size)

    def count(frames: Iterator[pd.DataFrame], span: int, size: int) -> Iterator[pd.DataFrame]:
        """Counts of a task by query and bin of `size` scores, from the top bin down to the task's own k-th score."""
        held: dict[bytes, tuple] = {}
        for frame in frames:
            for row in frame.itertuples():
                q_ids, _, scores, other = _matrices(row, width, exact)
                lo = np.frombuffer(row.lo, "<i8")
                counts = held.setdefault(row.q_ids, (q_ids, np.frombuffer(row.need, "<i8"), np.zeros((len(q_ids), bins), np.int32)))[2]
                above = scores.view(np.uint64) - lo.view(np.uint64)[:, None]  # modulo 2**64: a score below lo is far above
                q, c = np.nonzero(other & (above <= np.uint64(span - 1)))
                at = (above[q, c] // np.uint64(size)).astype(np.int64)
                counts += np.bincount(q * bins + at, minlength=counts.size).reshape(counts.shape).astype(np.int32)
        for q_ids, need, counts in held.values():
            above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # in higher bins of this task
            q, b = np.nonzero((counts > 0) & (above < need[:, None]))
            yield pd.DataFrame({"vec_id": q_ids[q], "bin": b.astype(np.int64), "n": counts[q, b].astype(np.int64)})

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's candidates above the k-th scores, and of the ties as many as can be wanted."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            for row in frame.itertuples():
                q_ids, ids, scores, other = _matrices(row, width, exact)
                kth, need = np.frombuffer(row.lo, "<i8"), np.frombuffer(row.need, "<i8")
                q, c = np.nonzero(other & (scores > kth[:, None]))
                held.append(pd.DataFrame({"query_id": q_ids[q], "vec_id": ids[c], "score": scores[q, c]}))
                order = np.argsort(ids, kind="stable")
                ties = (other & (scores == kth[:, None]))[:, order]
                q, c = np.nonzero(ties & (ties.cumsum(1) <= need[:, None]))
                held.append(pd.DataFrame({"query_id": q_ids[q], "vec_id": ids[order][c], "score": scores[q, order[c]]}))
            if sum(map(len, held)) > 500_000:
                held = [_best(pd.concat(held), k)]
        if held:
            yield _best(pd.concat(held), k)

    # The interval that holds the k-th best score, `span` scores from lo on: `need` more are wanted from it.
    first = max(-bound, -(1 << 63))
    state = wanted.select("vec_id", F.lit(first).cast("bigint").alias("lo"), F.lit(k).cast("bigint").alias("need"))
    span = min(2 * bound + 1, 1 << 64)
    while span > 1:
        size = -(-span // bins)
        found = against(query_blocks(state), counting(span, size), "vec_id bigint, bin bigint, n bigint").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin"))
        total = F.sum("n").over(down)
        reached = found.select("vec_id", "bin", "n", total.alias("upto")).join(state, "vec_id")
        # With fewer candidates than wanted, the lowest bin that holds any.
        met = reached.groupBy("vec_id").agg(
            F.first("lo").alias("lo"), F.first("need").alias("need"),
            F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "n"))).alias("hit"), F.min(F.struct("bin", "upto", "n")).alias("lowest"),
        ).withColumn("hit", F.coalesce("hit", "lowest"))
        wide = "decimal(20,0)"  # lo and the step may each be half of all longs
        state = stored(met.select(
            "vec_id", (F.col("lo").cast(wide) + F.col("hit.bin").cast(wide) * F.lit(size).cast(wide)).cast("bigint").alias("lo"),
            F.greatest(F.lit(1), F.col("need") - (F.col("hit.upto") - F.col("hit.n"))).cast("bigint").alias("need"),
        ), "search")
        span = size
    best = against(query_blocks(state), select, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return frame.groupby("query_id", sort=False).head(k)
