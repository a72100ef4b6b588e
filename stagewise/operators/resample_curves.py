"""Ranking metrics of many resamples at once, each row carrying an array of multiplicities.

A unit (asset) enters resample b as often as its Poisson(1) multiplicity says, which comes from a seeded hash, so an
array of all multiplicities can be made again wherever a row is. Rows are never multiplied: they are counted per
(unit, score, label), range-sorted once by falling score, and folded in place with one number per resample. What
leaves a range is one array per sum, so shuffled volume is rows + ranges x resamples, not rows x resamples.

A score held by very many rows (a hot score) may lie in several ranges: sums of a range's first and last score are
put together with those of its neighbours before they count. Ties go by the unit's hash, then positives first.

Rows with a NULL label, a NULL or NaN score take no part. A NULL unit is a unit of its own. An empty table gives no
samples. A metric that a resample leaves undefined (one class only) is NULL there and does not count as valid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import accumulate
from math import exp, factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions.scalar import hash_hex
from stagewise.session import cut_lineage

# P(X <= k) of a Poisson distribution with mean 1; a 32-bit uniform never passes the last one by a step.
POISSON_CDF = list(accumulate(exp(-1) / factorial(k) for k in range(12)))
ROWS_AT_ONCE = 256  # rows x resamples numbers are held at a time
CHUNK = 100  # resamples whose range sums one task puts together
POINT = -1  # the iteration that stands for the rows as they are


class Steps(NamedTuple):
    """A stretch of the curve: one line per distinct score (or per row), one column per resample."""

    score: np.ndarray
    pos: np.ndarray
    neg: np.ndarray
    before_pos: np.ndarray  # positives above this line
    before_neg: np.ndarray
    all_pos: np.ndarray  # one number per resample
    all_neg: np.ndarray


@dataclass(frozen=True)
class CurveMetric:
    """A metric that is a function of sums over the curve. `step` gives the sums of a stretch (`n_sums` arrays),
    `finish` the value from (sums, positives, negatives), NaN where it is undefined."""

    name: str
    step: Callable[[Steps], list[np.ndarray]]
    finish: Callable[[list[np.ndarray], np.ndarray, np.ndarray], np.ndarray]
    by_row: bool = False
    n_sums: int = 1


def _share(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    return np.divide(num, den, out=np.full(len(num), np.nan), where=den > 0)


def roc_auc() -> CurveMetric:
    """Area under the ROC curve; ties count half."""
    return CurveMetric("roc_auc", lambda at: [(at.neg * (at.before_pos + at.pos / 2)).sum(0)], lambda sums, pos, neg: _share(sums[0], pos * neg))


def pr_auc() -> CurveMetric:
    """Average precision, undefined with one class only."""

    def step(at: Steps) -> list[np.ndarray]:
        above = at.before_pos + at.pos
        return [(at.pos * above / np.maximum(above + at.before_neg + at.neg, 1)).sum(0)]

    return CurveMetric("pr_auc", step, lambda sums, pos, neg: _share(sums[0], np.where(neg > 0, pos, 0)))


def capture(percent: float) -> CurveMetric:
    """Share of positives among the top max(1, ceil(n * percent / 100)) rows of a resample."""

    def step(at: Steps) -> list[np.ndarray]:
        wanted = np.maximum(1, np.ceil((at.all_pos + at.all_neg) * percent / 100.0))
        taken = np.clip(wanted - at.before_pos - at.before_neg, 0, at.pos + at.neg)
        return [np.where(at.pos > 0, taken, 0).sum(0)]

    return CurveMetric(f"capture_at_{percent:g}pct", step, lambda sums, pos, neg: _share(sums[0], pos), by_row=True)


def f1_at(threshold: float) -> CurveMetric:
    """F1 of the rows at or above a threshold; 0 without any hit, undefined for an empty resample."""

    def step(at: Steps) -> list[np.ndarray]:
        hit = (at.score >= threshold)[:, None]
        return [(at.pos * hit).sum(0), (at.neg * hit).sum(0)]

    def finish(sums, pos, neg):
        share = _share(2.0 * sums[0], sums[0] + sums[1] + pos)
        return np.where(pos + neg > 0, np.nan_to_num(share), np.nan)

    return CurveMetric(f"f1_at_{threshold:g}", step, finish, n_sums=2)


def times_of(seed, units: list, iterations: int) -> np.ndarray:
    """units x iterations multiplicities, the same numbers as `bootstrap.poisson_times` gives."""
    heads = [f"{seed}|{i}" for i in range(iterations)]
    digests = bytearray()
    for unit in units:
        tail = "" if unit is None else f"|{unit}"
        for head in heads:
            digests += md5((head + tail).encode()).digest()[:4]
    uniform = np.frombuffer(bytes(digests), ">u4").reshape(len(units), iterations) / 4294967296.0
    return np.searchsorted(POISSON_CDF, uniform, side="right")


def _weights(frame: pd.DataFrame, seed, iterations: int) -> np.ndarray:
    """rows x (1 + iterations); the first column counts the rows as they are."""
    codes, units = pd.factorize(frame["unit"], use_na_sentinel=False)
    times = np.ones((len(units), iterations + 1))
    times[:, 1:] = times_of(seed, [None if pd.isna(u) else u for u in units], iterations)
    return times[codes] * frame["n"].to_numpy("f8")[:, None]


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), ROWS_AT_ONCE):
            yield frame.iloc[at:at + ROWS_AT_ONCE]


class _Groups:
    """Rows of one range, in order, gathered to distinct scores; the last score stays open until the next differs."""

    def __init__(self):
        self.score, self.pos, self.neg = None, None, None

    def add(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray):
        """The scores that are complete now: (score, pos, neg), possibly of no lines."""
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        held, pos, neg = score[starts], np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
        if self.score is not None:
            if self.score == held[0]:
                pos[0] += self.pos
                neg[0] += self.neg
            else:
                held, pos, neg = np.r_[self.score, held], np.vstack([self.pos[None], pos]), np.vstack([self.neg[None], neg])
        self.score, self.pos, self.neg = held[-1], pos[-1], neg[-1]
        return held[:-1], pos[:-1], neg[:-1]


def _before(lines: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums before each line, from `start` on."""
    return start + np.cumsum(lines, axis=0) - lines


ENDS = ("all_pos", "all_neg", "first_pos", "first_neg", "last_pos", "last_neg")


def _range_ends(frames: Iterator[pd.DataFrame], seed, iterations: int) -> Iterator[pd.DataFrame]:
    """Per range, in chunks of resamples: its sums, and those of its first and last score."""

    def result():
        arrays = dict(zip(ENDS, (*total, *first[1:], groups.pos, groups.neg)))
        for chunk, at in enumerate(range(0, iterations + 1, CHUNK)):
            yield {"part": part, "chunk": chunk, "first_score": first[0], "last_score": groups.score,
                   **{name: a[at:at + CHUNK].tobytes() for name, a in arrays.items()}}

    part, groups, first, total = None, None, None, None
    for piece in _pieces(frames):
        for number, rows in piece.groupby("part", sort=False):
            if number != part:
                if part is not None:
                    first = first or (groups.score, groups.pos, groups.neg)
                    yield pd.DataFrame(list(result()))
                part, groups, first, total = number, _Groups(), None, [np.zeros(iterations + 1), np.zeros(iterations + 1)]
            w, y = _weights(rows, seed, iterations), rows["label"].to_numpy("f8")[:, None]
            score, pos, neg = groups.add(rows["score"].to_numpy("f8"), w * y, w * (1 - y))
            total[0] += (w * y).sum(0)
            total[1] += (w * (1 - y)).sum(0)
            if first is None and len(score):
                first = (score[0], pos[0].copy(), neg[0].copy())
    if part is not None:
        first = first or (groups.score, groups.pos, groups.neg)
        yield pd.DataFrame(list(result()))


def _flat(sums: list[list[np.ndarray]]) -> bytes:
    return np.concatenate([a for parts in sums for a in parts]).tobytes() if sums else b""


def _joined_ends(frame: pd.DataFrame, metrics: list[CurveMetric]) -> pd.DataFrame:
    """For one chunk of resamples: what lies before each range, the totals, and the sums over scores at range ends."""
    frame = frame.sort_values("part")
    ends = {name: np.vstack([np.frombuffer(b, "f8") for b in frame[name]]) for name in ENDS}
    all_pos, all_neg = ends["all_pos"].sum(0), ends["all_neg"].sum(0)
    before_pos, before_neg = _before(ends["all_pos"], 0.0), _before(ends["all_neg"], 0.0)
    lines: list[list] = []  # score, pos, neg, before_pos, before_neg

    def meet(score, pos, neg, above_pos, above_neg):
        if lines and lines[-1][0] == score:
            lines[-1][1], lines[-1][2] = lines[-1][1] + pos, lines[-1][2] + neg
        else:
            lines.append([score, pos, neg, above_pos, above_neg])

    for i, (first, last) in enumerate(zip(frame["first_score"], frame["last_score"])):
        meet(first, ends["first_pos"][i], ends["first_neg"][i], before_pos[i], before_neg[i])
        if last != first:
            meet(last, ends["last_pos"][i], ends["last_neg"][i],
                 before_pos[i] + ends["all_pos"][i] - ends["last_pos"][i], before_neg[i] + ends["all_neg"][i] - ends["last_neg"][i])
    at = Steps(*[np.array([line[i] for line in lines]) for i in range(5)], all_pos, all_neg)
    sums = _flat([m.step(at) for m in metrics if not m.by_row])
    return pd.DataFrame({
        "part": frame["part"], "chunk": frame["chunk"], "before_pos": [a.tobytes() for a in before_pos], "before_neg": [a.tobytes() for a in before_neg],
        "tot_pos": all_pos.tobytes(), "tot_neg": all_neg.tobytes(), "edge": [sums] + [b""] * (len(frame) - 1),
    })


def _range_sums(frames: Iterator[pd.DataFrame], metrics: list[CurveMetric], seed, iterations: int) -> Iterator[pd.DataFrame]:
    """Sums of each metric over a task's ranges. The lines that tell what lies before a range precede its rows."""
    columns = iterations + 1
    sums = [[np.zeros(columns) for _ in range(m.n_sums)] for m in metrics]
    totals, head, part, groups, lead = None, {}, None, None, True

    def add(at: Steps, by_row: bool):
        for held, m in zip(sums, metrics):
            if m.by_row == by_row:
                for a, more in zip(held, m.step(at)):
                    a += more

    for piece in _pieces(frames):
        for number, rows in piece.groupby("part", sort=False):
            if number != part:
                part, head, groups, lead, above = number, {}, _Groups(), True, None
            for line in rows[rows["chunk"] >= 0].itertuples():
                head[line.chunk] = line
            rows = rows[rows["chunk"] < 0]
            if not len(rows):
                continue
            if above is None:
                order = [head[c] for c in sorted(head)]
                start_pos, start_neg, all_pos, all_neg = (
                    np.concatenate([np.frombuffer(getattr(line, c), "f8") for line in order]) for c in ("before_pos", "before_neg", "tot_pos", "tot_neg"))
                above, row_above, totals = [start_pos, start_neg], [start_pos, start_neg], (all_pos, all_neg)
                at = 0
                for line in order:  # sums over scores at range ends come with the first range
                    width = len(line.before_pos) // 8
                    if line.edge:
                        flat = iter(np.frombuffer(line.edge, "f8").reshape(-1, width))
                        for held, m in zip(sums, metrics):
                            if not m.by_row:
                                for a in held:
                                    a[at:at + width] += next(flat)
                    at += width
            score, y = rows["score"].to_numpy("f8"), rows["label"].to_numpy("f8")[:, None]
            w = _weights(rows, seed, iterations)
            pos, neg = w * y, w * (1 - y)
            add(Steps(score, pos, neg, _before(pos, row_above[0]), _before(neg, row_above[1]), *totals), True)
            row_above = [row_above[0] + pos.sum(0), row_above[1] + neg.sum(0)]
            score, pos, neg = groups.add(score, pos, neg)
            if len(score):
                b_pos, b_neg = _before(pos, above[0]), _before(neg, above[1])
                above = [above[0] + pos.sum(0), above[1] + neg.sum(0)]
                skip = 1 if lead else 0  # a range's first score is among the ends, its last stays open
                lead = False
                if len(score) > skip:
                    add(Steps(score[skip:], pos[skip:], neg[skip:], b_pos[skip:], b_neg[skip:], *totals), False)
    if totals is not None:
        flat = [a for parts in sums for a in parts]
        yield pd.DataFrame({
            "iteration": np.arange(columns) - 1, "sums": list(np.stack(flat, axis=1)) if flat else [[]] * columns, "pos": totals[0], "neg": totals[1],
        })


def curve_samples(df: DataFrame, metrics: list[CurveMetric], iterations: int, seed=42, unit: str = "asset_id",
                  y: str = "label", score: str = "score") -> DataFrame:
    """(iteration, one column per metric) for `iterations` resamples of whole units; iteration -1 is the point value."""
    usable = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counted = usable.groupBy(
        F.col(unit).cast("string").alias("unit"), F.col(score).cast("double").alias("score"), F.col(y).cast("int").alias("label")
    ).agg(F.count("*").alias("n")).withColumn("score", F.col("score") + F.lit(0.0))  # one zero
    order = [F.desc("score"), F.asc("tie"), F.asc_nulls_first("unit"), F.desc("label")]
    placed = counted.withColumn("tie", hash_hex(seed, F.col("unit"))).repartitionByRange(*order).sortWithinPartitions(*order)
    # Range numbers must not change between the passes, so the narrow rows are written once.
    rows = cut_lineage(placed.withColumn("part", F.spark_partition_id()))

    arrays = ", ".join(f"{c} binary" for c in ENDS)
    ends = rows.mapInPandas(
        lambda frames: _range_ends(frames, seed, iterations), f"part int, chunk int, first_score double, last_score double, {arrays}")
    heads = ends.groupBy("chunk").applyInPandas(
        lambda frame: _joined_ends(frame, metrics),
        "part int, chunk int, before_pos binary, before_neg binary, tot_pos binary, tot_neg binary, edge binary")
    led = rows.withColumn("chunk", F.lit(-1)).unionByName(heads, allowMissingColumns=True).repartition("part").sortWithinPartitions(
        "part", F.desc("chunk"), *order)
    n_sums = sum(m.n_sums for m in metrics)
    parts = led.mapInPandas(
        lambda frames: _range_sums(frames, metrics, seed, iterations), "iteration bigint, sums array<double>, pos double, neg double")
    whole = parts.groupBy("iteration").agg(
        F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(n_sums)]).alias("sums"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = np.array(frame["sums"].tolist()).reshape(len(frame), n_sums)
            out, at = {"iteration": frame["iteration"]}, 0
            for m in metrics:
                columns = [sums[:, i] for i in range(at, at + m.n_sums)]
                out[m.name] = m.finish(columns, frame["pos"].to_numpy(), frame["neg"].to_numpy())
                at += m.n_sums
            yield pd.DataFrame(out)

    values = whole.mapInPandas(finish, "iteration bigint, " + ", ".join(f"`{m.name}` double" for m in metrics))
    return values.select("iteration", *[F.nanvl(F.col(f"`{m.name}`"), F.lit(None).cast("double")).alias(m.name) for m in metrics])


def curve_intervals(df: DataFrame, metrics: list[CurveMetric], iterations: int, seed=42, unit: str = "asset_id", ci: float = 0.95) -> DataFrame:
    """Per metric: metric, point, lower, upper, n_valid_iterations, n_unique_units. One row per iteration reaches the percentiles."""
    samples = curve_samples(df, metrics, iterations, seed, unit)
    cells = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(f"`{m.name}`").alias("value")) for m in metrics])
    long = samples.select("iteration", F.explode(cells).alias("c")).select("iteration", "c.*")
    drawn = F.when(F.col("iteration") != POINT, F.col("value"))
    units = df.groupBy(F.col(unit)).agg(F.lit(1).alias("_one")).agg(F.count("*").alias("n_unique_units"))
    out = long.groupBy("metric").agg(
        F.max(F.when(F.col("iteration") == POINT, F.col("value"))).alias("point"),
        F.percentile(drawn, F.lit((1 - ci) / 2)).alias("lower"), F.percentile(drawn, F.lit(1 - (1 - ci) / 2)).alias("upper"),
        F.count(drawn).alias("n_valid_iterations"))
    return out.crossJoin(F.broadcast(units))
