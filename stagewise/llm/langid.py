"""Language identification by multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three letters of the lower-cased text, words set apart by single spaces;
everything that is no letter counts as a space. Document frequencies cover all labelled documents that may be learned
from. The model is trained on a bounded sample of them by follow-the-regularised-leader with elastic-net penalties:
every epoch, shards go on from the common state on their own and their states are averaged. Its scores are then
calibrated by one temperature, fitted to the part of the sample that was kept out of training.

Text NULL or without a letter: `und`, score 0. Rows without a label, without a doc_id or held out are never learned
from. With nothing to learn from, everything is `und`. Repeated rows and ties get equal answers; ties in score go to
the first label by code point. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import stored

BUCKETS = 1 << 16
ORDERS = 3
SAMPLE_PER_LABEL = 1200  # expected rows of each label that the model is fitted on
CALIBRATION_SHARE = 5  # one in so many rows of the sample is for the temperature
SHARDS = 6
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
MIN_SCORE = 0.5
UNKNOWN = "und"
FOLDS = 5


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # labels x (buckets + 1); the last column is the bias
    temperature: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out: crc32 of its id as text leaves no remainder by five. NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("bigint").cast("string")) % FOLDS == 0


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    line = np.where(letter, codes, np.uint32(32))[keep]
    line = np.concatenate([np.array([32], np.uint32), line, np.array([32] * bool(letter[-1]), np.uint32)])
    counts, mixed = np.zeros(BUCKETS, np.int64), line
    for order in range(1, ORDERS + 1):
        if order > 1:
            if len(line) < order:
                break
            mixed = mixed[:-1] * np.uint32(0x01000193) ^ line[order - 1:]
        counts += np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(16), minlength=BUCKETS)
    return counts


def _features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return np.append(at, BUCKETS), np.append(values / max(np.sqrt(values @ values), 1e-12), 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _closed_form(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights that the leader has for the state (z, n) under both penalties."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of FTRL-proximal over (label, feature numbers, values); gives the new state."""
    z, n = z.copy(), n.copy()
    for label, at, x in rows:
        zs, ns = z[:, at], n[:, at]
        w = _closed_form(zs, ns)
        p = _softmax(w @ x)
        p[label] -= 1
        g = np.outer(p, x)
        grown = ns + g * g
        z[:, at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
        n[:, at] = grown
    return z, n


def _document_frequencies(learnable: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    df += counts > 0
                    docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS), pa.int32()), pa.array(np.append(df[at], docs), pa.int64())], ["bucket", "n"])

    found = learnable.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Train on the documents that are labelled and not held out; None if there are none."""
    learnable = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    sizes = {r.lang: r.n for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    labels = tuple(sorted(sizes))
    df, n_docs = _document_frequencies(learnable)
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    # A share of each label's documents by their hash: copies and sources are drawn as often as they occur.
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[x for lang in labels for x in (F.lit(lang), F.lit(int(min(1.0, per_label / sizes[lang]) * (1 << 30))))])
    sample = learnable.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")])
    index = {lang: i for i, lang in enumerate(labels)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang, draw in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("draw").to_pylist()):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    at, x = _features(counts, idf)
                    rows.append((draw, index[lang], at.astype(np.int32), x.astype(np.float32)))
            kinds = [("draw", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])

    vectorized = sample.mapInArrow(vectors, "draw bigint, label int, at array<int>, x array<float>")
    part = F.xxhash64("draw")
    drawn = stored(vectorized.withColumn("shard", F.when(F.pmod(part, F.lit(CALIBRATION_SHARE)) == 0, -1).otherwise(F.pmod(F.shiftright(part, 8), F.lit(SHARDS)))), "language-sample")
    shape = (len(labels), BUCKETS + 1)
    z, n = np.zeros(shape), np.zeros(shape)
    for _ in range(EPOCHS):
        state = (z.astype(np.float32), n.astype(np.float32))

        def epoch(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["draw", "label"])
            new = ftrl(zip(frame["label"], frame["at"], frame["x"]), state[0].astype(float), state[1].astype(float))
            return pd.DataFrame({"z": [new[0].astype(np.float32).tobytes()], "n": [new[1].astype(np.float32).tobytes()]})

        shards = drawn.filter("shard >= 0").groupBy("shard").applyInPandas(epoch, "z binary, n binary").collect()  # SHARDS states at most
        if shards:
            z, n = (np.mean([np.frombuffer(s[k], np.float32).reshape(shape) for s in shards], axis=0, dtype=float) for k in ("z", "n"))
    weights = _closed_form(z, n)

    def logits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "z": [(weights[:, at] @ x).tolist() for at, x in zip(frame["at"], frame["x"])]})

    kept = drawn.filter("shard < 0").mapInPandas(logits, "label int, z array<double>").toPandas()  # a share of the bounded sample
    return Model(labels, idf, weights.astype(np.float32), _temperature(kept["label"].to_numpy(), np.array(kept["z"].tolist())))


def _temperature(label: np.ndarray, z: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(z / np.exp(t))[np.arange(len(label)), label], 1e-12)).mean())

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score. Only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                counts = ngram_counts(text.as_py()) if model else None
                if counts is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = _features(counts, model.idf)
                p = _softmax(model.weights[:, at] @ x / model.temperature)
                names.append(model.labels[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs` whose text has a language with at least `min_score`; all columns as they are."""
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in batch.column(columns.index("text")):
                counts = ngram_counts(text.as_py()) if model else None
                if counts is None:
                    good.append(False)
                    continue
                at, x = _features(counts, model.idf)
                good.append(float(_softmax(model.weights[:, at] @ x / model.temperature).max()) >= min_score)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)
