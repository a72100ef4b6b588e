"""Quality rules by distribution divergence.

The characters of a document, as classes, and its common words are two histograms. Each is compared with references
of every language by the Jensen-Shannon distance; the nearest reference counts, so wrong or missing labels do no harm.
A document fails if a distance exceeds its limit. Limits are wider for short documents, whose histograms are noisy, and
below a minimum length a histogram is not judged at all.

References cover all documents that pass the base rules. Common words are those with at least a given share of a
language's words. A word that frequent overall is that frequent in some part of the table, so each task names its own
frequent words; these are counted in all documents, and the share is applied to those counts. So how rows are dealt to
tasks changes nothing. Candidates are at most 1 / share for each task's part of a language, common words 1 / share a language.

A language of very few words has no reference. If its documents fit no other, divergence leaves them unjudged, as nothing
tells what they ought to be like. A document without a language is judged by all references.

NULL or empty text: no words, fails the base rules. Repeated rows get equal answers. Rows without a language take part
in no reference. With no reference at all, base rules alone decide. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import stored

MIN_WORDS, MOST_REPEATED = 50, 50  # base rules: least words; percent of words in repeated windows
SHARE = 0.002  # of a language's words that makes a word common
TOP = 100  # common words in a reference
LEAST_WORDS = 2000  # of a language from which on it has a reference, whatever the others hold
CLASS_LIMIT, CLASS_NOISE, CLASS_CHARS = 0.24, 1.5, 200
WORD_LIMIT, WORD_NOISE, WORD_WORDS = 0.45, 1.5, 100

SYMBOLS = b"#*$%&|<>"  # fixed value of the contract
SPACES = b" \t\n\x0b\x0c\r"
MARKS = b".,;:!?'\"()-"
LOWER, UPPER, DIGIT, SPACE, MARK, SYMBOL, OTHER, BEYOND, INSIDE = range(9)


def _classes() -> np.ndarray:
    """Class of each byte of a UTF-8 text; BEYOND begins a character outside ASCII, INSIDE goes on with one."""
    of = np.full(256, OTHER, np.uint8)
    of[97:123], of[65:91], of[48:58], of[128:192], of[192:] = LOWER, UPPER, DIGIT, INSIDE, BEYOND
    of[list(SPACES)], of[list(MARKS)], of[list(SYMBOLS)] = SPACE, MARK, SYMBOL
    return of


CLASSES = _classes()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) < 2_000_000:
        windows = (at[:-2] * len(numbers) + at[1:-1]) * len(numbers) + at[2:]
    else:  # products would not fit into 63 bits
        pairs = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(numbers) + at[2:]
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:len(words) - 2 + shift] |= twice
    return int(covered.sum())


def base(data: bytes | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts by class of a UTF-8 text."""
    data = data or b""
    words = data.split()  # bytes: at ASCII white space only
    classes = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=9)
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = int(classes.sum() - classes[INSIDE] - classes[SPACE])
    return len(words), chars, int(classes[SYMBOL]), len(lines) - len(set(lines)), repeated_words(words), classes[:INSIDE]


def plain_words(data: bytes) -> list[bytes]:
    """Words in lower case without punctuation."""
    return data.lower().translate(None, MARKS).split()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.col("text").cast("binary").alias("text"))


def candidate_words(docs: DataFrame, share: float = SHARE, least: int = LEAST_WORDS) -> list[bytes]:
    """Words with at least the share in some task's part of a language: all common words are among them."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang is not None and (data := text.as_py()):
                    held.setdefault(lang, Counter()).update(plain_words(data))
            if sum(map(len, held.values())) > 2_000_000:  # a task may pass on its counts in parts
                yield _frequent(held, share)
                held = {}
        yield _frequent(held, share)

    found = _rows(docs).mapInArrow(frequent, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = stored(found, "frequent-words")
    totals = found.filter("word IS NULL").select("lang", F.col("n").alias("total"))
    kept = found.filter("word IS NOT NULL").join(totals.filter(F.col("total") >= least), "lang")
    return sorted(bytes(r.word) for r in kept.select("word").distinct().collect())


def _frequent(held: dict[str, Counter], share: float) -> pa.RecordBatch:
    rows = []
    for lang, counts in held.items():
        total = counts.total()
        rows.append((lang, None, total))
        rows += [(lang, w, n) for w, n in counts.items() if n >= share * total]
    kinds = [("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [k for k, _ in kinds])


def common_words(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """Numbers (at) of the candidates with at least the share of some language's words, by their counts in all documents."""
    own = rows.filter("lang IS NOT NULL")
    totals = own.groupBy("lang").agg(F.sum(F.col("rest") + F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))
    counted = own.select("lang", F.explode(F.arrays_zip("at", "n")).alias("e")).groupBy("lang", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n"))
    return counted.join(F.broadcast(totals), "lang").filter(F.col("n") >= share * F.col("total")).select("at").distinct()


def measured(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """Per document: base counts, counts by character class, and counts of candidates for common words as two lists."""
    number = {w: i for i, w in enumerate(words)}
    kinds = [
        ("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("classes", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("rest", pa.int64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = text.as_py() or b""
                *counts, classes = base(data)
                plain = plain_words(data)
                numbers = np.fromiter((number.get(w, -1) for w in plain), np.int64, len(plain))
                held = np.bincount(numbers[numbers >= 0], minlength=1)
                at = np.flatnonzero(held)
                rows.append((*counts, classes, at, held[at], int((numbers < 0).sum())))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds[2:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *columns], [k for k, _ in kinds])

    return _rows(docs).mapInArrow(
        run, "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "classes array<bigint>, at array<int>, n array<int>, rest bigint"
    )


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def references(rows: DataFrame, top: int = TOP, least: int = LEAST_WORDS) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Per language: name, histogram of classes, numbers of its commonest words, and their histogram with the rest last."""
    good = rows.filter("lang IS NOT NULL").filter(~_base_failed())
    sums = good.groupBy("lang").agg(
        F.sum("n_words").alias("words"), F.sum("rest").alias("rest"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(INSIDE)]
    )
    sums = sums.filter(F.col("words") >= least)
    counted = good.select("lang", F.explode(F.arrays_zip("at", "n")).alias("e")).groupBy("lang", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "at"))
    counted = counted.withColumn("all", F.sum("n").over(Window.partitionBy("lang"))).join(F.broadcast(common_words(rows)), "at", "left_semi")
    ranked = counted.withColumn("rank", rank).filter(F.col("rank") <= top)
    tops = {}
    for r in ranked.join(sums.select("lang"), "lang").collect():  # at most `top` words for each language
        tops.setdefault(r.lang, []).append((r.at, r.n, r["all"]))
    out = []
    for r in sorted(sums.collect(), key=lambda r: r.lang):
        held = tops.get(r.lang, [])
        at, n = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], float)
        rest = r.rest + (held[0][2] - n.sum() if held else 0)
        classes, hist = np.array([r[f"c{i}"] for i in range(INSIDE)], float), np.append(n, rest)
        out.append((r.lang, classes / max(classes.sum(), 1), at, hist / max(hist.sum(), 1)))
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, in 0..1, of each row of p to the histogram q."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def judged(rows: DataFrame, refs: list) -> DataFrame:
    """Verdicts and distances: base_failed, kept, class_distance, word_distance (NULL where not judged)."""
    known = {lang for lang, *_ in refs}
    most = 1 + max((int(at.max()) for _, _, at, _ in refs if len(at)), default=0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = len(frame)
            row = np.repeat(np.arange(n), frame["at"].map(len).to_numpy(int))
            flat_at = np.concatenate([np.zeros(0, np.int64), *frame["at"]]).astype(np.int64)
            flat_n = np.concatenate([np.zeros(0), *frame["n"]])
            chars = frame["word_chars"].to_numpy(float)
            classes = np.array(frame["classes"].tolist(), float).reshape(n, INSIDE)
            classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
            words = frame["n_words"].to_numpy(float)
            by_class, by_word = np.full(n, np.inf), np.full(n, np.inf)
            for _, ref_classes, at, hist in refs:
                by_class = np.minimum(by_class, jensen_shannon(classes, ref_classes))
                place = np.full(most + 1, len(hist) - 1)  # words without a place of their own are the rest
                place[at] = np.arange(len(at))
                cell = row * len(hist) + place[np.minimum(flat_at, most)]
                own = np.bincount(cell, flat_n, n * len(hist)).reshape(n, len(hist)).astype(float)
                own[:, -1] += frame["rest"].to_numpy(float)
                own /= np.maximum(own.sum(axis=1, keepdims=True), 1)
                by_word = np.minimum(by_word, jensen_shannon(own, hist))
            by_class[(chars < CLASS_CHARS) | ~np.isfinite(by_class)] = np.nan
            by_word[(words < WORD_WORDS) | ~np.isfinite(by_word)] = np.nan
            failed = (words < MIN_WORDS) | (100 * frame["n_repeat_words"].to_numpy() > MOST_REPEATED * words)
            bad = (by_class > CLASS_LIMIT + CLASS_NOISE / np.sqrt(np.maximum(chars, 1))) | (by_word > WORD_LIMIT + WORD_NOISE / np.sqrt(np.maximum(words, 1)))
            unknown = bad & np.array([lang is not None and lang == lang and lang not in known for lang in frame["lang"]], bool)
            bad &= ~unknown
            by_class[unknown] = by_word[unknown] = np.nan
            yield frame[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].assign(
                doc_id=frame["doc_id"].astype("Int64"), base_failed=failed, kept=~failed & ~bad, class_distance=by_class, word_distance=by_word
            )

    return rows.mapInPandas(
        run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, class_distance double, word_distance double"
    )


def quality(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept and both distances."""
    rows = stored(measured(docs, candidate_words(docs)), "measured")
    return judged(rows, references(rows))
