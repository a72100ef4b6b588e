"""Fill-in-the-middle by ranks in a wavelet matrix of character classes.

A text is cut into prefix, middle and suffix at boundaries of units: code points, words or lines. Every byte has a class: inside
a code point, or the first byte of a code point that starts neither word nor line, a word, a line, or both. A wavelet matrix of
these classes answers how often a class occurs before a byte; the ranks of the classes that start a unit add up to the number of
units that have begun, and bisection on it finds where a number of units ends. One matrix holds a block of documents, and all
documents of the block are counted and bisected at once; a longer text has a matrix of its own.

A text stays plain if it is empty or NULL, holds one of the marks, or is drawn to; draws come from sha256 of seed and doc_id, so
rows that repeat a doc_id are cut alike (by their own lengths) and a NULL doc_id counts as an empty one. Without marks inside,
prefix, middle and suffix are read back from the output exactly (`restored`). Text is cut between bytes that start a code point,
whatever the bytes are. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN_FROM = 90  # of 100: draws from here on stay plain
SPM_BELOW = 20  # of 100: draws below put the suffix first
MARKS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
SEED = "1"
BLOCK_BYTES = 1 << 23  # bytes of text under one matrix, a longer text alone

STARTS = {"char": (1, 2, 3, 4), "word": (2, 4), "line": (3, 4)}  # classes of bytes that start a unit
LEVELS = 3


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte; `starts` are the first bytes of texts that are not empty."""
    lead = (data & 0xC0) != 0x80
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    before = np.empty(len(data), bool)
    after_line = np.empty(len(data), bool)
    before[1:], after_line[1:] = blank[:-1], data[:-1] == 10
    before[starts] = after_line[starts] = True
    return lead * (1 + (before & ~blank) + 2 * after_line.astype(np.uint8)).astype(np.uint8)


class WaveletMatrix:
    """Ranks of small numbers: `rank(c, at)` counts c among the first `at` symbols, for many places at once."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels = levels
        self.words, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
            padded[:len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.before.append(counts)
            self.zeros.append(len(bits) - int(counts[-1]))
            ones = bits.astype(bool)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & below).astype(np.int64)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level in range(self.levels):
            if symbol >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + self._ones(level, low), self.zeros[level] + self._ones(level, high)
            else:
                low, high = low - self._ones(level, low), high - self._ones(level, high)
        return high - low


def begun(matrix: WaveletMatrix, unit: str, at: np.ndarray) -> np.ndarray:
    """Units that begin before each place."""
    return sum(matrix.rank(c, at) for c in STARTS[unit])


def cut(matrix: WaveletMatrix, unit: str, first: np.ndarray, last: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Where each text, bytes first to last, has `units` units behind it: before the next unit's first byte, or at its end."""
    limit = begun(matrix, unit, first) + units
    low, high = first.copy(), last.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fits = begun(matrix, unit, middle) <= limit
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return np.where(units <= 0, first, low)


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts fill a block."""
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > BLOCK_BYTES:
            yield at, i
            at, held = i, 0
        held += n
    yield at, len(lengths)


def draws(doc_id: str = "doc_id", seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the hex digits of sha256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, unit: str = "char", seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (NULL if plain), output."""
    if unit not in STARTS:
        raise ValueError(f"unit must be one of {sorted(STARTS)}")
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            for a, b in _blocks(lengths):
                if a == b:
                    continue
                data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                last = np.cumsum(lengths[a:b])
                first = last - lengths[a:b]
                matrix = WaveletMatrix(classes(data, first[lengths[a:b] > 0]))
                n = begun(matrix, unit, last) - begun(matrix, unit, first)
                drawn = [batch.column(c).to_numpy(zero_copy_only=False)[a:b] % (n + 1) for c in ("h1", "h2")]
                units = [np.minimum(*drawn), np.maximum(*drawn)]
                cuts = [(cut(matrix, unit, first, last, u) - first).tolist() for u in units]
                forms, out = batch.column("form").slice(a, b - a), []
                for text, form, x, y in zip(texts[a:b], forms.to_pylist(), *cuts):
                    if form == "plain":
                        out.append(text)
                    elif form == "psm":
                        out.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
                    else:
                        out.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                plain = np.array(forms) == "plain"
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(n), forms, pa.array(units[0], mask=plain), pa.array(units[1] - units[0], mask=plain), pa.array(out, pa.binary()),
                ], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws("doc_id", seed)
    plain = (text == "") | (h3 % 100 >= plain_from)
    for mark in marks:
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    found = rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output: the marks occur once each, in the order of the form."""
    p, s, m = marks
    body = {"psm": F.substr(output, F.lit(len(p) + 1)), "spm": F.substr(output, F.lit(len(s) + 1))}
    between = {"psm": s, "spm": p}

    def parts(kind: str) -> tuple[Column, Column, Column]:
        def quoted(x: str) -> str:
            return "\\Q" + x + "\\E"

        halves = F.split(body[kind], quoted(between[kind]), 2)
        rest = F.split(halves[1], quoted(m), 2)
        return halves[0], rest[0], rest[1]

    a, b, c = parts("psm")
    x, y, z = parts("spm")
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(y, z, x)).otherwise(output)
