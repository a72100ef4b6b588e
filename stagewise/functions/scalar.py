"""Scalar Column helpers: text keys, lenient parsing, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value" in an identifier column.
MISSING_TEXTS = ["nan", "none", ""]

INTEGRAL = ("tinyint", "smallint", "int", "bigint")

NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))$"

# Attack texts that mean "benign" when no binary label exists.
BENIGN_TEXTS = ["normal", "benign"]


def quoted(name: str) -> Column:
    """Column by literal name; names such as ``ip.src_host`` hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def match_key(c: Column) -> Column:
    """Lower-cased text reduced to ``[a-z0-9]``, the form labels are compared in."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def lenient_double(c: Column) -> Column:
    """Decimal number or NULL, never an error. NaN counts as NULL, and so do texts like `1d` or `0x1p3` that Java reads as numbers."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def as_double(c: Column, kind: str) -> Column:
    """Numeric value of a column of the given Spark type; only text has to be parsed."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("double"))
    if kind in INTEGRAL or kind.startswith("decimal"):
        return c.cast("double")
    return lenient_double(c)


def text_or_nan(c: Column) -> Column:
    """Text form of a column in which a missing value is the literal ``nan``."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def is_missing_text(c: Column) -> Column:
    return F.lower(c).isin(MISSING_TEXTS)


def ratio(num: Column, den: Column) -> Column:
    """num/den with 0 for an empty denominator (the `zero_division=0` rule)."""
    return F.coalesce(num / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def bounded(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def hash_hex(seed, *parts: Column) -> Column:
    """Seeded uniform 32-digit hex key; the only source of randomness in plans."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_index(hex_key: Column, n: Column) -> Column:
    """Uniform integer in [0, n) from the first 15 hex digits (60 bits)."""
    return F.pmod(F.conv(F.substring(hex_key, 1, 15), 16, 10).cast("bigint"), n)


def hash_unit(hex_key: Column) -> Column:
    """Uniform double in [0, 1) from the first 8 hex digits."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
