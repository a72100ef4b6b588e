"""Time Columns. All arithmetic is on TIMESTAMP_NTZ, so no session zone takes part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stagewise.functions.scalar import lenient_double

# Accepted spellings of a timestamp text, most specific first.
TIMESTAMP_FORMATS = [
    "MMM d, yyyy HH:mm:ss.SSSSSSSSS",
    "MMM d, yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "M/d/yyyy HH:mm:ss",
    "yyyy HH:mm:ss.SSSSSSSSS",
    "yyyy HH:mm:ss",
]

# What counts as a genuine calendar date inside a text.
MONTH_PATTERN = "(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
NUMERIC_DATE_PATTERN = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"


def epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch_ntz(), ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, epoch_ntz())


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds, rounded towards minus infinity."""
    us = epoch_micros(ts)
    return F.floor((us - F.pmod(us, F.lit(1_000_000))) / F.lit(1e6))


def window_id(ts: Column, delta_t_seconds: float | Column) -> Column:
    """Global tumbling bucket floor(epoch seconds / width); half-open, width may be fractional."""
    width = delta_t_seconds if isinstance(delta_t_seconds, Column) else F.lit(float(delta_t_seconds))
    return F.floor(epoch_seconds(ts) / width.cast("double")).cast("bigint")


def from_epoch_text(c: Column) -> Column:
    """Epoch seconds (text or number, fractions allowed) to TIMESTAMP_NTZ, else NULL."""
    seconds = lenient_double(c)
    sane = F.abs(seconds) < F.lit(9.2e12)
    return F.when(sane, from_micros(F.round(seconds * F.lit(1e6)).cast("bigint")))


def from_free_text(c: Column, formats: list[str] | None = None) -> Column:
    """First format that parses wins; NULL if none does.

    The text is parsed with an explicit +0000 offset and carried over as
    microseconds, so daylight-saving gaps of the session zone cannot move it.
    """
    text = F.concat(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), F.lit(" +0000"))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f + " xx")) for f in (formats or TIMESTAMP_FORMATS)])
    return from_micros(F.unix_micros(parsed))


def has_calendar_date(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return text.rlike(MONTH_PATTERN) | text.rlike(NUMERIC_DATE_PATTERN)
