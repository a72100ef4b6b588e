"""Raw table -> normalized records, decided from the header before any job runs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import scalar, timecols
from stagewise.sources.specs import SourceSpec

CORE_COLUMNS = ["timestamp", "asset_id", "peer_id", "raw_attack_type", "binary_label"]


class SchemaError(ValueError):
    pass


def name_key(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def match_column(actual: Iterable[str], candidates: Iterable[str]) -> str | None:
    """First candidate present in the header; the last of several equal header keys wins."""
    by_key = {name_key(c): c for c in actual}
    return next((by_key[name_key(c)] for c in candidates if name_key(c) in by_key), None)


@dataclass
class Normalized:
    """Normalized records, plus everything the header alone decided."""

    records: DataFrame
    raw: DataFrame
    spec: SourceSpec
    matched: dict[str, str | None]
    numeric: list[str]
    categorical: list[str]
    missing: list[str]
    attack_type_source: str
    warnings: list[str] = field(default_factory=list)

    @property
    def has_peer(self) -> bool:
        return self.matched["peer"] is not None


def normalize(raw: DataFrame, spec: SourceSpec, drop_bad_timestamps: bool = True) -> Normalized:
    """Project a raw table to the five core columns plus the declared features it holds.

    `drop_bad_timestamps=False` is for record-level use, which never looks at time.
    """
    header = raw.columns
    matched = {
        role: match_column(header, getattr(spec, role))
        for role in ("timestamp", "asset", "peer", "binary_label", "attack_type")
    }
    for role in ("timestamp", "asset"):
        if matched[role] is None:
            raise SchemaError(f"[{spec.name}] no {role} column: none of {getattr(spec, role)} is in {header}")
    if matched["binary_label"] is None and matched["attack_type"] is None:
        raise SchemaError(f"[{spec.name}] neither a binary label nor an attack type column in {header}")

    dropped = set(spec.drop)
    numeric = [c for c in spec.numeric if c in header and c not in dropped]
    categorical = [c for c in spec.categorical if c in header and c not in dropped]
    missing = sorted(set(spec.numeric + spec.categorical) - set(numeric) - set(categorical) - dropped)

    warnings = []
    if matched["peer"] is None:
        warnings.append("no peer column: the graph keeps temporal edges only")
    if matched["attack_type"] is None:
        warnings.append("no attack type column: stages come from the binary label only")
    if missing:
        warnings.append(f"declared features not in the header: {missing}")

    kinds = dict(raw.dtypes)
    binary, attack = _labels(matched)
    # A whole-number id is missing only when NULL, a test the scan itself can apply.
    whole = kinds[matched["asset"]] in scalar.INTEGRAL
    asset = scalar.quoted(matched["asset"])
    source = raw.filter(asset.isNotNull()) if whole else raw
    projected = source.select(
        spec.timestamp_column(scalar.quoted(matched["timestamp"])).alias("timestamp"),
        (asset.cast("string") if whole else scalar.text_or_nan(asset)).alias("asset_id"),
        (scalar.text_or_nan(scalar.quoted(matched["peer"])) if matched["peer"]
         else F.lit(None).cast("string")).alias("peer_id"),
        attack.alias("raw_attack_type"),
        binary.alias("binary_label"),
        *([scalar.quoted(spec.record_id).try_cast("bigint").alias("record_id")] if spec.record_id in header else []),
        *[scalar.as_double(scalar.quoted(c), kinds[c]).alias(c) for c in numeric],
        *[scalar.text_or_nan(scalar.quoted(c)).alias(c) for c in categorical],
    )
    usable = F.lit(True) if whole else ~scalar.is_missing_text(F.col("asset_id"))
    if drop_bad_timestamps:
        usable = F.col("timestamp").isNotNull() & usable
    return Normalized(
        records=projected.filter(usable), raw=raw, spec=spec, matched=matched, numeric=numeric,
        categorical=categorical, missing=missing, warnings=warnings,
        attack_type_source="column" if matched["attack_type"] else "binary_label_fallback",
    )


def _labels(matched: dict[str, str | None]) -> tuple[Column, Column]:
    """(binary label, attack text), each derived from the other where it is absent."""
    binary = attack = None
    if matched["binary_label"]:
        parsed = scalar.lenient_double(scalar.quoted(matched["binary_label"]))
        # Any label other than zero counts, however large: out of range becomes the nearest end of it.
        binary = F.greatest(F.least(F.coalesce(parsed, F.lit(0.0)), F.lit(float(2**31 - 1))), F.lit(float(-(2**31)))).cast("int")
    if matched["attack_type"]:
        attack = F.trim(scalar.text_or_nan(scalar.quoted(matched["attack_type"])))
    else:
        attack = F.when(binary == 0, "normal").otherwise("unknown_attack")
    if binary is None:
        binary = (~F.lower(F.trim(attack)).isin(scalar.BENIGN_TEXTS)).cast("int")
    return binary, attack


def quality(n: Normalized, min_assets: int = 5, min_date_frac: float = 0.95) -> DataFrame:
    """One row: volume, parse rates, and whether windowing and forecasting are allowed.

    The raw table is read once. Distinct assets are counted on the kept rows.
    """
    ts = scalar.quoted(n.matched["timestamp"])
    parsed = n.spec.timestamp_column(ts)
    asset = scalar.text_or_nan(scalar.quoted(n.matched["asset"]))
    kept = parsed.isNotNull() & ~scalar.is_missing_text(asset)
    dated = timecols.has_calendar_date(ts) if n.spec.date_gated else F.lit(True)
    row = n.raw.select(
        parsed.isNotNull().alias("parsed"), kept.alias("kept"), dated.alias("dated"),
        F.when(kept, asset).alias("asset"),
    ).agg(
        F.count("*").alias("n_rows_raw"),
        F.coalesce(F.sum(F.col("kept").cast("bigint")), F.lit(0)).alias("n_rows_kept"),
        F.countDistinct("asset").alias("n_distinct_assets"),
        F.coalesce(F.avg(F.col("parsed").cast("double")), F.lit(0.0)).alias("timestamp_parseable_frac"),
        F.coalesce(F.avg(F.col("dated").cast("double")), F.lit(0.0)).alias("timestamp_calendar_date_frac"),
    )
    reliable = F.col("timestamp_calendar_date_frac") >= min_date_frac
    reasons = F.array_compact(F.array(
        F.when(F.col("n_distinct_assets") < min_assets,
               F.concat(F.lit("too few distinct assets: "), F.col("n_distinct_assets").cast("string"))),
        F.when(~reliable, F.lit("too few rows with a genuine calendar date")),
        F.lit(None if n.has_peer else "no peer column").cast("string"),
    ))
    return row.select(
        "*",
        F.lit(n.has_peer).alias("has_peer_id"),
        F.lit(n.attack_type_source).alias("attack_type_source"),
        reliable.alias("timestamp_reliable_for_windowing"),
        reliable.alias("window_sensitivity_valid"),
        (F.size(reasons) == 0).alias("impact_forecasting_valid"),
        reasons.alias("impact_forecasting_invalid_reasons"),
        *[check(n).alias(name) for name, check in n.spec.quality_checks.items()],
    )


def matched_columns(n: Normalized) -> DataFrame:
    """Audit trail of the schema match as rows (role, column)."""
    spark = n.raw.sparkSession
    rows = [(role, column) for role, column in n.matched.items()]
    return spark.createDataFrame(rows, "role string, column string")
