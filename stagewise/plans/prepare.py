"""From a raw table to everything downstream reads: records, instances, split, graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.operators import graph, labels, splits, windows
from stagewise.operators.features import FeatureEncoder
from stagewise.session import cut_lineage, keep
from stagewise.settings import Settings
from stagewise.sources.label_maps import LABEL_MAPS
from stagewise.sources.normalize import Normalized, normalize, quality
from stagewise.sources.specs import SourceSpec


@dataclass
class Prepared:
    """Plans over one source. Only `cut` and `fit_features` run a job, each for a few parameters.

    `record_level=True` treats every record as its own instance, for sources whose time
    cannot be trusted (see `quality_row`). Records whose time cannot be read go either way,
    unless `drop_bad_timestamps=False`; then there are no temporal edges and
    interactions connect the first record of each asset.
    """

    raw: DataFrame
    spec: SourceSpec
    settings: Settings
    variant: str = "primary"
    record_level: bool = False
    drop_bad_timestamps: bool = True

    @cached_property
    def normalized(self) -> Normalized:
        return normalize(self.raw, self.spec, drop_bad_timestamps=self.drop_bad_timestamps)

    @property
    def numeric(self) -> list[str]:
        return self.normalized.numeric

    @property
    def categorical(self) -> list[str]:
        return self.normalized.categorical

    def quality(self) -> DataFrame:
        return quality(self.normalized, self.settings.min_distinct_assets, self.settings.min_calendar_date_frac)

    @cached_property
    def labelled(self) -> DataFrame:
        mapped = labels.map_labels(self.normalized.records, LABEL_MAPS[self.spec.name][self.variant])
        if self.record_level and "record_id" not in mapped.columns:
            # Row ids depend on the scan: written once, so nodes, edges and instances agree on them.
            return cut_lineage(mapped.withColumn("record_id", F.monotonically_increasing_id()))
        return mapped

    @cached_property
    def records(self) -> DataFrame:
        """Labelled records with their window."""
        if self.record_level:
            return self.labelled.withColumn("window_id", F.col("record_id"))
        return windows.with_window(self.labelled, self.settings.delta_t_seconds)

    @cached_property
    def cut(self) -> splits.SplitCut:
        return splits.split_cut(self.records if self.record_level else self.labels, self.settings)

    def with_split(self, df: DataFrame) -> DataFrame:
        return splits.attach_split(df, self.cut)

    @cached_property
    def instances(self) -> DataFrame:
        if self.record_level:
            return windows.record_level_instances(self.labelled, self.numeric, self.categorical)
        return windows.instances(self.records, self.numeric, self.categorical)

    @cached_property
    def labels(self) -> DataFrame:
        """(asset, window, severity, stage): the narrow view that split, sequences and edges all read."""
        return keep(windows.window_labels(self.records))

    @cached_property
    def nodes(self) -> DataFrame:
        if self.record_level:
            return self.records.select("asset_id", "window_id")
        return self.labels.select("asset_id", "window_id")

    @cached_property
    def interactions(self) -> DataFrame:
        return windows.interactions(self.records)

    @cached_property
    def edges(self) -> DataFrame:
        if self.record_level:
            return graph.representative_edges(self.interactions, self.nodes)
        return graph.build_edges(self.interactions, self.nodes)

    def fit_features(self, instance_rows: DataFrame) -> FeatureEncoder:
        """Encoder fitted on the train rows of a (split-carrying) instance table."""
        numeric, categorical = windows.feature_columns(instance_rows.columns)
        return FeatureEncoder(numeric, categorical).fit(instance_rows.filter("split = 'train'"))


def choose_path(raw: DataFrame, spec: SourceSpec, settings: Settings, variant: str = "primary", drop_bad_timestamps: bool = True) -> Prepared:
    """Windowed instances where time is reliable, else record-level ones (one small job decides).

    Records whose time cannot be read at all go on either path, unless asked otherwise. A time without a date can be read.
    """
    windowed = Prepared(raw, spec, settings, variant)
    if spec.date_gated and not windowed.quality().first().timestamp_reliable_for_windowing:
        return Prepared(raw, spec, settings, variant, record_level=True, drop_bad_timestamps=drop_bad_timestamps)
    return windowed
