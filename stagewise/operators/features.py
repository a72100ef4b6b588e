"""Feature encoding fitted on train rows only, applied as a plain projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.scalar import quoted
from stagewise.session import cut_lineage

ACCURACY = 10_000
BROADCAST_VALUES = 100_000  # categories of a column up to which their numbers are broadcast; beyond, they are joined like any table


class NotFitted(RuntimeError):
    pass


def _long(df: DataFrame, columns: list[str], value) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), value(i, quoted(c)).alias("value"))
                      for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median): exact, without gathering a column in one task.

    A sketch first brackets each median between two values. Then everything below the
    bracket falls onto one key and everything above onto another, so only the sliver
    inside it is told apart by value.
    """
    slack = 5 / ACCURACY
    bands = df.agg(*[
        F.percentile_approx(quoted(c), [0.5 - slack, 0.5 + slack], ACCURACY).alias(f"_b{i}")
        for i, c in enumerate(columns)
    ])
    squeezed = _long(
        df.crossJoin(F.broadcast(bands)), columns,
        # A missing value stays missing: least() alone would turn it into the upper bound.
        lambda i, x: F.when(x < F.col(f"_b{i}")[0], F.lit(float("-inf"))).when(
            x.isNotNull(), F.least(x.cast("double"), F.col(f"_b{i}")[1].cast("double"))),
    ).filter(F.col("value").isNotNull())
    counted = squeezed.groupBy("feature", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("feature")
    upto = F.sum("n").over(w.orderBy("value"))
    ranked = counted.select("feature", "value", upto.alias("upto"), "n", F.sum("n").over(w).alias("total"))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("value")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return ranked.groupBy("feature").agg(((at(low) + at(high)) / 2).alias("median"))


def numeric_params(train: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, name, median, mean, std) after imputation; std is the population deviation, 1 if zero.

    Mean and deviation of the imputed column follow from those of the present values and
    the mass sitting at the median, so the data is not scanned again after imputing.
    A column without any value has NULL parameters and is left out by the encoder.
    """
    stats = train.agg(F.count("*").alias("_rows"), *[
        e for i, c in enumerate(columns) for e in (
            F.count(quoted(c)).alias(f"_n{i}"), F.avg(quoted(c)).alias(f"_m{i}"), F.var_pop(quoted(c)).alias(f"_v{i}"))
    ])
    rows = F.array(*[
        F.struct(F.lit(i).alias("feature"), F.lit(c).alias("name"), F.col(f"_n{i}").alias("n"),
                 F.col(f"_m{i}").alias("m"), F.col(f"_v{i}").alias("v"))
        for i, c in enumerate(columns)
    ])
    long = stats.select("_rows", F.explode(rows).alias("r")).select("_rows", "r.*")
    share = F.col("n") / F.nullif(F.col("_rows").cast("double"), F.lit(0.0))
    mean = share * F.col("m") + (1 - share) * F.col("median")
    spread = share * (F.col("v") + F.pow(F.col("m") - mean, 2)) + (1 - share) * F.pow(F.col("median") - mean, 2)
    return long.join(F.broadcast(exact_medians(train, columns)), "feature", "left").select(
        "feature", "name", "median", mean.alias("mean"),
        F.when(spread <= 1e-24, F.lit(1.0)).otherwise(F.sqrt(spread)).alias("std"),
    )


def category_counts(train: DataFrame, columns: list[str]) -> DataFrame:
    """(name, text, n) of every categorical value in train."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), quoted(c).alias("text")) for c in columns])
    return train.select(F.explode(cells).alias("cell")).select("cell.*").filter(
        F.col("text").isNotNull()).groupBy("name", "text").agg(F.count("*").alias("n"))


def category_modes(counts: DataFrame) -> DataFrame:
    """(name, mode): most frequent value, the smallest on a tie."""
    return counts.groupBy("name").agg(
        F.min(F.struct(-F.col("n"), F.col("text"))).getField("text").alias("mode")
    )


def numbered(counts: DataFrame) -> DataFrame:
    """(name, text, number): the values of each column numbered from 0 in text order.

    Values are range-partitioned by column and text; a number is the place inside the range plus what the ranges before it hold,
    so a column of any size is numbered by as many tasks as it has ranges.
    """
    ranged = cut_lineage(counts.select("name", "text").repartitionByRange("name", "text").withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy("name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("name", "_range").agg(F.count("*").alias("_n"))
    before = sizes.select("name", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("name", "_range").orderBy("text")
    placed = ranged.join(F.broadcast(before), ["name", "_range"])  # a row for each column and range
    return placed.select("name", "text", (F.col("_before") + F.row_number().over(inside) - 1).alias("number"))


@dataclass
class FeatureEncoder:
    """Median imputation, scaling and one-hot encoding with parameters from train rows.

    The parameters of a numeric column, and mode and size of a categorical one, are a few numbers and live here. The categories
    are a table (name, text, number): a row's categories get their numbers by joins, and the row becomes one sparse vector.
    """

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    values: DataFrame | None = None
    n_rows_seen: int | None = None

    def fit(self, train: DataFrame) -> "FeatureEncoder":
        self.n_rows_seen = train.count()
        for r in numeric_params(train, self.numeric).collect() if self.numeric else []:
            if r.median is not None:
                self.medians[r.name] = r.median
                self.scales[r.name] = (r.mean, r.std)
        if self.categorical:
            counts = cut_lineage(category_counts(train, self.categorical))
            self.values = cut_lineage(numbered(counts))
            for r in category_modes(counts).join(counts.groupBy("name").agg(F.count("*").alias("size")), "name").collect():  # a row per column
                self.modes[r["name"]], self.sizes[r["name"]] = r["mode"], r["size"]
        return self

    def _require_fit(self):
        if self.n_rows_seen is None:
            raise NotFitted("fit() on train rows must come before transform()")

    def _used(self) -> tuple[list[str], list[str]]:
        """Columns that have parameters: one without a value in train has none and gives no feature."""
        self._require_fit()
        return [c for c in self.numeric if c in self.scales], [c for c in self.categorical if c in self.sizes]

    @property
    def width(self) -> int:
        numeric, categorical = self._used()
        return len(numeric) + sum(self.sizes[c] for c in categorical)

    def _scaled(self, c: str) -> Column:
        mean, std = self.scales[c]
        return (F.coalesce(quoted(c).cast("double"), F.lit(self.medians[c])) - F.lit(mean)) / F.lit(std)

    def _numbered(self, df: DataFrame, categorical: list[str]) -> DataFrame:
        """Add the number of each categorical column's value as `_number_{i}`, NULL where train had no such value."""
        for i, c in enumerate(categorical):
            side = self.values.filter(F.col("name") == c).select(F.col("text").alias(f"_text_{i}"), F.col("number").alias(f"_number_{i}"))
            if self.sizes[c] <= BROADCAST_VALUES:
                side = F.broadcast(side)
            df = df.join(side, F.coalesce(quoted(c), F.lit(self.modes[c])) == F.col(f"_text_{i}"), "left").drop(f"_text_{i}")
        return df

    def encode(self, df: DataFrame, output: str = "vec") -> DataFrame:
        """Add the features as a sparse vector, numeric columns first; an unseen category is all zeros."""
        numeric, categorical = self._used()
        hot = [f"_hot_{i}" for i in range(len(categorical))]
        out = self._numbered(df, categorical).withColumns({f"_scaled_{i}": self._scaled(c) for i, c in enumerate(numeric)})
        for i, c in enumerate(categorical):
            size = self.sizes[c]
            number = F.coalesce(F.col(f"_number_{i}"), F.lit(size)).cast("double")
            out = out.withColumn(f"_number_{i}", number.alias(f"_number_{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": size}}))
        if categorical:
            names = [f"_number_{i}" for i in range(len(categorical))]
            out = OneHotEncoder(inputCols=names, outputCols=hot, handleInvalid="keep").fit(out).transform(out)
        made = [f"_scaled_{i}" for i in range(len(numeric))] + hot
        if not made:
            return df.withColumn(output, array_to_vector(F.array().cast("array<double>")))
        out = VectorAssembler(inputCols=made, outputCol="_assembled", handleInvalid="keep").transform(out)
        # The names of all categories stay out of the schema.
        vector = F.col("_assembled").alias(output, metadata={"ml_attr": {"num_attrs": self.width}})
        return out.select(*[c for c in df.columns if c != output], vector)

    def transform(self, df: DataFrame, output: str = "x") -> DataFrame:
        """Add the features as an array of all entries, for operators that add arrays up."""
        encoded = self.encode(df, "_vector")
        return encoded.withColumn(output, vector_to_array("_vector")).drop("_vector")

    def entries(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The features one by one: keys, position, feature (column or column=category), value. Zeros of categories are left out."""
        numeric, categorical = self._used()
        cells = [F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("feature"), self._scaled(c).alias("value")) for i, c in enumerate(numeric)]
        first = len(numeric)
        for i, c in enumerate(categorical):
            text = F.concat(F.lit(f"{c}="), F.coalesce(quoted(c), F.lit(self.modes[c])))
            cells.append(F.struct((F.col(f"_number_{i}") + first).cast("bigint").alias("position"), text.alias("feature"), F.lit(1.0).alias("value")))
            first += self.sizes[c]
        out = self._numbered(df, categorical).select(*keys, F.explode(F.array(*cells)).alias("_cell"))
        return out.select(*keys, "_cell.*").filter(F.col("position").isNotNull())
