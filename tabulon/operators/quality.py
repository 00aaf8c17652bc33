"""Missing values, interquartile-range outliers and column inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import clean_double, is_missing, rounded
from tabulon.operators.quantiles import quantiles
from tabulon.operators.ranks import first_rows

# Fixed values of the outlier reports.
IQR_FACTOR = 1.5
IQR_RULE = "IQR rule: value < Q1 - 1.5*IQR or value > Q3 + 1.5*IQR."


def missing_values(
    df: DataFrame, required: Mapping[str, str], text_columns: Sequence[str] = ()
) -> DataFrame:
    """One row per required column: total rows, missing cells and their percentage.

    required maps a column to the reason why it matters. Blank cells of text_columns count as missing.
    All columns are counted in one pass; the single result row is then turned into report rows.
    """
    counts, types = [], dict(df.dtypes)
    for i, name in enumerate(required):
        cell = F.col(name)
        missing = is_missing(cell, types[name])
        if name in text_columns:
            missing = missing | (F.trim(cell) == "")
        counts.append(F.count_if(missing).alias(f"_missing{i}"))
    total = F.col("_total")

    def percent(missing: Column) -> Column:
        return F.when(total > 0, rounded(missing / total * 100)).otherwise(F.lit(0.0))

    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            total.alias("total_rows"),
            F.col(f"_missing{i}").alias("missing_count"),
            percent(F.col(f"_missing{i}")).alias("missing_percent"),
            F.lit(reason).alias("why_problem"),
        )
        for i, (name, reason) in enumerate(required.items())
    ]
    return df.agg(F.count(F.lit(1)).alias("_total"), *counts).select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Bounds:
    """Quartiles of a metric and the limits beyond which a value is an outlier."""

    q1: float
    q3: float

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def low(self) -> float:
        return self.q1 - IQR_FACTOR * self.iqr

    @property
    def high(self) -> float:
        return self.q3 + IQR_FACTOR * self.iqr

    def crossed_by(self, value: Column) -> Column:
        return (value < F.lit(self.low)) | (value > F.lit(self.high))


def iqr_bounds(
    df: DataFrame, metrics: Sequence[str], rel_error: float | None = None
) -> dict[str, Bounds]:
    """Bounds per metric, from exact quartiles or, with rel_error, from one approximate pass."""
    found = quantiles(df, metrics, [0.25, 0.75], rel_error=rel_error)
    bounds = {}
    for metric in metrics:
        if found[metric, 0.25] is None:
            raise ValueError(f"no value in column {metric!r}, so it has no quartiles")
        bounds[metric] = Bounds(float(found[metric, 0.25]), float(found[metric, 0.75]))
    return bounds


def outlier_thresholds(
    df: DataFrame, metrics: Mapping[str, str], bounds: Mapping[str, Bounds] | None = None
) -> DataFrame:
    """One row per metric with its quartiles, bounds and number of outliers.

    metrics maps a column to the reason to check it. Shown figures are rounded, counting uses the exact
    bounds. All metrics are counted in one pass.
    """
    bounds = bounds or iqr_bounds(df, list(metrics))
    counts = [
        F.count_if(bounds[metric].crossed_by(clean_double(F.col(metric)))).alias(f"_outliers{i}")
        for i, metric in enumerate(metrics)
    ]
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            rounded(F.lit(bounds[metric].q1)).alias("q1"),
            rounded(F.lit(bounds[metric].q3)).alias("q3"),
            rounded(F.lit(bounds[metric].iqr)).alias("iqr"),
            rounded(F.lit(bounds[metric].low)).alias("lower_bound"),
            rounded(F.lit(bounds[metric].high)).alias("upper_bound"),
            F.col(f"_outliers{i}").alias("outlier_count"),
            F.lit(IQR_RULE).alias("rule"),
            F.lit(reason).alias("why_check_this_metric"),
        )
        for i, (metric, reason) in enumerate(metrics.items())
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def outlier_examples(
    df: DataFrame,
    metrics: Mapping[str, str],
    keep: Sequence[str],
    tie_breaker: str,
    n: int = 20,
    bounds: Mapping[str, Bounds] | None = None,
) -> DataFrame:
    """The n outliers of each metric that lie farthest from the crossed bound.

    One pass for all metrics: a row yields an entry for each metric it is an outlier of. NaN is missing and no outlier.
    """
    bounds = bounds or iqr_bounds(df, list(metrics))
    entries = []
    for metric, reason in metrics.items():
        limits, value = bounds[metric], clean_double(F.col(metric))
        is_low = value < F.lit(limits.low)
        entry = F.struct(
            F.lit(metric).alias("metric"),
            value.alias("metric_value"),
            rounded(F.lit(limits.low)).alias("lower_bound"),
            rounded(F.lit(limits.high)).alias("upper_bound"),
            F.when(is_low, F.lit("low")).otherwise(F.lit("high")).alias("outlier_side"),
            F.when(is_low, F.lit(limits.low) - value)
            .otherwise(value - F.lit(limits.high))
            .alias("distance_from_bound"),
            F.lit(reason).alias("why_outlier"),
        )
        entries.append(F.when(limits.crossed_by(value), entry))
    farthest_first = [F.desc("distance_from_bound"), F.asc(tie_breaker)]
    columns = list(dict.fromkeys([*keep, tie_breaker]))
    outliers = df.select(*columns, F.inline(F.array(*entries))).where(F.col("metric").isNotNull())
    return first_rows(outliers, ["metric"], farthest_first, tie_breaker, n).select(
        "metric",
        *keep,
        "metric_value",
        "lower_bound",
        "upper_bound",
        "outlier_side",
        "distance_from_bound",
        "why_outlier",
    )


def _per_column(df: DataFrame, name: str, counted: list[Column], extra: list[list[Column]]) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    aggregates = [count.alias(f"_c{i}") for i, count in enumerate(counted)]
    rows = [
        F.struct(
            F.lit(column).alias("column_name"), *extra[i], F.col(f"_c{i}").alias(name)
        )
        for i, column in enumerate(df.columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count) for every column; NaN counts as null."""
    counted = [F.count_if(is_missing(F.col(f"`{c}`"), t)) for c, t in df.dtypes]
    return _per_column(df, "null_count", counted, [[] for _ in df.columns])


def schema_report(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null_count) for every column; NaN counts as null."""
    counted = [F.count_if(~is_missing(F.col(f"`{c}`"), t)) for c, t in df.dtypes]
    return _per_column(
        df, "non_null_count", counted, [[F.lit(t).alias("data_type")] for _, t in df.dtypes]
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) for each distinct value of the columns, null included, as text."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    return df.select(F.inline(F.array(*entries))).distinct()
