"""Per-column profiles of numeric and text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.quantiles import quantiles_and


def numeric_profile(
    df: DataFrame, columns: Sequence[str], rel_error: float | None = None
) -> DataFrame:
    """Count, mean, standard deviation, min, quartiles and max, one row per column.

    Quartiles interpolate linearly and are exact unless rel_error is given. Null and NaN are left out. Runs jobs: two scans for all columns.
    """
    aggregates = []
    for i, column in enumerate(columns):
        aggregates += [
            F.count(column).alias(f"n{i}"),
            F.avg(column).alias(f"mean{i}"),
            F.stddev_samp(column).alias(f"std{i}"),
            F.min(column).alias(f"min{i}"),
            F.max(column).alias(f"max{i}"),
        ]
    found, row = quantiles_and(df, columns, [0.25, 0.5, 0.75], aggregates, linear=True, rel_error=rel_error)
    rows = [
        (c, row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], *(found[c, p] for p in (0.25, 0.5, 0.75)), row[f"max{i}"])
        for i, c in enumerate(columns)
    ]
    kinds = "column_name string, value_count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    return df.sparkSession.createDataFrame([tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows], kinds)


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count, distinct values, the most frequent value and its frequency, one row per column.

    Values are counted per (column, value) with partial sums before the shuffle; equal frequencies are
    decided by the smaller value.
    """
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    counted = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return profile_of_counts(counted)


def profile_of_counts(counted: DataFrame) -> DataFrame:
    """The text profile from (column_name, value, rows), one row for each value that is there."""
    return (
        counted.groupBy("column_name")
        .agg(
            F.sum("rows").alias("value_count"),
            F.count(F.lit(1)).alias("distinct_count"),
            F.min(F.struct((-F.col("rows")).alias("order"), "value")).alias("_top"),
        )
        .select(
            "column_name",
            "value_count",
            "distinct_count",
            F.col("_top.value").alias("top_value"),
            (-F.col("_top.order")).alias("top_count"),
        )
    )
