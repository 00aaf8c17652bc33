"""Crosstabs, shares and correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import clean_double


#: Rows whose moments a task takes at once.
BLOCK_ROWS = 4096


def pivot_values(df: DataFrame, column: str) -> list:
    """The sorted values of a column that becomes a header; runs a job. Each becomes a column, so the caller
    chooses the wide form where they are few and crosstab_long where they are many."""
    return sorted(row[0] for row in df.where(F.col(column).isNotNull()).select(column).distinct().collect())


def crosstab_long(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, row_count) of the pairs that occur, for any number of values on either side."""
    return df.dropna(subset=[row, column]).groupBy(row, column).agg(F.count(F.lit(1)).alias("row_count"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Row count per (row value, column value) with one output column per value, absent pairs as 0.

    Give the values to avoid the extra job that looks them up. Rows with a null on either side are left
    out, as are cells of values not listed.
    """
    listed = list(values) if values is not None else pivot_values(df, column)
    return (
        df.dropna(subset=[row, column])
        .groupBy(row)
        .pivot(column, listed)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .orderBy(row)
    )


def crosstab_of_counts(counts: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """The wide form of crosstab_long, with one output column per value, absent pairs as 0."""
    return counts.groupBy(row).pivot(column, list(values)).agg(F.sum("row_count")).na.fill(0).orderBy(row)


def top_share(df: DataFrame, key: str, column: str, value: object, n: int = 5) -> DataFrame:
    """The n keys with most rows of one crosstab column, and each one's share among the n in percent."""
    return top_share_of_counts(crosstab_long(df, key, column), key, column, value, n)


def top_share_of_counts(counts: DataFrame, key: str, column: str, value: object, n: int = 5) -> DataFrame:
    """The same from crosstab_long."""
    rows = F.when(F.col(column) == F.lit(value), F.col("row_count")).otherwise(0)
    top = counts.groupBy(key).agg(F.sum(rows).alias("row_count")).orderBy(F.desc("row_count"), key).limit(n)
    gathered = top.agg(
        F.collect_list(F.struct(F.col(key), "row_count")).alias("_top"), F.sum("row_count").alias("_all")
    )  # n entries in one row
    share = F.try_divide(F.col("row_count") * F.lit(100.0), F.col("_all"))
    return (
        gathered.select("_all", F.inline("_top"))
        .select(key, "row_count", share.alias("share_percent"))
        .orderBy(F.desc("row_count"), key)
    )


#: What is kept of each pair of columns, over the rows where both are set: rows, means, squared deviations, their product, and squares about the mean of a batch.
MOMENTS = ("n", "x", "y", "xx", "yy", "xy", "sx", "sy")


def _batch_moments(values: np.ndarray) -> dict[str, np.ndarray]:
    """The moments of all pairs of columns of some rows; NaN is missing. A few products of matrices, centred so that nothing large cancels."""
    there = ~np.isnan(values)
    counts = there.sum(0)
    center = np.where(there, values, 0.0).sum(0) / np.maximum(counts, 1)
    mask = there.astype(float)
    deviation = np.where(there, values - center, 0.0)
    n = mask.T @ mask
    some = np.maximum(n, 1)
    x = deviation.T @ mask
    squares = (deviation * deviation).T @ mask
    spread = np.maximum(squares - x * x / some, 0.0)
    return {
        "n": n,
        "x": center[:, None] + x / some,
        "y": center[None, :] + x.T / some,
        "xx": spread,
        "yy": spread.T,
        "xy": deviation.T @ deviation - x * x.T / some,
        "sx": squares,
        "sy": squares.T,
    }


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The moments of the rows of both."""
    n = a["n"] + b["n"]
    share = b["n"] / np.maximum(n, 1)
    weight = a["n"] * share
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return {
        "n": n,
        "x": a["x"] + dx * share,
        "y": a["y"] + dy * share,
        "xx": a["xx"] + b["xx"] + dx * dx * weight,
        "yy": a["yy"] + b["yy"] + dy * dy * weight,
        "xy": a["xy"] + b["xy"] + dx * dy * weight,
        "sx": a["sx"] + b["sx"],
        "sy": a["sy"] + b["sy"],
    }


def _coefficients(m: dict[str, np.ndarray]) -> np.ndarray:
    """Correlations; NaN where a column is constant over the pair's rows, up to what rounding leaves."""

    def constant(spread: str, mean: str, squares: str) -> np.ndarray:
        return (m[spread] <= 1e-13 * m[squares]) | (m[spread] <= m["n"] * (4e-15 * m[mean]) ** 2)

    unknown = (m["n"] == 0) | constant("xx", "x", "sx") | constant("yy", "y", "sy")
    scale = np.sqrt(np.where(unknown, 1.0, m["xx"])) * np.sqrt(np.where(unknown, 1.0, m["yy"]))
    return np.where(unknown, np.nan, m["xy"] / scale)


def correlation(df: DataFrame, columns: Sequence[str], full: bool = False) -> DataFrame:
    """Pearson correlation as rows (column_a, column_b, r), each pair over the rows where both are set.

    All pairs come from one pass: each task multiplies its rows' matrix with itself and with the mask of what is set, and sends one row of moments per
    column, so no row is multiplied however many columns there are. r is null where a column is constant over the pair's rows. With
    full=True the mirrored pairs and the diagonal are listed too.
    """
    names = list(columns)
    doubles = df.select(*[clean_double(F.col(c)).alias(c) for c in names])
    kinds = ", ".join(f"{name} array<double>" for name in MOMENTS)

    def of_task(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                values = np.stack([pc.fill_null(column, float("nan")).to_numpy(zero_copy_only=False) for column in batch.columns], axis=1)
                for begin in range(0, len(values), BLOCK_ROWS):
                    found = _batch_moments(values[begin : begin + BLOCK_ROWS])
                    total = found if total is None else _merged(total, found)
        if total is not None:
            lists = [pa.array(list(total[name]), pa.list_(pa.float64())) for name in MOMENTS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), *lists], names=["line", *MOMENTS])

    def of_lines(batches):
        lines: dict[int, dict[str, np.ndarray]] = {}
        for batch in batches:
            for line, *lists in zip(batch.column(0).to_pylist(), *(batch.column(i + 1) for i in range(len(MOMENTS))), strict=True):
                found = {name: x.values.to_numpy() for name, x in zip(MOMENTS, lists)}
                lines[line] = _merged(lines[line], found) if line in lines else found
        out = []
        for line, found in sorted(lines.items()):
            for other, r in enumerate(_coefficients(found).tolist()):
                if full or other > line:
                    out.append((names[line], names[other], None if math.isnan(r) else r))
        listed = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(listed, (pa.string(), pa.string(), pa.float64()))], names=["column_a", "column_b", "r"])

    parts = doubles.mapInArrow(of_task, f"line int, {kinds}")
    found = parts.repartition("line").mapInArrow(of_lines, "column_a string, column_b string, r double")
    # Without rows there are no moments, but the pairs are listed all the same.
    pairs = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if full or j > i]
    listed = df.sparkSession.createDataFrame(pairs, "column_a string, column_b string")
    return listed.join(found, ["column_a", "column_b"], "left")


def won_lost(df: DataFrame, key: str, result: str, labels: Sequence[str]) -> DataFrame:
    """Rows per key and result label, keyed by name and never by position."""
    return crosstab(df, key, result, labels)
