"""Grouped counts and means, ranked rows and the one-row summary."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import rounded
from tabulon.sources.shared import materialize


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def count_by(
    df: DataFrame,
    keys: Sequence[str],
    name: str = "row_count",
    drop_null_keys: bool = False,
) -> DataFrame:
    """Rows per key, largest first, ties by key."""
    base = _present(df, keys) if drop_null_keys else df
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def counts_by_sets(df: DataFrame, sets: Sequence[Sequence[str]], measures: Mapping[str, Column] = {}, keep_null_keys: Collection[int] = ()) -> list[DataFrame]:
    """For each set of keys a frame (keys, row_count, measures), all from one scan of the rows.

    Spark's grouping sets make one entry per row and set, which each task adds up before anything is shuffled; the groups of all sets are
    written once as a table. Rows with a null key are left out of a set unless its place is in keep_null_keys. Measures are made for every set.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    # A set that is asked for twice would be counted twice.
    distinct = {frozenset(s): s for s in sets}.values()
    prefix = "key"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    name = {k: f"{prefix}{i}" for i, k in enumerate(keys)}
    inputs = df.select(*[F.col(k).alias(name[k]) for k in keys], "*")
    aggregates = [F.grouping_id().alias("set_id"), F.count(F.lit(1)).alias("row_count"), *[m.alias(f"measure{i}") for i, m in enumerate(measures.values())]]
    found = inputs.groupingSets([[F.col(name[k]) for k in s] for s in distinct], *[F.col(name[k]) for k in keys]).agg(*aggregates)
    table = materialize(found, "grouped-counts")
    frames = []
    for place, names in enumerate(sets):
        # A key that does not take part in a set has a bit in its id, the first key the highest one.
        set_id = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in names)
        rows = table.where(F.col("set_id") == set_id)
        if place not in keep_null_keys:
            rows = rows.dropna(subset=[name[k] for k in names])
        frames.append(rows.select(*[F.col(name[k]).alias(k) for k in names], "row_count", *[F.col(f"measure{i}").alias(m) for i, m in enumerate(measures)]))
    return frames


def rolled_up(groups: DataFrame, keys: Sequence[str], sums: Sequence[str] = ("row_count",)) -> DataFrame:
    """Groups of fewer keys, made of the groups of more: the listed counts and sums added up, null keys included."""
    return groups.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def aggregate_by(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    min_rows: int = 0,
    order: Sequence[Column | str] = (),
    drop_null_keys: bool = False,
) -> DataFrame:
    """Any built-in aggregates per key; groups smaller than min_rows are left out."""
    base = _present(df, keys) if drop_null_keys else df
    columns = [measure.alias(name) for name, measure in measures.items()]
    if min_rows > 0:
        result = (
            base.groupBy(*keys)
            .agg(*columns, F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") >= min_rows)
            .drop("_rows")
        )
    else:
        result = base.groupBy(*keys).agg(*columns)
    return result.orderBy(*(order or keys))


def mean_by(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, str],
    count_name: str = "row_count",
    min_rows: int = 0,
    digits: int = 2,
) -> DataFrame:
    """Rounded means and the row count per key; measures maps output name to input column.

    Ordered by the first mean, then by count, both descending, then by key.
    """
    aggregates = {name: rounded(F.avg(source), digits) for name, source in measures.items()}
    aggregates[count_name] = F.count(F.lit(1))
    first = next(iter(measures))
    return aggregate_by(
        df, keys, aggregates, min_rows, order=[F.desc(first), F.desc(count_name), *keys]
    )


def non_null_counts_by(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of non-null values of each column per key; rows without a key are left out."""
    names = [c for c in (columns or df.columns) if c != key]
    return _present(df, [key]).groupBy(key).agg(*[F.count(c).alias(c) for c in names]).orderBy(key)


def top_rows(
    df: DataFrame, order: Sequence[Column], n: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """First n rows of an order; end the order with a unique key for a stable result."""
    ranked = df.orderBy(*order).limit(n)
    return ranked.select(*columns) if columns else ranked


def stack_by_name(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Rows of all frames, duplicates kept, matched by column name whatever their order.

    With allow_missing a column that a frame lacks is null in its rows.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def outside_range(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(value) < low) | (F.col(value) > high))


def summary(
    rows: DataFrame,
    tokens: DataFrame,
    token: str,
    language: str,
    year: str,
    vote: str,
    popularity: str,
) -> DataFrame:
    """One row of table-wide figures; an empty table raises when the row is read.

    The two sides are aggregated alone (one job each, distinct values counted after a shuffle by value)
    and their single rows are stacked and folded into one.
    """
    nothing = F.lit(None)
    row_side = rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(language).alias("distinct_languages"),
        F.min(year).alias("min_release_year"),
        F.max(year).alias("max_release_year"),
        F.avg(vote).alias("avg_vote"),
        F.avg(popularity).alias("avg_popularity"),
    ).select(
        "*",
        nothing.cast("bigint").alias("token_rows"),
        nothing.cast("bigint").alias("distinct_tokens"),
    )
    token_side = tokens.agg(
        F.count(F.lit(1)).alias("token_rows"), F.count_distinct(token).alias("distinct_tokens")
    )
    folded = row_side.unionByName(token_side, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in row_side.columns]
    )

    def required(name: str, value: Column) -> Column:
        problem = F.raise_error(F.lit(f"summary of an empty table: {name} has no value"))
        return F.when(F.col(name).isNull(), problem.cast("double")).otherwise(value)

    return folded.select(
        "row_count",
        "token_rows",
        F.lit(len(rows.columns)).cast("bigint").alias("typed_columns"),
        "distinct_languages",
        "distinct_tokens",
        required("min_release_year", F.col("min_release_year")).cast("int").alias("min_release_year"),
        required("max_release_year", F.col("max_release_year")).cast("int").alias("max_release_year"),
        required("avg_vote", rounded(F.col("avg_vote"))).alias("avg_vote"),
        required("avg_popularity", rounded(F.col("avg_popularity"))).alias("avg_popularity"),
    )
