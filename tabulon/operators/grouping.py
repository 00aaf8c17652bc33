"""Group statistics and the most frequent tokens of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import rounded
from tabulon.operators.ranks import first_rows


def group_stats(df: DataFrame, group: str, vote: str, popularity: str, year: str) -> DataFrame:
    """Row count, mean and spread of the votes, mean popularity and mean year of each group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("row_count"),
        rounded(F.avg(vote)).alias("avg_vote"),
        rounded(F.stddev_samp(vote)).alias("std_vote"),
        rounded(F.avg(popularity)).alias("avg_popularity"),
        rounded(F.avg(year), 0).cast("int").alias("avg_release_year"),
    )


def token_counts(tokens: DataFrame, group: str, token: str) -> DataFrame:
    return tokens.groupBy(group, token).agg(F.count(F.lit(1)).alias("token_count"))


def top_tokens_per_group(tokens: DataFrame, group: str, token: str, n: int = 3) -> DataFrame:
    """The n most frequent tokens of each group, ties by token.

    Rows are counted with partial sums first; the counts of a hot group are then ranked in parts.
    """
    counts = token_counts(tokens, group, token)
    return first_rows(counts, [group], [F.desc("token_count"), F.asc(token)], token, n, "token_rank")


def top_tokens_label(
    tokens: DataFrame, group: str, token: str, n: int = 3, sep: str = " / ", out: str = "top_tokens"
) -> DataFrame:
    """Each group's n most frequent tokens as one text, most frequent first."""
    ranked = F.array_sort(F.collect_list(F.struct("token_rank", F.col(token).alias("token"))))
    return (
        top_tokens_per_group(tokens, group, token, n)
        .groupBy(group)
        .agg(F.array_join(ranked["token"], sep).alias(out))
    )


def group_profile(
    rows: DataFrame,
    tokens: DataFrame,
    group: str,
    token: str,
    vote: str,
    popularity: str,
    year: str,
    n: int = 3,
    keep_groups_without_tokens: bool = False,
) -> DataFrame:
    """Group statistics next to the group's top tokens.

    Groups without a token are left out unless asked for. Both sides hold one row per group.
    """
    how = "left" if keep_groups_without_tokens else "inner"
    return (
        group_stats(rows, group, vote, popularity, year)
        .join(top_tokens_label(tokens, group, token, n), group, how)
        .orderBy(group)
    )
