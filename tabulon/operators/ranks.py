"""The first rows of each group, whatever the size of a group and of the cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], spread_by: str, n: int, out: str | None = None
) -> DataFrame:
    """The n first rows of each group; with out, their place is added under that name.

    Each group is first cut in parts by a hash of the column spread_by, which should differ from row to row, so a hot group
    is ranked by many tasks and at most SALTS * n rows of it meet in one. Spark's own cut before the
    shuffle works on top of it where n is small.
    """
    rank = "_rank" if out is None else out
    salt = F.pmod(F.xxhash64(spread_by), F.lit(SALTS))
    parts = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    cut = df.withColumn("_salt", salt).withColumn(rank, F.row_number().over(parts)).where(F.col(rank) <= n)
    ranked = cut.drop("_salt", rank).withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
    return ranked if out else ranked.drop(rank)
