"""Similar rows: the best rows of the group in which a probe title lies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.ranks import first_rows


def probe_frame(df: DataFrame, titles: Sequence[str]) -> DataFrame:
    """(probe, folded) rows of the wanted titles; a title repeated in other case is kept once each."""
    schema = T.StructType([T.StructField("probe", T.StringType(), False)])
    rows = [(title,) for title in dict.fromkeys(titles)]
    return df.sparkSession.createDataFrame(rows, schema).withColumn("folded", F.lower("probe"))


def recommend(
    df: DataFrame,
    titles: Sequence[str],
    group: str,
    title: str,
    id_column: str,
    order: Sequence[str],
    output: Sequence[str],
    n: int = 10,
    probe_name: str = "because",
) -> DataFrame:
    """For each title, the n best other rows of its group, best by the order columns, descending.

    Titles match in any case; the row with the smallest id decides the group, every row with the same title
    is left out, an unknown title gives no rows, and equal rows are ordered by id.

    Only groups that hold a probe are looked at, and their candidates are bounded without losing a result:
    no list uses more than n rows of one probed title, so rows are first cut to n per (group, probed title),
    with the rows of all other titles taken together. Of what is left, the best 2n per group hold, for every
    probe, n rows besides its own at most n. Both cuts are made before the shuffle as well, and the join
    with the probes sees 2n rows per group.
    """
    probes = probe_frame(df, titles)
    folded_rows = df.withColumn("_folded", F.lower(F.col(title)))
    homes = (
        folded_rows.join(probes, F.col("_folded") == F.col("folded"))
        .groupBy("probe", "folded")
        .agg(F.min_by(group, id_column).alias("_home"))
    )
    wanted_groups = homes.select("_home").distinct()
    probed_titles = probes.select(F.col("folded").alias("_probed")).distinct()

    best_first = [F.desc(c) for c in order] + [F.asc(id_column)]
    columns = list(dict.fromkeys([*output, group, id_column, *order]))
    candidates = (
        folded_rows.select(*columns, "_folded")
        .where(F.col("_folded").isNotNull())
        .join(wanted_groups, F.col(group) == F.col("_home"), "left_semi")
        .join(probed_titles, F.col("_folded") == F.col("_probed"), "left")
    )
    candidates = first_rows(candidates, [group, "_probed"], best_first, id_column, n)
    candidates = first_rows(candidates, [group], best_first, id_column, 2 * n).drop("_probed")

    per_probe = Window.partitionBy("probe").orderBy(*best_first)
    same_group_other_title = (F.col(group) == F.col("_home")) & (F.col("folded") != F.col("_folded"))
    return (
        candidates.join(homes, same_group_other_title)
        .withColumn("_rank", F.row_number().over(per_probe))
        .where(F.col("_rank") <= n)
        .select(F.col("probe").alias(probe_name), *output, F.col("_rank").alias("place"))
    )
