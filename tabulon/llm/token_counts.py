"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.encoding import default_vocabulary, encode
from tabulon.sources.shared import materialize

LENGTHS_PER_BLOCK = 64


def encoded_lengths(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens) per row: the encoded length of the whole text, 0 for null."""
    path = vocabulary or default_vocabulary()

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(encode(path, value.as_py())) for value in batch.column(0)], pa.int64())], names=["n_tokens"]
            )

    return df.select(F.col(text).alias("text")).mapInArrow(lengths, "n_tokens bigint")


def length_histogram(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """One row per encoded length that occurs.

    n_tokens (the length), n_docs, longer_docs and longer_tokens (documents of a greater length and their tokens: suffix
    sums), truncated_total (all tokens if every document is cut to n_tokens), total_docs, total_tokens, rank_share
    (share of the documents up to this length, so the p-quantile is the least length with rank_share >= p).

    Null and empty texts have length 0; an empty table gives no row. Documents are added up before the shuffle, so
    only one row per length and task is moved, however many documents share a length.
    """
    encoded = encoded_lengths(df, text, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    # Kept as a table of one row per length, so that the texts are encoded once.
    counts = materialize(encoded, "length-counts")
    counts = counts.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / LENGTHS_PER_BLOCK)})
    # One row per block of lengths meets in the windows that are not partitioned.
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    carried = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(beyond), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum("tokens").over(beyond), F.lit(0)).alias("tokens_beyond"),
        F.sum("docs").over(whole).alias("total_docs"),
        F.sum("tokens").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.join(carried, "block").withColumns(
        {
            "longer_docs": F.col("docs_beyond") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
            "longer_tokens": F.col("tokens_beyond") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
        }
    )
    return sums.select(
        "n_tokens",
        "n_docs",
        "longer_docs",
        "longer_tokens",
        (F.col("total_tokens") - F.col("longer_tokens") + F.col("longer_docs") * F.col("n_tokens")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - F.col("longer_docs")) / F.col("total_docs")).alias("rank_share"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """(truncated_total) for any context limit, read from the histogram."""
    cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return histogram.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_total"))


def quantile(histogram: DataFrame, p: float) -> DataFrame:
    """(n_tokens): the least length that a share p of the documents does not exceed; null for no document."""
    return histogram.where(F.col("rank_share") >= p).agg(F.min("n_tokens").alias("n_tokens"))
