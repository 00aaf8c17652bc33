"""Multi-valued cells and word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import token_array, word_array


def explode_tokens(df: DataFrame, cell: str, out: str, sep: str = ",") -> DataFrame:
    """One row per token of a delimited cell; blank tokens and rows with a null cell disappear."""
    return df.select("*", F.explode(token_array(F.col(cell), sep)).alias(out))


def word_pairs(df: DataFrame, text: str, min_len: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(word, 1) for each word of at least min_len characters, next to the kept columns."""
    return (
        df.select(*keep, F.explode(word_array(F.col(text))).alias("word"))
        .where(F.length("word") >= min_len)
        .withColumn("one", F.lit(1))
    )


def reduce_pairs(pairs: DataFrame) -> DataFrame:
    """word -> sum of its ones. Partial sums are taken before the shuffle, so a hot word stays small."""
    return pairs.groupBy("word").agg(F.sum("one").alias("n"))


def word_count(df: DataFrame, text: str, min_len: int = 3) -> DataFrame:
    return reduce_pairs(word_pairs(df, text, min_len))
