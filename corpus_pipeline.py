"""A training-data pipeline over documents, as five stages that each call an operator of tabulon.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import classifier, jaccard_join, mixing, packing, suffix_dedup
from tabulon.llm.common import free_name, table
from tabulon.sources.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are scored like others, equal rows each; without labels every score is 0.5 and all stay; an empty table gives no rows.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    scored = classifier.score(docs, model, out=score)
    return scored.where(F.col(score) >= classifier.THRESHOLD).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, null ids last.

    Texts without words, null ones included, are copies of each other; of equal rows, and of rows that tie in id and words, one stays; an empty table
    gives no rows.
    """
    return jaccard_join.one_per_class(docs).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated strings of 200 bytes; bytes of a code point that was cut go too.

    Null texts stay null, short ones whole; equal rows repeat each other, so both lose all that is long enough; a text of which nothing remains stays as an
    empty one; an empty table gives no rows.
    """
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in its order; a copy that the budget cuts has the words taken of it.

    Documents without words, null ones included, are never taken; a null source is a source; equal rows are taken each, ties go by a digest of id and
    text; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each row's token ids, one to a sequence; a null or empty text is its end id alone, equal rows are packed each, no rows give none."""
    return packing.pack(docs, "doc_id", "text").select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources", mixture),
    ("packing", sequences),
]

#: Four of the stages are beyond SQL; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
