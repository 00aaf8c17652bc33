"""Mixing sources to target weights by weighted fair queueing.

The documents of a source, shuffled by a digest, come one after the other, each in packets of at most PACKET words, and all of it again in the next epoch. A packet's
virtual finish time is the number of words of its source up to its end over the source's target, so sources with greater targets advance faster.
All packets of all sources are range-sorted by that time, and the mix is what the total budget holds of them: that cut alone decides what is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import free_name, ranged_sums, word_list
from tabulon.sources.shared import materialize, release

# Fixed values of the registered mix.
WEIGHTS = (5, 2, 1)
BUDGET_TENTHS = 15
EPOCHS = 2
SEED = "mix-1"
#: Words that are served together: a source's words in the mix come this near to its target.
PACKET = 64


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("bigint")


def shuffle_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number below 2^60 that puts the documents of a source in a random but repeatable order; equal ids with other texts lie apart."""
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, tenths: int = BUDGET_TENTHS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Sources by code point, null last, get the weights in turn. The budget is tenths / 10 of all sizes; a target
    stops at epochs times its source's size and the excess is shared again by weight: sources are filled in the order
    of limit over weight until the common level is below the next limit. One row per source meets in one task.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = per_source.withColumn("weight", F.get(listed, place % len(weights))).withColumn("cap", F.col("source_size") * epochs)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * tenths / F.lit(10.0)
    level = (budget - F.coalesce(F.sum("cap").over(filled), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    )
    steps = ranked.withColumn("level", level)
    # The first source whose limit is above its level sets the level for all that follow.
    common = steps.withColumn("common", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    target = F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))
    )
    return common.select("source", "source_size", "n_docs", target.alias("target"))


def _sized(df: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """One row per input row, without its text: row (its number), doc_id, source, size, key."""
    return df.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        shuffle_key(F.col(doc_id), F.col(text)).alias("key"),
        "row",
    )


def _served(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """What the budget holds of each copy of each row: row, copy, finish, position, taken, beside the columns of rows and aims."""
    started = ranged_sums(rows, "source", [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")], "size", "start", "mix-order")
    aimed = started.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = aimed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / PACKET) - 1)
    packets = copies.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    begin = F.col("packet") * PACKET
    packets = packets.withColumn("words", F.least(F.lit(PACKET).cast("bigint"), F.col("size") - begin))
    served = F.col("start") + F.col("copy") * F.col("source_size") + begin + F.col("words")
    timed = packets.withColumn("finish", F.when(F.col("target") > 0, served / F.col("target")).otherwise(0.0))
    in_time = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("copy"), F.col("key"), F.col("doc_id"), F.col("row"), F.col("packet")]
    placed = ranged_sums(timed.select("row", "source", "key", "doc_id", "copy", "packet", "words", "finish"), None, in_time, "words", "position", "mix-packets")
    budget = aims.agg(F.floor(F.sum("source_size") * BUDGET_TENTHS / 10)).first()[0] or 0
    taken = F.least(F.col("words"), F.greatest(F.lit(0).cast("bigint"), F.lit(budget) - F.col("position")))
    return placed.withColumn("taken", taken).groupBy("row", "copy").agg(F.max("finish").alias("finish"), F.min("position").alias("position"), F.sum("taken").alias("taken"))


def mix(df: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """One row per copy of a document that the mix takes or could take, with what it takes.

    Columns: doc_id, row (a number of the input row), source, size, source_size, target, copy (from 0), finish (virtual finish time of its last packet),
    position (words of all packets before its first one, in the order of finish), taken (words, from its beginning, that the budget holds).

    A document is offered once per epoch, so none is taken more than that often, and a source comes within PACKET words of its target. Null texts have
    size 0; a null source is a source; rows with equal ids stay rows; other columns are left out; an empty table gives an empty result. Only numbers are
    sorted, not texts, and any source or id is spread over many tasks; a text of any length is counted where it is read.
    """
    rows = materialize(_sized(df.withColumn("row", F.monotonically_increasing_id()), doc_id, source, text), "mix-sizes")
    aims = materialize(targets(rows), "mix-targets")
    copies = _served(rows, aims).join(rows.drop("key"), "row").join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return copies.select("doc_id", "row", "source", "size", "source_size", "target", "copy", "finish", "position", "taken")


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix, in its order, with the columns of df: one per copy, a copy taken in part with its first words only.

    A column n_chars is set to the length of the text. Equal rows are taken each; the same rows give the same mix.
    """
    row, copy, taken, size, position = (free_name(df.columns, n) for n in ("row", "copy", "taken", "size", "position"))
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    rows = materialize(_sized(numbered.select(doc_id, source, text, F.col(row).alias("row")), doc_id, source, text), "mix-sizes")
    served = _served(rows, materialize(targets(rows), "mix-targets")).where(F.col("taken") > 0)
    chosen = materialize(served.join(rows.select("row", "size"), "row").select(*[F.col(a).alias(b) for a, b in zip(("row", "copy", "taken", "size", "position"), (row, copy, taken, size, position))]), "mix-taken")
    release(rows)
    part = F.array_join(F.slice(word_list(F.col(text)), F.lit(1), F.col(taken).cast("int")), " ")
    cut = numbered.join(chosen, row).withColumn(text, F.when(F.col(taken) < F.col(size), part).otherwise(F.col(text)))
    out = cut.repartitionByRange(position, row, copy).sortWithinPartitions(position, row, copy).select(df.columns)
    return out.withColumn("n_chars", F.length(text).cast("bigint")) if "n_chars" in df.columns else out
