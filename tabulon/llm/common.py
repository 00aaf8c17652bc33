"""Words, tables and running totals shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabulon.sources.shared import materialize

# Fixed value: what separates words.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of rows that a task turns into rows of texts or sets at a time; a longer row goes alone.
BYTES_AT_ONCE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda word: word != "")


def free_name(taken: Iterable[str], name: str) -> str:
    """name, or name with underscores before it, such that no column of the taken names clashes in any case."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def small_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BYTES_AT_ONCE, so that what a task makes of them, in Python and on the way back, does not grow with the rows of Spark's batches."""
    for batch in batches:
        rows = max(1, batch.num_rows * BYTES_AT_ONCE // max(batch.nbytes, 1))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def ranged_sums(df: DataFrame, group: str | None, order: Sequence[Column], value: str, out: str, name: str) -> DataFrame:
    """Adds out, the sum of value over the earlier rows in this order, of the same group if one is given; as a table in that order.

    Rows are range-sorted by group and order. Each partition adds up its own rows, and only one row per partition and group is put together to tell what
    lies before it, so a group of any size is spread over as many partitions as its rows need.
    """
    part, within, key = (free_name(df.columns, n) for n in ("part", "within", "group_key"))
    keyed = df.withColumn(key, F.lit("") if group is None else F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("~none")))
    by = [F.col(key), *order]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id())
    summed = StructType([*ordered.schema.fields, StructField(within, LongType())])

    def added(batches):
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(value)).to_numpy()
            keys = batch.column(batch.schema.get_field_index(key)).dictionary_encode()
            codes = keys.indices.to_numpy()
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            running = np.cumsum(values) - values
            sums = running - np.repeat(running[begins], np.diff(np.r_[begins, len(codes)]))
            first = keys.dictionary[int(codes[0])].as_py()
            if first == last:
                sums[: begins[1] if len(begins) > 1 else len(sums)] += total
            last, total = keys.dictionary[int(codes[-1])].as_py(), int(sums[-1] + values[-1])
            yield batch.append_column(within, pa.array(sums))

    table = materialize(ordered.mapInArrow(added, summed), name)
    sums = table.groupBy(key, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(key).alias("_key"), F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    joined = table.join(offsets, (F.col(key) == F.col("_key")) & (F.col(part) == F.col("_part")))
    return joined.withColumn(out, F.col(within) + F.col("_offset")).drop(key, part, within, "_key", "_part", "_offset")
