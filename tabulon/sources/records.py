"""Comma-separated files whose cells hold line breaks, read by many tasks.

A byte range of such a file does not tell by itself whether it begins inside a quoted cell. So the files are read as physical lines, in the
ranges that Spark splits them into, and each range numbers its lines and counts their quotes. The parity of the quotes in all earlier ranges of the file
tells how a range begins; with it a line begins a record if the quotes before it are even. A line that begins a record and has an even number of
quotes is a whole record and stays where it was read. Only the lines of other records, which go over several lines and maybe ranges, are
gathered. Records are then parsed one by one.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.sources.shared import materialize

#: Ranges whose parities are sent to every task, some 100 bytes each; beyond that they are joined like any table.
MAX_SENT_RANGES = 100_000
MARKED = pa.schema(
    [("file", pa.string()), ("range", pa.int64()), ("line", pa.int64()), ("odd", pa.bool_()), ("open", pa.bool_()), ("starts_0", pa.int64()), ("starts_1", pa.int64()), ("value", pa.string())]
)
MARKED_TYPE = "file string, range bigint, line bigint, odd boolean, open boolean, starts_0 bigint, starts_1 bigint, value string"
PARSER = {"escape": '"', "mode": "PERMISSIVE"}


def marked_lines(batches) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, range) in reading order, with what their range alone tells.

    line: the number in the range; odd: whether it has an odd number of quotes; open: whether the quotes before it in the range are odd; starts_0 and starts_1: how
    many lines up to this one begin a record if the range begins outside or inside a cell. Empty lines outside of cells begin none.
    """
    current, line, parity, starts = None, 0, 0, [0, 0]
    for batch in batches:
        value = batch.column(0)
        files, ranges = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
        odd = pc.count_substring(value, '"').to_numpy() % 2
        filled = pc.binary_length(pc.utf8_rtrim(value, "\r")).to_numpy() > 0
        changes = np.flatnonzero((ranges[1:] != ranges[:-1]) | (files[1:] != files[:-1])) + 1
        for begin, end in zip(np.r_[0, changes], np.r_[changes, len(ranges)]):
            if begin == end:
                continue
            if current != (files[begin], ranges[begin]):
                current, line, parity, starts = (files[begin], ranges[begin]), 0, 0, [0, 0]
            span = slice(int(begin), int(end))
            before = (parity + np.r_[0, np.cumsum(odd[span])[:-1]]) % 2
            counts = [starts[p] + np.cumsum((before == p) & filled[span]) for p in (0, 1)]
            columns = [pa.array(np.arange(line, line + end - begin)), pa.array(odd[span] == 1), pa.array(before == 1), *map(pa.array, counts)]
            size = int(end - begin)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(int(begin), size), batch.column(2).slice(int(begin), size), *columns, value.slice(int(begin), size)], schema=MARKED)
            line, parity, starts = line + size, int((before[-1] + odd[end - 1]) % 2), [int(c[-1]) for c in counts]


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, range, inside, crlf, last): how each range begins, its file's kind of line end, and the last record before it."""
    found = lines.groupBy("file", "range").agg(
        F.sum(F.col("odd").cast("bigint")).alias("odd"),
        F.max("starts_0").alias("starts_0"),
        F.max("starts_1").alias("starts_1"),
        F.max(F.when((F.col("range") == 0) & (F.col("line") == 0), F.endswith("value", F.lit("\r")))).alias("crlf"),
    )
    # One row per range, so a file of any size has few.
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = found.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("own", F.when(F.col("inside"), F.col("starts_1")).otherwise(F.col("starts_0")))
    last = F.last(F.when(F.col("own") > 0, F.struct("range", F.col("own").alias("record"))), ignorenulls=True).over(earlier)
    crlf = F.coalesce(F.max("crlf").over(Window.partitionBy("file")), F.lit(False))
    return begun.select("file", "range", "inside", crlf.alias("crlf"), last.alias("last"))


def has_stray_quote(record: Column) -> Column:
    """Whether a quote stands inside a cell that is not quoted, or behind a quoted one: quotes do not tell cells apart then."""
    marked = F.regexp_replace(record, '"[^"]*+"', "\u0001")
    return marked.rlike('[^,\u0001]\u0001|\u0001[^,\u0001]|"')


def raw_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, is_header, record): the records of CSV files as text, cells with line breaks included.

    Line ends of a file that ends its first line with CRLF are read as line feeds, inside cells too. The first record of each file
    is its header. Empty lines between records are left out. Records come in no fixed order. A quote that is never closed makes the rest of its file one record.
    """
    scanned = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    lines = scanned.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))
    # Kept as a table: later passes must see the same ranges, and splits may differ from one scan to the next.
    lines = materialize(lines.mapInArrow(marked_lines, MARKED_TYPE), "csv-lines")
    ranges = materialize(_ranges(lines), "csv-ranges")
    if ranges.count() <= MAX_SENT_RANGES:
        ranges = F.broadcast(ranges)
    known = lines.join(ranges, ["file", "range"])

    inside = F.col("open") != F.col("inside")
    number = F.when(F.col("inside"), F.col("starts_1")).otherwise(F.col("starts_0"))
    text = F.when(F.col("crlf") & F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    # Lines before the first record of their range go on with the last one before it.
    before = number == 0
    placed = known.select(
        "file",
        "range",
        "line",
        (~inside & ~F.col("odd")).alias("whole"),
        F.when(before, F.col("last.range")).otherwise(F.col("range")).alias("of_range"),
        F.when(before, F.col("last.record")).otherwise(number).alias("record"),
        text.alias("text"),
    )
    is_header = ((F.col("of_range") == 0) & (F.col("record") == 1)).alias("is_header")
    whole = placed.where(F.col("whole") & (F.col("text") != "")).select("file", is_header, F.col("text").alias("record"))
    parts = placed.where(~F.col("whole")).groupBy("file", "of_range", "record").agg(F.array_sort(F.collect_list(F.struct("range", "line", "text"))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return whole.unionByName(parts.select("file", is_header, joined.alias("record")))


def column_names(header: str) -> list[str]:
    """The names in a header record; empty ones are called by their place, names that occur twice get their place behind them."""
    cells = next(csv.reader([header], strict=True), [])
    lowered = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lowered.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_records(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All-string table from CSV files with a header; cells may hold line breaks, quoted cells double their quotes.

    One file of any size is read by as many tasks as Spark splits it for. All files must have the same header, the given columns if there are any. A
    record with fewer cells has nulls, surplus cells are dropped, empty cells are null. Quotes inside cells without quotes cannot
    be told from those around cells: such a record raises when it is read. The lines are written once as a table.
    """
    records = raw_records(spark, path)
    headers = [r["record"] for r in records.where("is_header").select("record").distinct().limit(2).collect()]
    names = [column_names(h) for h in headers]
    if columns is None and not names:
        raise ValueError(f"no header in {path}")
    expected = list(columns) if columns is not None else names[0]
    if any(n != expected for n in names):
        raise ValueError(f"header {next(n for n in names if n != expected)} instead of {expected}")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in expected)
    message = F.concat(F.lit("a quote inside a cell without quotes, read the file without split: "), F.substring("record", 1, 200))
    checked = F.when(has_stray_quote(F.col("record")), F.raise_error(message).cast("string")).otherwise(F.col("record"))
    parsed = records.where(~F.col("is_header")).select(F.from_csv(checked, F.lit(schema), PARSER).alias("cells"))
    return parsed.select("cells.*").to(T.StructType([T.StructField(c, T.StringType()) for c in expected]))
