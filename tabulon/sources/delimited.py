"""Comma-separated files and literal tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.sources.records import read_records
from tabulon.sources.shared import new_path, shuffles_removed

#: Text of a line that does not fit the columns.
CORRUPT = "_corrupt_line"


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    partitions: int | None = None,
    split: bool = False,
) -> DataFrame:
    """All-string table from CSV files with a header; cells are quoted with '"' and escape it by doubling.

    Large files are split. Set multi_line where cells hold line breaks; a file is then read by one task, in its order, unless split is set:
    then as many tasks read it as any other file, and rows come in no fixed order (read_records tells how). partitions
    spreads the rows of few large files for the work that follows. Give columns to skip reading the
    header beforehand; files whose header differs then raise, and so does a cell that goes over the end of its line where
    multi_line is not set.
    """
    if multi_line and split:
        df = read_records(spark, path, columns)
        return df.repartition(partitions) if partitions else df
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
    )
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        if not multi_line:
            # A record that breaks off has too few cells, or too many after it: its text tells which.
            schema = schema.add(CORRUPT, T.StringType())
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        reader = reader.schema(schema).option("enforceSchema", False)
    df = reader.csv(path if isinstance(path, str) else list(path))
    if columns is not None and not multi_line:
        odd = F.length(F.regexp_replace(CORRUPT, '[^"]', "")) % 2 == 1
        broken = F.raise_error(F.concat(F.lit("a cell goes on after its line, set multi_line: "), F.substring(CORRUPT, 1, 200)))
        first = F.when(odd, broken.cast("string")).otherwise(F.col(f"`{columns[0]}`")).alias(columns[0])
        df = df.select(first, *[F.col(f"`{c}`") for c in columns[1:]])
    return df.repartition(partitions) if partitions else df


def read_many(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Rows of several CSV sources one after the other, matched by column name; absent columns are null."""
    if not paths:
        raise ValueError("no paths given")
    frames = [read_delimited(spark, path, **options) for path in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def literal_table(
    spark: SparkSession, columns: Mapping[str, Sequence], schema: T.StructType | str
) -> DataFrame:
    """Small table from lists given per column."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def _writer(df: DataFrame):
    # Quotes are doubled and blanks are kept, so that the files read back as they were written.
    return (
        df.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV folder with one file per partition, for results of any size.

    Null and the empty string both read back as null; everything else reads back unchanged.
    """
    _writer(df).mode(mode).csv(path)


def write_report(df: DataFrame, path: str, limit: int | None = None) -> None:
    """One CSV file of exactly this name, replacing an earlier one, with the rows in their order.

    All tasks write their part of the rows; the file system then joins the parts in order: by reference where it can (concat), otherwise
    they are copied one after the other as a stream. The file is put in place when it is complete. Rows of a frame that is
    sorted stay sorted.
    """
    spark = df.sparkSession
    rows = df.limit(limit) if limit is not None else df
    staging = new_path(spark, "report")
    with shuffles_removed(spark):
        _writer(rows).option("header", False).csv(staging)
    header = literal_table(spark, {c: [c] for c in rows.columns}, ", ".join(f"`{c.replace('`', '``')}` string" for c in rows.columns))
    _writer(header.coalesce(1)).option("header", False).csv(f"{staging}-header")
    _join_files(spark, [f"{staging}-header", staging], path)


def _join_files(spark: SparkSession, folders: Sequence[str], path: str) -> None:
    """One file of the part files of the folders, in order; the folders go."""
    # The Hadoop file system of each path, so that any storage Spark can write to works.
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    target_fs = target.getFileSystem(conf)
    parts = []
    for folder in folders:
        fs = hadoop.fs.Path(folder).getFileSystem(conf)
        found = fs.globStatus(hadoop.fs.Path(f"{folder}/part-*.csv"))
        parts += [(fs, p) for p in sorted((f.getPath() for f in found if f.getLen() > 0), key=lambda p: p.getName())]
    unfinished = hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}.unfinished") if target.getParent() is not None else hadoop.fs.Path(f"{path}.unfinished")
    if not _joined_by_reference(spark, target_fs, parts, unfinished):
        stream = target_fs.create(unfinished, True)
        try:
            for fs, part in parts:
                source = fs.open(part)
                try:
                    hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
                finally:
                    source.close()
        finally:
            stream.close()
    target_fs.delete(target, False)
    if not target_fs.rename(unfinished, target):
        raise OSError(f"{path} cannot be put in place")
    for folder in folders:
        where = hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)


def _joined_by_reference(spark: SparkSession, target_fs, parts: Sequence[tuple], unfinished) -> bool:
    """Whether the file system has joined the parts without copying; it needs them all in its own store."""
    if any(fs.getUri() != target_fs.getUri() for fs, _ in parts) or target_fs.getScheme() != "hdfs":
        return False
    target_fs.create(unfinished, True).close()
    paths = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, (_, part) in enumerate(parts):
        paths[i] = part
    try:
        target_fs.concat(unfinished, paths)
    except Exception:  # noqa: BLE001  a store may refuse, as for encrypted folders; then the parts are copied
        return False
    return True
