"""Queries that write tables as CSV files, read them back and return what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.sources import read_delimited, read_many, write_delimited, write_report
from tabulon.sources.shared import new_path
from workload import fixtures as fx


def csv_roundtrip(spark, folder):
    """Whole texts with quotes, commas and line breaks through the CSV scan."""
    path = new_path(spark, "documents")
    documents = fx.table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    write_delimited(documents, path)
    read = read_delimited(spark, path, columns=["doc_id", "lang", "source", "text"], multi_line=True, split=True)
    return read.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        "source",
        F.length("text").cast("bigint").alias("characters"),
        F.sha2("text", 256).alias("digest"),
    )


def csv_sink_roundtrip(spark, folder):
    """Padded cells of the dirty catalog through the CSV sink, typed as they were."""
    path = new_path(spark, "catalog")
    write_delimited(fx.catalog_raw(spark, folder), path)
    return read_delimited(spark, path, multi_line=False).select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.col("Release_Date").alias("raw_date"),
        F.col("Title").alias("raw_title"),
        F.col("Overview").alias("raw_overview"),
        F.col("Genre").alias("raw_genre"),
    )


def multi_file_concat(spark, folder):
    """Two files with partly different columns, read as one table by column name."""
    orders = fx.table(spark, folder, "orders")
    finished, others = new_path(spark, "finished"), new_path(spark, "others")
    is_finished = F.col("o_orderstatus") == "F"
    write_delimited(orders.where(is_finished).select("o_orderkey", "o_orderstatus", "o_custkey"), finished)
    write_delimited(
        orders.where(~is_finished).select("o_orderpriority", "o_orderkey", "o_orderstatus"), others
    )
    return read_many(spark, [finished, others], multi_line=False).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        "o_orderstatus",
        F.col("o_custkey").cast("bigint").alias("o_custkey"),
        "o_orderpriority",
    )


def single_file_report(spark, folder):
    """A sorted report saved as one file of a fixed name."""
    path = new_path(spark, "report") + "/picks.csv"
    report = (
        fx.table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("picks"))
    )
    write_report(report.orderBy(F.desc("picks"), "l_suppkey"), path)
    return read_delimited(spark, path).select(
        F.col("l_suppkey").cast("bigint").alias("l_suppkey"), F.col("picks").cast("bigint").alias("picks")
    )


CASES = {
    "csv_roundtrip": (
        csv_roundtrip,
        "select doc_id, lang, source, length(nullif(text, '')) as characters,"
        " sha256(nullif(text, '')) as digest from documents",
    ),
    "csv_sink_roundtrip": (
        csv_sink_roundtrip,
        f"with {fx.RAW_SQL} select item_id, raw_date, raw_title, raw_overview, raw_genre from catalog_raw",
    ),
    "multi_file_concat": (
        multi_file_concat,
        """select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' then o_custkey end as o_custkey,
       case when o_orderstatus <> 'F' then o_orderpriority end as o_orderpriority from orders""",
    ),
    "single_file_report": (
        single_file_report,
        "select l_suppkey, count(*) as picks from lineitem group by l_suppkey",
    ),
}
