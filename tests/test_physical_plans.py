"""What the plans must look like to hold at scale."""

from __future__ import annotations

import __spark_entry__ as contract
from pyspark.sql import functions as F
from tabulon.operators.quality import Bounds, outlier_thresholds
from tabulon.operators.reports import count_by, top_rows
from tabulon.operators.tokens import word_count


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def registered(spark, small, name):
    return contract.queries()[name](spark, small)


def test_top_tokens_cut_before_the_shuffle(spark, small):
    text = plan(registered(spark, small, "top_tokens_per_group"))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_similar_rows_cut_before_the_shuffle(spark, small):
    text = plan(registered(spark, small, "recommend_similar"))
    assert text.count("WindowGroupLimit") >= 4


def test_outlier_examples_cut_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(registered(spark, small, "outlier_examples"))


def test_rankings_keep_the_top_rows_only(spark, small):
    for name in ("top_popular", "high_quality_top", "top_genres"):
        assert "TakeOrderedAndProject" in plan(registered(spark, small, name))


def test_counts_are_combined_before_the_shuffle(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    text = plan(count_by(lines, ["l_returnflag"]))
    assert "partial_count" in text
    assert "ReadSchema: struct<l_returnflag:string>" in text
    documents = spark.read.parquet(f"{small}/documents.parquet")
    assert "partial_sum" in plan(word_count(documents, "text"))


def test_filters_and_columns_reach_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").where(F.col("o_totalprice") >= 1000)
    text = plan(top_rows(orders, [F.desc("o_totalprice"), "o_orderkey"], 5, ["o_orderkey", "o_totalprice"]))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_thresholds_need_one_pass(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    metrics = {"l_quantity": "a", "l_extendedprice": "b", "l_discount": "c"}
    text = plan(outlier_thresholds(lines, metrics, {m: Bounds(0.0, 1.0) for m in metrics}))
    assert text.count("FileScan") == 1
