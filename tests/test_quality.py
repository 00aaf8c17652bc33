from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from tabulon.operators.profiles import numeric_profile, text_profile
from tabulon.operators.quality import (
    distinct_values,
    iqr_bounds,
    missing_values,
    null_counts,
    outlier_examples,
    outlier_thresholds,
    schema_report,
)
from tabulon.operators.reports import summary


def test_missing_values_count_null_and_blank_text(spark):
    df = spark.createDataFrame([("a", 1), ("  ", None), (None, 3), ("", 4)], "title string, n int")
    rows = missing_values(df, {"title": "why a", "n": "why b"}, ["title"]).collect()
    assert [tuple(r) for r in rows] == [("title", 4, 3, 75.0, "why a"), ("n", 4, 1, 25.0, "why b")]


def test_missing_values_of_an_empty_table(spark):
    df = spark.createDataFrame([], "title string")
    assert tuple(missing_values(df, {"title": "w"}).first()) == ("title", 0, 0, 0.0, "w")


def outlier_table(spark):
    rows = [(i, float(i % 10), 5.0) for i in range(100)]
    rows += [(100, 500.0, 5.0), (101, -500.0, 5.0), (102, 500.0, 5.0), (103, None, 5.0)]
    return spark.createDataFrame(rows, "id int, a double, b double")


def test_thresholds_and_examples(spark):
    df = outlier_table(spark)
    metrics = {"a": "check a", "b": "check b"}
    thresholds = {r.metric: r for r in outlier_thresholds(df, metrics).collect()}
    assert (thresholds["a"].q1, thresholds["a"].q3, thresholds["a"].iqr) == (2.0, 7.0, 5.0)
    assert (thresholds["a"].lower_bound, thresholds["a"].upper_bound) == (-5.5, 14.5)
    assert thresholds["a"].outlier_count == 3
    assert thresholds["b"].outlier_count == 0

    examples = outlier_examples(df, metrics, ["id"], "id", n=2).collect()
    found = [(r.metric, r.id, r.outlier_side, r.distance_from_bound) for r in examples]
    assert sorted(found) == [("a", 101, "low", 494.5), ("a", 100, "high", 485.5)][::-1]


def test_approximate_bounds_lie_within_the_rank_error(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as v").repartition(7)
    bounds = iqr_bounds(df, ["v"], rel_error=0.01)["v"]
    assert abs(bounds.q1 - 249) <= 11 and abs(bounds.q3 - 749) <= 11


def test_metric_without_values_is_refused(spark):
    df = spark.createDataFrame([(None,)], "v double")
    with pytest.raises(ValueError):
        iqr_bounds(df, ["v"])


def test_null_counts_and_schema_report_treat_nan_as_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (None, 2.0), (3, None)], "a int, b double")
    assert [tuple(r) for r in null_counts(df).collect()] == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in schema_report(df).collect()] == [("a", "int", 2), ("b", "double", 1)]


def test_distinct_values_keep_null(spark):
    df = spark.createDataFrame([("x", 1), (None, 1), ("x", 2)], "a string, b int")
    found = {tuple(r) for r in distinct_values(df, ["a", "b"]).collect()}
    assert found == {("a", "x"), ("a", None), ("b", "1"), ("b", "2")}


def test_text_profile_decides_equal_frequencies_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "t string")
    assert tuple(text_profile(df, ["t"]).first()) == ("t", 5, 3, "a", 2)


def test_numeric_profile_of_one_value(spark):
    row = numeric_profile(spark.createDataFrame([(4.0,), (None,)], "v double"), ["v"]).first()
    assert tuple(row) == ("v", 1, 4.0, None, 4.0, 4.0, 4.0, 4.0, 4.0)


def test_summary_of_an_empty_table_raises(spark):
    rows = spark.createDataFrame([], "language string, year int, vote double, pop double")
    tokens = spark.createDataFrame([], "token string")
    with pytest.raises(PySparkException):
        summary(rows, tokens, "token", "language", "year", "vote", "pop").collect()


def test_nan_is_missing_and_no_outlier(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)] + [(9, float("nan")), (10, None)], "id int, v double")
    assert outlier_thresholds(df, {"v": ""}).first().outlier_count == 0
    assert outlier_examples(df, {"v": ""}, ["v"], "id").count() == 0
    assert missing_values(df, {"v": ""}).first().missing_count == 2
