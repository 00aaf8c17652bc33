from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tabulon.functions import map_values
from tabulon.operators.matrix import correlation, crosstab, crosstab_long, pivot_values, top_share, won_lost
from tabulon.operators.reports import aggregate_by, count_by, counts_by_sets, mean_by, non_null_counts_by, outside_range


def test_correlation_uses_complete_pairs_only(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, None)], "a double, b double")
    assert correlation(df, ["a", "b"]).first().r is None
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (None, 100.0), (3.0, 6.5), (float("nan"), 1.0)], "a double, b double"
    )
    expected = float(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert math.isclose(correlation(df, ["a", "b"]).first().r, expected, rel_tol=1e-12)


def test_correlation_with_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "a int, b int")
    full = {(r.column_a, r.column_b): r.r for r in correlation(df, ["a", "b"], full=True).collect()}
    assert full[("a", "a")] == pytest.approx(1.0)
    assert full[("a", "b")] is None and full[("b", "a")] is None and full[("b", "b")] is None
    assert len(full) == 4


def test_crosstab_fills_absent_pairs_and_drops_null(spark):
    df = spark.createDataFrame(
        [("x", "p"), ("x", "p"), ("x", "q"), ("y", "q"), (None, "q"), ("y", None)], "k string, c string"
    )
    assert pivot_values(df, "c") == ["p", "q"]
    assert [tuple(r) for r in crosstab(df, "k", "c").collect()] == [("x", 2, 1), ("y", 0, 1)]
    assert [tuple(r) for r in crosstab(df, "k", "c", ["p", "z"]).collect()] == [("x", 2, 0), ("y", 0, 0)]


def test_top_share_lies_within_the_listed_keys(spark):
    data = [("a", "x")] * 3 + [("b", "x")] * 1 + [("c", "x")] * 1 + [("d", "y")]
    df = spark.createDataFrame(data, "k string, c string")
    found = [tuple(r) for r in top_share(df, "k", "c", "x", n=2).collect()]
    assert found == [("a", 3, 75.0), ("b", 1, 25.0)]
    none = top_share(df, "k", "c", "absent", n=2).collect()
    assert [(r.row_count, r.share_percent) for r in none] == [(0, None), (0, None)]


def test_won_lost_ignores_unmapped_results(spark):
    df = spark.createDataFrame([("gold", 1), ("gold", 0), ("gold", 2), ("iron", 1)], "rank string, won int")
    labelled = df.withColumn("won", map_values(F.col("won"), {0: "Lost", 1: "Won"}))
    rows = won_lost(labelled, "rank", "won", ["Won", "Lost"]).collect()
    assert [tuple(r) for r in rows] == [("gold", 1, 1), ("iron", 1, 0)]


def test_null_keys_are_dropped_on_request(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "k string, v int")
    assert [tuple(r) for r in count_by(df, ["k"], drop_null_keys=True).collect()] == [("a", 2)]
    assert count_by(df, ["k"]).count() == 2
    assert [tuple(r) for r in non_null_counts_by(df, "k").collect()] == [("a", 1)]


def test_mean_by_leaves_out_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0)], "k string, v double")
    rows = mean_by(df, ["k"], {"mean": "v"}, min_rows=2).collect()
    assert [tuple(r) for r in rows] == [("a", 1.5, 2)]


def test_outside_range_excludes_the_limits(spark):
    df = spark.createDataFrame([("a", 180.0), ("b", 190.0), ("c", 179.9), ("d", 190.1)], "k string, v double")
    means = aggregate_by(df, ["k"], {"m": F.avg("v")})
    assert [r.k for r in outside_range(means, "m", 180, 190).collect()] == ["c", "d"]


def test_crosstabs_of_many_values(spark):
    df = spark.range(3003).selectExpr("cast(id % 3 as string) as k", "cast(id % 1001 as int) as c")
    assert len(pivot_values(df, "c")) == 1001
    assert crosstab_long(df, "k", "c").agg({"row_count": "sum"}).first()[0] == 3003


def test_correlation_of_two_hundred_columns_with_nulls(spark):
    random = np.random.default_rng(7)
    values = random.normal(size=(700, 200)) + random.normal(size=(700, 1)) * np.linspace(0, 3, 200) + 1e6
    values[:, 5] = 3.25
    values[random.random(values.shape) < 0.2] = np.nan
    values[:, 7] = np.where(np.isnan(values[:, 8]), 4.0, 0.1)
    names = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in values], ", ".join(f"{n} double" for n in names)).repartition(6)
    frame = correlation(df, names)
    assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()
    found = {(r.column_a, r.column_b): r.r for r in frame.collect()}
    assert len(found) == 200 * 199 // 2
    for i, j in [(0, 1), (10, 190), (150, 151), (8, 9), (6, 199)]:
        both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
        assert found[names[i], names[j]] == pytest.approx(np.corrcoef(values[both, i], values[both, j])[0, 1], rel=1e-9)
    # Constant as a whole, and constant over the rows of a pair only.
    assert all(found[pair] is None for pair in found if "c5" in pair) and found["c7", "c8"] is None and found["c7", "c9"] is not None


def test_correlation_lists_its_pairs_without_rows(spark):
    empty = spark.createDataFrame([], "a double, b int")
    assert sorted(tuple(r) for r in correlation(empty, ["a", "b"], full=True).collect()) == [("a", "a", None), ("a", "b", None), ("b", "a", None), ("b", "b", None)]


def test_counts_by_sets_come_from_one_scan(spark):
    read = spark.sparkContext.accumulator(0)
    data = [("a", "x", 1, 2.0), ("a", "y", 2, 4.0), ("b", None, 3, None), (None, "x", 4, 1.0), ("a", "x", 5, 6.0), (None, None, 6, 9.0)]
    df = spark.createDataFrame(data, "k string, `c` string, set_id int, key0 double")

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    sets = [["k", "c"], ["c"], ["k"], ["k"], ["set_id"]]
    found = counts_by_sets(df.mapInArrow(passed, df.schema), sets, {"mean": F.avg("key0")}, keep_null_keys=[3])
    assert read.value == len(data)
    rows = [sorted((tuple(r) for r in f.collect()), key=repr) for f in found]
    assert rows[0] == [("a", "x", 2, 4.0), ("a", "y", 1, 4.0)]
    assert rows[1] == [("x", 3, 3.0), ("y", 1, 4.0)]
    assert rows[2] == [("a", 3, 4.0), ("b", 1, None)] and rows[3] == sorted([("a", 3, 4.0), ("b", 1, None), (None, 2, 5.0)], key=repr)
    assert len(rows[4]) == 6 and found[0].columns == ["k", "c", "row_count", "mean"]
