from __future__ import annotations

import math

import numpy as np
import pytest
from tabulon.operators import quantiles as module
from tabulon.operators.quantiles import quantiles

PROBS = [0.0, 0.001, 0.01, 0.25, 0.5, 0.9, 0.98, 0.999, 1.0]
RANDOM = np.random.default_rng(5)
CASES = {
    "third of all rows equal": [1.0] * 1500 + [float(x) for x in range(3000)],
    "ties at both ends": [1.0] * 4000 + [9.0] * 4000 + [3.0, 4.0, 5.5],
    "two values": [1.0] * 500 + [2.0] * 500,
    "heavy tail": list(np.exp(RANDOM.normal(0, 8, 4000))),
    "negative": list(-np.exp(RANDOM.normal(0, 8, 3000))) + [0.0] * 1500,
    "one value": [7.0] * 900,
    "few rows": [3.0, 1.0, 2.0],
}


@pytest.fixture
def many_passes(monkeypatch):
    """Brackets so small that the narrowing loop runs, with a first bracket that often misses."""
    monkeypatch.setattr(module, "SMALL", 50)
    monkeypatch.setattr(module, "MARGIN", 0.0001)


@pytest.mark.parametrize("name", list(CASES))
def test_narrowing_is_exact(spark, many_passes, name):
    values = sorted(CASES[name])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    found = quantiles(df, ["x"], PROBS)
    for p in PROBS:
        assert found["x", p] == values[max(1, math.ceil(len(values) * p)) - 1]


def test_linear_agrees_with_numpy(spark, many_passes):
    values = CASES["heavy tail"]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    found = quantiles(df, ["x"], [0.25, 0.5, 0.75], linear=True)
    for p in (0.25, 0.5, 0.75):
        assert math.isclose(found["x", p], float(np.quantile(values, p)), rel_tol=1e-12)


def test_small_columns_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double"
    )
    found = quantiles(df, ["a", "b"], [0.5], linear=True)
    assert found == {("a", 0.5): 2.0, ("b", 0.5): None}


def test_order_of_partitions_does_not_matter(spark):
    df = spark.range(5000).selectExpr("cast((id * 7919) % 5000 as double) as v")
    assert quantiles(df.repartition(1), ["v"], [0.3]) == quantiles(df.repartition(7), ["v"], [0.3])


def counting(spark, df):
    """The rows, and a counter of how often they were read."""
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(passed, df.schema), read


def test_two_scans_for_any_number_of_columns(spark):
    n = 40_000
    columns = {f"c{i}": f"cast((id * {7919 + 2 * i}) % {n} as double) / {i + 1} as c{i}" for i in range(6)}
    rows = spark.range(n).selectExpr(*columns.values())
    df, read = counting(spark, rows)
    found = quantiles(df, list(columns), [0.1, 0.25, 0.5, 0.75, 0.9])
    assert read.value == 2 * n
    for i in range(6):
        values = sorted(((x * (7919 + 2 * i)) % n) / (i + 1) for x in range(n))
        assert [found[f"c{i}", p] for p in (0.1, 0.5, 0.9)] == [values[math.ceil(n * p) - 1] for p in (0.1, 0.5, 0.9)]


def test_a_profile_takes_two_scans(spark):
    from tabulon.operators.profiles import numeric_profile

    df, read = counting(spark, spark.range(9000).selectExpr("cast(id as double) as a", "cast(id % 7 as int) as b", "cast(null as double) as c"))
    rows = {r.column_name: r for r in numeric_profile(df, ["a", "b", "c"]).collect()}
    assert read.value == 2 * 9000
    assert (rows["a"].p25, rows["a"].p50, rows["a"].max, rows["b"].value_count) == (2249.75, 4499.5, 8999.0, 9000)
    assert rows["a"]["mean"] == 4499.5 and rows["c"].value_count == 0 and rows["c"].p50 is None and rows["c"]["mean"] is None


def test_many_equal_rows_are_counted_and_not_kept(spark):
    values = [5.0] * 30_000 + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    searches = [module._Search("x", 15_000, 5.0, 5.0), module._Search("x", 100, 90.0, 110.0)]
    counts, kept = module._counted_and_kept(df, searches)
    assert counts["x", 5.0, 5.0] == (5, 30_001, 0, 0) and kept.count() == 19
