"""Counts of the telemetry job that are made of finer ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tabulon.operators import quantiles
from tabulon.operators.reports import counts_by_sets, rolled_up
from tabulon.plans import telemetry, telemetry_report
from tabulon.plans.telemetry import TelemetryColumns


def test_rolled_up_groups_are_those_of_the_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), (None, "x", 4.0), ("a", "x", None), (None, None, 8.0)], "k string, l string, v double")
    (pair,) = counts_by_sets(df, [["k", "l"]], {"total": F.sum("v"), "n": F.count("v")}, [0])
    found = {tuple(r) for r in rolled_up(pair, ["k"], ["row_count", "total", "n"]).collect()}
    assert found == {("a", 3, 3.0, 2), (None, 2, 12.0, 2)}


def test_one_entry_per_row_and_pair(spark, monkeypatch):
    """Nulls in every column; only the pairs and the columns in none of them are grouped from the rows."""
    c = TelemetryColumns()
    names = ["dateid", "matchid", c.mode, c.map, c.objective, c.role, c.reason, c.duration, c.operator, c.weapon_type, c.primary, c.secondary, c.kills, c.rank, c.result]
    numbers = {"dateid", "matchid", c.kills, c.result}
    rows = []
    for i in range(240):
        row = [i % 3 if n == c.result else i if n in numbers else 180.0 + i % 7 if n == c.duration else f"{n}{(i * (j + 1)) % 5}" for j, n in enumerate(names)]
        row[2 + i % 13] = None
        rows.append(tuple(row))
    kinds = ", ".join(f"{n} {'int' if n in numbers else 'double' if n == c.duration else 'string'}" for n in names)
    df = spark.createDataFrame(rows, kinds)
    sets = []

    def noted(frame, keys, *more):
        sets.extend(keys)
        return counts_by_sets(frame, keys, *more)

    monkeypatch.setattr(telemetry, "counts_by_sets", noted)
    found = telemetry_report(df, c, share_reasons=["endroundreason0"])
    assert len(sets) == 8 and [len(s) for s in sets].count(2) == 6
    means = {r[c.map]: r.mean_duration for r in found["duration_by_map"].collect()}
    whole = {r[0]: r[1] for r in df.dropna(subset=[c.map]).groupBy(c.map).agg(F.avg(c.duration)).collect()}
    assert means == pytest.approx(whole)
    picks = {tuple(r) for r in found["picks_by_operator"].collect()}
    assert picks == {tuple(r) for r in df.dropna(subset=[c.operator]).groupBy(c.operator).count().collect()}
    values = {tuple(r) for r in found["distinct_values"].collect()}
    assert values == {(n, None if r[0] is None else str(r[0])) for n in (c.mode, c.map, c.rank, c.result) for r in df.select(n).distinct().collect()}
    top = {r.column_name: (r.value_count, r.distinct_count) for r in found["text_profile"].collect()}
    assert top[c.primary] == tuple(df.agg(F.count(c.primary), F.count_distinct(c.primary)).first())
    won = {r[c.rank]: (r.Lost, r.Won) for r in found["won_lost_by_rank"].collect()}
    counted = df.dropna(subset=[c.rank]).where(F.col(c.result).isin(0, 1)).groupBy(c.rank).agg(F.count_if(F.col(c.result) == 0), F.count_if(F.col(c.result) == 1))
    assert won == {r[0]: (r[1], r[2]) for r in counted.collect()}


def test_brackets_share_the_counts_of_their_ends(spark):
    brackets = [("v", 1.0, 3.0), ("v", 3.0, 3.0), ("v", 3.0, 9.0), ("v", float("-inf"), float("inf"))]
    assert len(quantiles._count_columns(brackets)) == 10
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 1, 2, 3, 3, 3, 5, 9, 12)] + [(None,)], "v double")
    row = df.agg(*quantiles._count_columns(brackets)).first().asDict()
    assert list(quantiles._listed(brackets, row).values()) == [(1, 2, 1, 3), (4, 3, 0, 0), (4, 3, 1, 1), (0, 0, 10, 0)]
