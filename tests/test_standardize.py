from __future__ import annotations

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tabulon.functions import decade_of, map_values, rounded, token_array
from tabulon.operators.standardize import ColumnSpec, clean, standardize, with_year_and_decade

SPECS = [
    ColumnSpec("Day", "day", "date"),
    ColumnSpec("Votes", "votes", "double"),
    ColumnSpec("Count", "count", "int"),
    ColumnSpec("Name", "name", "text"),
    ColumnSpec("Url", "url", "raw"),
]
SCHEMA = "Day string, Votes string, Count string, Name string, Url string"


def test_malformed_cells_become_null(spark):
    raw = spark.createDataFrame(
        [("not a date", "x", "3.0", " a ", " u "), ("2021-13-01", "", "", "  ", None)], SCHEMA
    )
    assert [tuple(r) for r in standardize(raw, SPECS).collect()] == [
        (None, None, 3, "a", " u "),
        (None, None, None, "", None),
    ]


def test_good_cells_keep_their_values_and_types(spark):
    raw = spark.createDataFrame([("2021-02-03", "6.5", "12", "n", "u")], SCHEMA)
    typed = standardize(raw, SPECS)
    assert [t for _, t in typed.dtypes] == ["date", "double", "int", "string", "string"]
    assert tuple(typed.first()) == (datetime.date(2021, 2, 3), 6.5, 12, "n", "u")


@pytest.mark.parametrize("cells", [("bad", "1", "1"), ("2021-01-01", "x", "1"), ("2021-01-01", "1", "x")])
def test_strict_raises(spark, cells):
    raw = spark.createDataFrame([(*cells, "n", "u")], SCHEMA)
    with pytest.raises(PySparkException):
        standardize(raw, SPECS, strict=True).collect()


def test_unknown_kind_is_refused(spark):
    raw = spark.createDataFrame([("1",)], "A string")
    with pytest.raises(ValueError):
        standardize(raw, [ColumnSpec("A", "a", "decimal")])


def test_blank_text_is_kept_unless_asked(spark):
    df = spark.createDataFrame([(1, "  "), (2, None), (None, "x"), (3, "y")], "id int, title string")
    assert [r.id for r in clean(df, ["id", "title"]).orderBy("id").collect()] == [1, 3]
    strict = clean(df, ["id", "title"], blank_as_null=True, text_columns=["title"])
    assert [r.id for r in strict.collect()] == [3]


def test_year_and_decade(spark):
    df = spark.createDataFrame([(datetime.date(1999, 12, 31),), (datetime.date(2010, 1, 1),)], "d date")
    rows = with_year_and_decade(df, "d").orderBy("d").collect()
    assert [(r.release_year, r.decade) for r in rows] == [(1999, 1990), (2010, 2010)]


def test_decade_before_year_zero_rounds_down(spark):
    assert spark.range(1).select(decade_of(F.lit(-5)).alias("d")).first().d == -10


def test_map_values_gives_null_without_entry(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "x int")
    mapped = df.select(map_values(F.col("x"), {0: "Lost", 1: "Won"}).alias("y"))
    assert [r.y for r in mapped.collect()] == ["Lost", "Won", None, None]


def test_token_array_trims_and_drops_blanks(spark):
    df = spark.createDataFrame([(" ,c,",), ("a, b ,  c",), ("",), (None,)], "g string")
    tokens = df.select(token_array(F.col("g")).alias("t"), token_array(F.col("g"), keep_blank=True).alias("k"))
    assert [r.t for r in tokens.collect()] == [["c"], ["a", "b", "c"], [], None]
    assert [r.k for r in tokens.collect()][0] == ["", "c", ""]


def test_rounded_is_half_up_and_covers_every_double(spark):
    values = [2.675, -2.675, 0.005, 1e30, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r.r for r in df.select(rounded(F.col("v")).alias("r")).collect()]
    assert found == [2.68, -2.68, 0.01, 1e30, float("inf"), None]


def test_a_fraction_is_no_int(spark):
    df = spark.createDataFrame([("3.0",), ("3.7",), ("x",), ("nan",)], "c string")
    assert [r.n for r in standardize(df, [ColumnSpec("c", "n", "int")]).collect()] == [3, None, None, None]
