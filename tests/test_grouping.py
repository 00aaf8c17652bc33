from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tabulon.operators.grouping import (
    group_profile,
    group_stats,
    top_tokens_label,
    top_tokens_per_group,
)
from tabulon.operators.tokens import explode_tokens

SCHEMA = "id int, g string, vote double, pop double, year int, genre string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [
            (1, "en", 6.0, 10.0, 2000, "a, b"),
            (2, "en", 8.0, 20.0, 2001, "b, c, d"),
            (3, "en", 7.0, 30.0, 2003, "d"),
            (4, "fr", 5.0, 1.0, 1990, "z"),
            (5, "it", 5.0, 1.0, 1990, " , "),
        ],
        SCHEMA,
    )


def test_top_tokens_break_ties_by_token(rows):
    tokens = explode_tokens(rows, "genre", "t")
    found = top_tokens_per_group(tokens, "g", "t").orderBy("g", "token_rank").collect()
    assert [(r.g, r.t, r.token_count, r.token_rank) for r in found] == [
        ("en", "b", 2, 1),
        ("en", "d", 2, 2),
        ("en", "a", 1, 3),
        ("fr", "z", 1, 1),
    ]


def test_label_agrees_with_a_join_per_rank(rows):
    tokens = explode_tokens(rows, "genre", "t")
    ranked = (
        tokens.groupBy("g", "t")
        .count()
        .withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("count"), "t")))
    )
    sides = [ranked.where(f"r = {i}").select("g", F.col("t").alias(f"t{i}")) for i in (1, 2, 3)]
    joined = reduce(lambda a, b: a.join(b, "g", "left"), sides)
    expected = joined.select("g", F.concat_ws(" / ", "t1", "t2", "t3").alias("top_tokens"))
    assert sorted(top_tokens_label(tokens, "g", "t").collect()) == sorted(expected.collect())


def test_spread_of_one_row_is_null(rows):
    stats = {r.g: r for r in group_stats(rows, "g", "vote", "pop", "year").collect()}
    assert stats["fr"].std_vote is None
    assert tuple(stats["en"]) == ("en", 3, 7.0, 1.0, 20.0, 2001)


def test_groups_without_tokens(rows):
    tokens = explode_tokens(rows, "genre", "t")
    arguments = (rows, tokens, "g", "t", "vote", "pop", "year")
    assert [r.g for r in group_profile(*arguments).collect()] == ["en", "fr"]
    kept = group_profile(*arguments, keep_groups_without_tokens=True).collect()
    assert [(r.g, r.top_tokens) for r in kept] == [("en", "b / d / a"), ("fr", "z"), ("it", None)]
