from __future__ import annotations

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tabulon.operators.tokens import explode_tokens, word_count, word_pairs


def python_words(text: str) -> list[str]:
    return [w for w in text.lower().replace("!", " ").replace(".", " ").split() if len(w) > 2]


def test_explode_drops_blank_tokens_and_null_cells(spark):
    df = spark.createDataFrame([(1, " ,c,"), (2, None), (3, "a, b"), (4, "")], "id int, g string")
    rows = explode_tokens(df, "g", "token").orderBy("id", "token").collect()
    assert [(r.id, r.token) for r in rows] == [(1, "c"), (3, "a"), (3, "b")]


def test_explode_takes_the_separator_literally(spark):
    df = spark.createDataFrame([("a|b.c",)], "g string")
    assert [r.t for r in explode_tokens(df, "g", "t", sep="|").collect()] == ["a", "b.c"]


def test_words_of_a_phrase(spark):
    df = spark.createDataFrame([("Hello!World. to the hello\tÉTÉ abc\x1cdef",)], "t string")
    assert sorted(r.word for r in word_pairs(df, "t").collect()) == sorted(
        ["hello", "world", "the", "hello", "été", "abc", "def"]
    )


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.text(alphabet="aBcÉß!. \t\n\r\x0b\x0c\x1c\x1f\x85     　-", max_size=40),
        min_size=1,
        max_size=8,
    )
)
def test_word_count_agrees_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = Counter(w for t in texts for w in python_words(t))
    assert {r.word: r.n for r in word_count(df, "t").collect()} == dict(expected)


def test_hot_word_is_combined_before_the_shuffle(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("t")
    )
    counted = word_count(df, "t", 3)
    assert counted.where("word = 'hot'").first().n == 6667
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
