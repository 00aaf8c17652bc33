"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import free_name, let, word_list

# The symbols that count, and frequent short words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by this are at from or an"
    " der die das und ist nicht von mit den ein eine zu im auf für sich des dem"
    " le la les de et un une du est que qui dans pour pas au par sur des"
    " el los las y en que se del con no una su para es al por lo como"
).split()
WINDOW = 5


class Rule(NamedTuple):
    name: str
    metric: str
    low: float | None
    high: float | None


#: A document is kept if each metric lies between its bounds (both included; None: no bound).
RULES = (
    Rule("words", "n_words", 10, None),
    Rule("repeats", "repeat_ratio", None, 0.2),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("stop words", "stop_ratio", 0.02, None),
    Rule("word length", "mean_word_chars", 1.0, 30.0),
    Rule("repeated lines", "dup_line_ratio", None, 0.3),
)


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of five words that the text has twice or more.

    Windows are sorted with their places, so equal ones are neighbours; the places of those are sorted again and
    each covers up to the next place, at most five words.
    """
    windows = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    places = let(
        F.sort_array(windows),
        lambda s: F.filter(
            F.transform(
                s,
                lambda x, j: F.when(
                    (F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        ),
    )
    covered = let(
        F.sort_array(places),
        lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x,
        ),
    )
    return covered


def measures(text: Column) -> Column:
    """Struct of the counts of one text; all 0 for null."""
    safe = F.coalesce(text, F.lit(""))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    lines = F.filter(F.split(safe, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
            (F.length(safe) - F.length(F.translate(safe, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.array_contains(stop, F.rtrim(F.lower(w), F.lit(".,!?*$%&#"))))).cast("bigint").alias("n_stop_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    return let(word_list(text), of_words)


def apply_rules(df: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows with their counts, base_failed, failed (names of the rules that are broken) and kept.

    Columns of those names are replaced, all others stay. Null and empty texts have no words and fail; a ratio over nothing is 0.
    Every word and line of a text of any length counts, in its task; equal rows get equal verdicts; an empty table gives none. The plan is a single projection.
    """
    added = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_lines".split()
    df = df.drop(*added, "base_failed", "failed", "kept")
    counts = free_name(df.columns, "counts")
    rows = df.withColumn(counts, measures(F.col(text))).select(*df.columns, f"{counts}.*")

    def ratio(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))

    metrics = {
        "n_words": F.col("n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }
    broken = []
    for rule in rules:
        value, tests = metrics[rule.metric], []
        if rule.low is not None:
            tests.append(value < rule.low)
        if rule.high is not None:
            tests.append(value > rule.high)
        for test in tests:
            broken.append(F.when(test, F.lit(rule.name)))
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    failed = F.array_distinct(F.array_compact(F.array(*broken))) if broken else F.array().cast("array<string>")
    return rows.withColumns({"base_failed": base, "failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )
