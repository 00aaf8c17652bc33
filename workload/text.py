"""Word count queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import tokens
from workload import fixtures as fx


def tokenize_words(spark, folder):
    """Every (word, 1) pair, told apart by document; listed as pairs per document and word."""
    pairs = tokens.word_pairs(fx.table(spark, folder, "documents"), "text", keep=["doc_id"])
    return pairs.groupBy("doc_id", "word").agg(F.sum("one").alias("pairs"))


def word_count(spark, folder):
    return tokens.word_count(fx.table(spark, folder, "documents"), "text")


# White space as Python's str.split() sees it; \s of this dialect knows the ASCII characters only.
_BREAKS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
_WORDS_SQL = f"""with words as (
    select doc_id, unnest(regexp_split_to_array(translate(lower(text), '!.', '  '), '{_BREAKS}')) as word
    from documents),
pairs as (select doc_id, word, 1 as one from words where length(word) > 2)
"""

CASES = {
    "tokenize_words": (
        tokenize_words,
        _WORDS_SQL + "select doc_id, word, count(*) as pairs from pairs group by doc_id, word",
    ),
    "word_count": (word_count, _WORDS_SQL + "select word, count(*) as n from pairs group by word"),
}
