"""Every operator on the same odd tables: nulls in every column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import (
    classifier,
    conversation_repair,
    fingerprints,
    jaccard_join,
    license_scan,
    mixing,
    packing,
    periodic_runs,
    pivot_search,
    quality_rules,
    suffix_dedup,
    token_counts,
    url_filter,
)
from tabulon.llm.common import BYTES_AT_ONCE, small_batches
from tabulon.sources.shared import BATCH_BYTES

#: Names that operators use inside, as columns of the input.
CLASHES = "k h c z n spots null part block words _words _text _m _score runs collapsed row copy taken size position key id label labels edges place host rule kept".split()
LONG = "very long text " * 20_000
TEXTS = [None, "", " \n\t", "one", "same words here", "same words here", "Licensed under the MIT License.", LONG, "é 日本 \U0001f642 " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 4 else None, t, None if i % 3 else "s", f"http://a.net/{i}" if i % 2 else None, i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[3:6], "doc_id bigint, text string, source string, url string, turn bigint")
    return df.withColumns({name: F.when(F.col("turn") % 2 == 0, F.lit(name)) for name in CLASHES}).repartition(3)


def fitted(df):
    return classifier.fit(df, df.select("doc_id", (F.col("turn") % 2).cast("int").alias("quality")))


#: What each operator gives, and whether it has a row for each row of the input and keeps its columns.
OPERATORS = {
    "urls": (lambda df: url_filter.filter_urls(df, "url", [url_filter.UrlRule("block", "net", "/")]), True),
    "quality rules": (lambda df: quality_rules.apply_rules(df, "text"), True),
    "mixing": (lambda df: mixing.mix(df, "doc_id", "source", "text"), False),
    "mixed documents": (lambda df: mixing.mixed_documents(df), False),
    "packing": (lambda df: packing.pack(df, "doc_id", "text"), False),
    "token counts": (lambda df: token_counts.length_histogram(df, "text"), False),
    "near duplicates": (lambda df: jaccard_join.near_duplicates(df), False),
    "one per class": (lambda df: jaccard_join.one_per_class(df), False),
    "suffixes": (lambda df: suffix_dedup.remove_repeats(df), True),
    "texts without repeats": (lambda df: suffix_dedup.without_repeats(df), True),
    "licenses": (lambda df: license_scan.find_notices(df, "doc_id", "text"), False),
    "classifier": (lambda df: classifier.score(df, fitted(df)), True),
    "fingerprints": (lambda df: fingerprints.fingerprints(df, "text"), True),
    "edited": (lambda df: fingerprints.compare_with_edit(df, "doc_id", "text"), False),
    "runs": (lambda df: periodic_runs.find_runs(df, "text"), True),
    "conversations": (lambda df: conversation_repair.summary(df, conversation_repair.repair(df, "doc_id", "turn", "source", "text"), "doc_id", "turn", "source", "text"), False),
    "top k": (lambda df: pivot_search.top_k(pivot_search.build_index(df.withColumn("v", F.array(F.length("text"), "turn")), "doc_id", "v"), 2, 2), False),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows_and_clashing_names(odd, name):
    operator, keeps_rows = OPERATORS[name]
    found = operator(odd)
    rows = found.collect()
    if keeps_rows:
        assert len(rows) == odd.count()
        added = set(found.columns) - set(odd.columns)
        replaced = {"host", "rule", "kept", "runs", "collapsed"}
        assert all({r[c] for r in rows} <= {c, None} for c in CLASHES if c not in replaced) and (added or name == "texts without repeats" or name == "runs")
    assert operator(odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_table_of_nulls(spark, name):
    nulls = spark.createDataFrame([(None,) * 5] * 3, "doc_id bigint, text string, source string, url string, turn bigint")
    OPERATORS[name][0](nulls).collect()


def test_tasks_take_rows_of_few_bytes_at_a_time():
    rows = pa.RecordBatch.from_pydict({"id": range(3000), "text": ["x" * 2000] * 2999 + ["y" * 3_000_000]})
    parts = list(small_batches([rows, rows.slice(0, 0)]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([rows]))
    assert len(parts) > 5 and max(p.num_rows for p in parts) <= 400


def test_join_gets_rows_of_few_bytes_from_spark(spark, monkeypatch):
    """Not only the slices: the batch that they are cut from would be held whole, in the task and in its worker."""

    def checked(batches):
        for batch in batches:
            if batch.nbytes > 2 * BYTES_AT_ONCE:
                raise ValueError(f"a batch of {batch.nbytes} bytes")
            yield batch

    monkeypatch.setattr(jaccard_join, "small_batches", checked)
    before = spark.conf.get(BATCH_BYTES, None)
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" some words of a text"), 10_000)).alias("text"))
    found = jaccard_join.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == [(i, i, 0) for i in range(40)]
    assert spark.conf.get(BATCH_BYTES, None) == before
