"""Periodic runs and top-k search against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import periodic_runs, pivot_search, search_queries


def brute_runs(words):
    """Every maximal stretch, diagonal by diagonal; a stretch found with a smaller period stays with it."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(1, 6), st.integers(1, 12), st.randoms(use_true_random=False)), min_size=1, max_size=4))
def test_runs_of_several_texts_at_once(shapes):
    texts = []
    for n, kinds, period, draw in shapes:
        text = [draw.randrange(kinds) for _ in range(n)]
        a = draw.randrange(n) if n else 0
        texts.append([text[i] if i < a else text[a + (i - a) % min(period, n - a)] for i in range(n)])
    codes = np.array([w for t in texts for w in t], np.int64)
    found = periodic_runs.runs_of(codes, np.array([len(t) for t in texts], np.int64))
    assert found == [brute_runs(t) for t in texts]


def test_each_lag_has_a_gram_within_its_guaranteed_overlap():
    for low, high, width in periodic_runs.lag_classes(5000):
        assert all(2 * width - 1 <= periodic_runs.overlap(lag) for lag in range(low, high))


def test_runs_of_a_long_text_stay_in_proportion():
    codes = np.zeros(400_000, np.int64)
    codes[200_000] = 1
    assert periodic_runs.runs_of(codes, np.array([400_000])) == [[(0, 200_000, 1), (200_001, 199_999, 1)]]


TEXTS = [None, "", " \t\n", "a b c " * 9, "x " * 11, "x " * 12, "one two three four", "q " + "a b\n" * 3000 + "c d e " * 5, "ab\x1ccd " * 12, "a b c " * 9]


def test_find_runs_whole_texts_and_clashing_names(spark):
    rows = [(i, t, "r", "c", "t", 5) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "r", "c", "t", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, body string, runs string, collapsed string, text string, _text int").repartition(3)
    found = periodic_runs.find_runs(df, "body")
    assert found.columns == ["doc_id", "body", "text", "_text", "runs", "collapsed"]
    for row in found.collect():
        words = words_of(row.body)
        runs = brute_runs(words) if len(words) < 500 else [tuple(r) for r in row.runs]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(r) for r in row.runs] == runs
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone) and row.text == "t" and row._text == 5
        if len(words) > 500:
            assert runs == [(1, 6000, 2), (6001, 15, 3)]
    assert periodic_runs.find_runs(df.limit(0), "body").count() == 0
    assert periodic_runs.summary(periodic_runs.find_runs(df, "body")).count() == len(rows)


def test_summary_and_planted_runs_against_plain_python(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([0, 1, 5, 60, 200])))) for i in range(300)] + [(None, "a " * 20), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    planted = df.select("doc_id", periodic_runs.with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    expected = []
    for doc_id, text in rows:
        words = words_of(text)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
        facts = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        expected.append((doc_id, len(runs), *facts, *digests))
    found = periodic_runs.summary(periodic_runs.find_runs(planted, "text"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert any(e[1] for e in expected) and found.columns[-2:] == ["runs_sha256", "collapsed_sha256"]


def brute_top(rows, k, modulus):
    usable = [(i, key, [int(np.floor(float(x) * 256)) for x in v]) for i, (key, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, key, q in usable:
        if key is None or key % modulus:
            continue
        others = [(-sum(a * b for a, b in zip(q, x)), other is None, other or 0, other) for j, other, x in usable if j != i]
        out += [(key, rank, other, -score) for rank, (score, _, _, other) in enumerate(sorted(others, key=lambda o: o[:3])[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed, n, dims):
    """Clusters, scattered vectors, one vector that a third of the rows share, and rows that take no part."""
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centers[i % 6] + draw.normal(scale=0.02 if i % 6 < 3 else 1.0, size=dims)
        rows.append((int(i), [float(x) for x in (centers[0] if i % 3 == 0 else v / np.linalg.norm(v) * (1 + i % 2))]))
    bad = [(10, None), (20, [None] * dims), (30, [float("nan")] * dims), (40, [float("inf")] + [0.0] * (dims - 1))]
    return rows + bad + [(None, rows[1][1]), (50, rows[50][1]), (50, rows[50][1]), (60, []), (61, [1.0]), (70, [0.0] * dims)]


@pytest.mark.parametrize(("seed", "dims", "block", "queries"), [(1, 8, 16, 5), (2, 3, 1024, 512), (3, 16, 7, 3)])
def test_top_k_is_exact(spark, seed, dims, block, queries):
    rows = vectors(seed, 400, dims)
    df = spark.createDataFrame([(k, v, 1, "p") for k, v in rows], "vec_id bigint, embedding array<double>, id int, pivot string").repartition(5)
    index = pivot_search.build_index(df, pivots=9, block=block)
    found = pivot_search.top_k(index, 5, 10, queries)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_top(rows, 5, 10)
    assert index.blocks.agg(F.sum("n"), F.max("n")).first()[1] <= block


def test_top_k_of_few_rows_and_none(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0]), (50, [2.0]), (7, [-1.0])], [(0, []), (50, [])], [(1, [1.0])]):
        index = pivot_search.build_index(spark.createDataFrame(rows, kind))
        assert sorted(map(tuple, pivot_search.top_k(index, 5, 50).collect()), key=repr) == brute_top(rows, 5, 50)


def test_top_k_of_very_large_components(spark):
    rows = [(i, [float((i * 7919 % 101 - 50) * 10.0**e) for e in (3, 12, 14)]) for i in range(60)]
    index = pivot_search.build_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), pivots=4, block=8)
    limit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    # Scores outside 64 bits are equal there, and then the smaller id comes first.
    whole = [(k, [int(np.floor(x * 256)) for x in v]) for k, v in rows]
    expected = []
    for key, q in whole:
        if key % 10 == 0:
            scored = sorted((-limit(sum(a * b for a, b in zip(q, x))), other) for other, x in whole if other != key)[:3]
            expected += [(key, rank, other, -score) for rank, (score, other) in enumerate(scored, 1)]
    assert sorted(map(tuple, pivot_search.top_k(index, 3, 10).collect())) == sorted(expected)


def test_annuli_of_tight_clusters_are_passed_over(spark):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(10, 12)) * 4
    rows = [(i, [float(x) for x in centers[i % 10] + draw.normal(scale=0.01, size=12)]) for i in range(3000)]
    index = pivot_search.build_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), pivots=10, block=50)
    chunks = pivot_search._chunks(pivot_search._queries(index, 50, 5), index.dims, 10)
    ranges = pivot_search._ranges(index, chunks)
    blocks = index.blocks.select("pivot", "near", "far")
    met = ranges.join(blocks, "pivot").where("near <= high and far >= low").count()
    assert met < 0.4 * chunks.count() * blocks.count()


def test_queries_have_their_columns(spark, small):
    runs = search_queries.op12_periodic_run_detection(spark, small)
    assert dict(runs.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    found = search_queries.op13_exact_top_k_search(spark, small)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
