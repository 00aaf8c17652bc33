"""Registered queries for repeated words, conversations and vectors, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import periodic_runs, pivot_search
from tabulon.llm.common import table

WS = r"[\x20\x09-\x0D]+"
TOP = 5
QUERY_IDS = 50


def op12_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", periodic_runs.with_planted_runs(F.col("doc_id"), F.col("text")))
    return periodic_runs.summary(periodic_runs.find_runs(planted, "text"))


def op13_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = pivot_search.build_index(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pivot_search.top_k(index, TOP, QUERY_IDS)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    step = "lambda v, z: xor(v >> 1, 3988292384 * (v & 1))"
    byte = f"lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], {step})"
    codes = f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))"
    return f"xor(list_reduce({codes}, {byte}, cast(4294967295 as bigint)), 4294967295)"


#: A run has 6 equal pairs of words on its diagonal at least, so its 6-grams meet again one period later.
OP12_SQL = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '') as w0, {crc32_sql("cast(doc_id as varchar)")} as h from documents),
k as (select doc_id, w0, h % 10 = 0 and len(w0) > 0 as planted, h // 10 as g, cast(len(w0) as bigint) as n from d),
a as (select *, case when planted then g % n else 0 end as a from k),
p as (select *, case when planted then 1 + (n - a) // (3 + g % 8) else 1 end as p from a),
w as (select doc_id, n, case when planted then list_transform(range(0, n), lambda i: w0[1 + case when i < a then i else a + (i - a) % p end]) else w0 end as words from p),
grams as (select doc_id, i, array_to_string(words[i + 1:i + 6], ' ') as gram from (select doc_id, words, unnest(range(0, n - 5)) as i from w)),
pairs as (select x.doc_id, x.i, y.i - x.i as lag from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i),
islands as (select *, i - row_number() over (partition by doc_id, lag order by i) as island from pairs),
stretches as (select doc_id, lag as period, min(i) as start, count(*) + 5 + lag as length from islands group by doc_id, lag, island),
runs as (select doc_id, start, length, min(period) as period from stretches where length >= greatest(12, 2 * period) group by doc_id, start, length),
ranked as (select *, row_number() over (partition by doc_id order by length desc, start, period) as place from runs),
r as (select doc_id, count(*) as n_runs, max(start) filter (place = 1) as start, max(length) filter (place = 1) as length, max(period) filter (place = 1) as period,
             string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from ranked group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
lists as (select doc_id, list(i) as gone from gone group by doc_id),
kept as (select w.doc_id, case when lists.gone is null then words else list_transform(list_filter(range(0, n), lambda i: not list_contains(lists.gone, i)), lambda i: words[i + 1]) end as words
         from w left join lists using (doc_id))
select kept.doc_id, coalesce(n_runs, 0) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length, cast(period as bigint) as period,
       cast(1000 * length // period as bigint) as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(array_to_string(words, ' ')) as collapsed_sha256
from kept left join r using (doc_id)
"""

OP13_SQL = f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r as qr, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, 1 + least(len(q.e), len(c.e))), lambda i: q.e[i] * c.e[i])) as bigint) as score
      from v q join v c on q.r <> c.r where q.vec_id % {QUERY_IDS} = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by qr order by score desc, vec_id nulls last) as rank from s) where rank <= {TOP}
"""

CASES = {
    "op12_periodic_run_detection": (op12_periodic_run_detection, OP12_SQL),
    "op13_exact_top_k_search": (op13_exact_top_k_search, OP13_SQL),
}
