"""The registered query for conversations and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import conversation_repair
from tabulon.llm.common import table
from tabulon.llm.search_queries import crc32_sql


def op11_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def repaired(conversations: DataFrame) -> DataFrame:
    """A summary for every conversation of the table, those that the damage has left empty included."""
    messages = conversation_repair.damaged(conversations)
    told = conversation_repair.summary(messages, conversation_repair.repair(messages))
    every = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in conversation_repair.COUNTS]
    audit, digest = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    joined = every.join(told.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return joined.select("conv_id", *counts, audit, digest)


_KEY = crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")

#: The cheapest way to each state after each message, as its cost in 12 digits and its letters, so that the least text is the best way.
OP11_SQL = rf"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_KEY} % 20 as h from conversations),
m as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
             case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case h when 3 then 2 else 1 end)) as copy
      from c where h <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from m),
f as (select *, left(role, 1) as r, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
             not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut, lag(left(role, 1)) over (partition by conv_id order by i) as earlier from o),
t(p, letter, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, cost, letters) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
steps as (
  select conv_id, i, p, q, 3 as cost, 'D' as letter from f, (select p, q from inserts where cost = 0)
  union all select conv_id, i, p, q, cast(cut as integer), 'K' from f join t on t.letter = f.r where not blank and not seen
  union all select conv_id, i, p, q, 2 + cast(cut as integer), 'R' from f, t where not blank and not seen and t.letter in ('u', 'a')),
hops as (select s.conv_id, s.i, n.p, s.q, n.cost + s.cost as cost, n.letters || s.letter as letters from steps s join inserts n on n.q = s.p),
ways(conv_id, i, state, way) as (
  select distinct conv_id, cast(0 as bigint), 0, '000000000000' from m
  union all
  select w.conv_id, w.i + 1, h.q, min(lpad(cast(cast(left(w.way, 12) as bigint) + h.cost as varchar), 12, '0') || substr(w.way, 13) || h.letters)
  from ways w join hops h on h.conv_id is not distinct from w.conv_id and h.i = w.i + 1 and h.p = w.state group by w.conv_id, w.i, h.q),
totals as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) as n, count(*) filter (blank) as blank, count(*) filter (not blank and seen) as duplicate,
                  count(*) filter (not blank and not seen and cut) as truncated, count(*) filter (earlier is not null and earlier || r not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
best as (select w.conv_id, min(lpad(cast(cast(left(way, 12) as bigint) + e.cost as varchar), 12, '0') || substr(way, 13) || e.letters) as way
         from ways w join totals x on w.conv_id is not distinct from x.conv_id and w.i = x.n
         join (values (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) e(state, cost, letters) on e.state = w.state group by w.conv_id),
letters as (select conv_id, unnest(range(1, length(way) - 11)) as k, substr(way, 12 + k, 1) as letter from best),
numbered as (select *, count(*) filter (letter <> 'I') over (partition by conv_id order by k) as i, count(*) filter (letter <> 'D') over (partition by conv_id order by k) as out from letters),
outputs as (select numbered.*, f.role, f.text, f.r from numbered left join f on f.conv_id is not distinct from numbered.conv_id and f.i = numbered.i where letter <> 'D'),
named as (select *, out - cast(max(letter = 'K' and r = 's' and out = 1) over (partition by conv_id) as bigint) as place from outputs),
lines as (select conv_id, string_agg(case when letter = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by k) as body
          from named group by conv_id)
select e.conv_id, cast(coalesce(x.gaps, 0) as bigint) as gaps, coalesce(x.blank, 0) as blank, coalesce(x.duplicate, 0) as duplicate, coalesce(x.truncated, 0) as truncated,
       coalesce(x.illegal, 0) as illegal, cast(coalesce(left(b.way, 12), '0') as bigint) as cost, coalesce(substr(b.way, 13), '') as audit, sha256(coalesce(l.body, '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join totals x on x.conv_id is not distinct from e.conv_id
left join best b on b.conv_id is not distinct from e.conv_id left join lines l on l.conv_id is not distinct from e.conv_id
"""

CASES = {"op11_conversation_structure_repair": (op11_conversation_structure_repair, OP11_SQL)}
