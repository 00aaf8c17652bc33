"""The registered queries of the operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import classifier, fingerprints, jaccard_join, license_scan, mixing, packing, quality_rules, suffix_dedup, token_counts, url_filter
from tabulon.llm.common import table
from tabulon.llm.conversation_queries import CASES as CONVERSATION_CASES
from tabulon.llm.search_queries import CASES as SEARCH_CASES
from tabulon.llm.url_filter import UrlRule

URL_RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, "url", URL_RULES).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return judged.drop("text", "failed")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    per_row = copies.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return per_row.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), "text")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_notices(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model)
    held_out = classifier.id_remainder(F.col("doc_id")) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"), "doc_id", "text")


WS = r"[\x20\x09-\x0D]+"

OP1_SQL = """
with parts as (
  select page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
select page_id, host, path,
       (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
       coalesce((select verdict from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from parts
"""

OP2_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
win as (select doc_id, i, array_to_string(words[i:i + 4], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from win) where c > 1),
cov as (select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n
        from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from rep) group by doc_id),
m as (select w.doc_id, cast(len(words) as bigint) as n_words,
             cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
             cast(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) as bigint) as n_symbols,
             cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
             cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
             cast(len(list_filter(words, lambda x: list_contains([{", ".join(f"'{s}'" for s in dict.fromkeys(quality_rules.STOP_WORDS))}], rtrim(lower(x), '.,!?*$%&#')))) as bigint) as n_stop_words,
             cast(len(lines) as bigint) as n_lines
      from w left join cov using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed,
       not base_failed and n_symbols / word_chars <= 0.3 and n_stop_words / n_words >= 0.02
       and word_chars / n_words between 1.0 and 30.0 and n_dup_lines / n_lines <= 0.3 as kept
from b
"""

OP3_SQL = f"""
with d as (select row_number() over () as r, doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '')) as bigint) as size,
                  cast('0x' || substr(md5('{mixing.SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, source_size * 2 as cap from s),
f as (select *, ((sum(source_size) over () * 15 / 10.0) - coalesce(sum(cap) over earlier, 0)) / (sum(weight) over () - coalesce(sum(weight) over earlier, 0)) as level
      from r window earlier as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select level from f where cap >= level * weight order by cap / weight, source nulls last limit 1),
t as (select source, source_size, case when (select level from c) is null then cast(cap as double) else least(cast(cap as double), cast((select level from c) * weight as double)) end as target from f),
p as (select r, doc_id, d.source, size, key, source_size, target,
             cast(coalesce(sum(size) over (partition by d.source order by key, doc_id, size, r rows between unbounded preceding and 1 preceding), 0) as bigint) as start
      from d join t on d.source is not distinct from t.source),
packets as (select *, least({mixing.PACKET}, size - packet * {mixing.PACKET}) as words
            from (select p.*, copy, unnest(range(0, greatest(1, (size + {mixing.PACKET - 1}) // {mixing.PACKET}))) as packet from p, (values (0), (1)) c(copy))),
timed as (select *, case when target > 0 then cast(start + copy * source_size + packet * {mixing.PACKET} + words as double) / target else 0 end as finish from packets),
placed as (select *, coalesce(sum(words) over (order by finish, source nulls last, copy, key, doc_id, r, packet rows between unbounded preceding and 1 preceding), 0) as position from timed)
select doc_id, size, source_size, target, cast(sum(least(words, greatest(0, (select floor(sum(source_size) * 15 / 10) from s) - position))) as bigint) as taken
from placed group by r, doc_id, size, source_size, target
"""


def _values(rows) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return ", ".join(f"({quote(name)}, [{', '.join(quote(g) for g in grams)}])" for name, grams in rows)


OP8_SQL = f"""
with t(license, grams) as (values {_values((n, license_scan.template_bigrams(x)) for n, xs in license_scan.TEMPLATES.items() for x in xs)}),
l as (select doc_id, row_number() over () as line_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
w as (select doc_id, line_id, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') as words from l),
g as (select doc_id, line_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w where len(words) > 1),
s as (select doc_id, line_id, license, max(cast(len(list_intersect(g.grams, t.grams)) * 2 as double) / (len(g.grams) + len(t.grams))) as dice
      from g, t where len(list_intersect(g.grams, t.grams)) > 0 group by all)
select doc_id, license, max(dice) as dice, count(*) as n_lines from s where dice >= {license_scan.THRESHOLD} group by doc_id, license
"""

CASES = {
    "op1_url_filters": (op1_url_filters, OP1_SQL),
    "op2_quality_rules": (op2_quality_rules, OP2_SQL),
    "op3_mixing": (op3_mixing, OP3_SQL),
    "op4_packing": (op4_packing, None),
    "op5_token_counts": (op5_token_counts, None),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, None),
    "op7_suffix_array_dedup": (op7_suffix_array_dedup, None),
    "op8_license_scans": (op8_license_scans, OP8_SQL),
    "op9_quality_classifier": (op9_quality_classifier, None),
    "op10_document_fingerprints": (op10_document_fingerprints, None),
}
CASES |= CONVERSATION_CASES | SEARCH_CASES
