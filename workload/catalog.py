"""Catalog queries: typing, cleaning, quality, counts, means, rankings, groups and similar rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import token_array
from tabulon.operators import grouping, quality, reports
from tabulon.operators.features import with_log_columns
from tabulon.operators.similar import recommend
from tabulon.operators.tokens import explode_tokens
from tabulon.plans.catalog import (
    OUTLIER_METRICS,
    RANKING_COLUMNS,
    REQUIRED,
    TEXT_COLUMNS,
    catalog_report,
)
from tabulon.plans.clustering import feature_input
from tabulon.plans.output import write_reports
from tabulon.sources import read_delimited, register_views, write_delimited
from tabulon.sources.shared import new_path
from workload import fixtures as fx
from workload.fixtures import ITEMS_SQL, TOKENS_SQL, TYPED_SQL
from workload.fixtures import rounded_sql as r

MIN_VOTES = 5
PROBES = ["Customer#000000001", "customer#000000042", "nope"]


def _by_popularity():
    return [F.desc("popularity"), "item_id"]


def standardize(spark, folder):
    return fx.typed(spark, folder)


def clean_rows(spark, folder):
    return fx.items(spark, folder).select("item_id", "title", "release_date", "release_year", "decade")


def explode_genres(spark, folder):
    return fx.item_tokens(spark, folder).select("item_id", "genre_name")


def genre_array(spark, folder):
    tokens = token_array(F.col("genre"))
    return fx.items(spark, folder).select(
        "item_id", F.size(tokens).alias("tokens"), F.array_join(tokens, "|").alias("joined")
    )


def log_features(spark, folder):
    logged = with_log_columns(fx.items(spark, folder), ["popularity", "vote_count"])
    return logged.select(
        "item_id",
        F.round("log_popularity", 9).alias("log_popularity"),
        F.round("log_vote_count", 9).alias("log_vote_count"),
    )


def light_view(spark, folder):
    return feature_input(fx.items(spark, folder)).drop(
        "genre_array", "overview", "poster_url", "decade", "log_popularity", "log_vote_count"
    )


def count_by_genre(spark, folder):
    return reports.count_by(fx.item_tokens(spark, folder), ["genre_name"], "movie_count")


def avg_vote_by_genre(spark, folder):
    return reports.mean_by(
        fx.item_tokens(spark, folder),
        ["genre_name"],
        {"avg_vote": "vote_average", "avg_popularity": "popularity"},
        "movie_count",
        min_rows=50,
    )


def count_by_language(spark, folder):
    return reports.count_by(fx.items(spark, folder), ["original_language"], "movie_count")


def count_by_year(spark, folder):
    return reports.count_by(fx.items(spark, folder), ["release_year"], "movie_count")


def count_by_year_since(spark, folder):
    recent = fx.items(spark, folder).where(F.col("release_year") >= 1998)
    return reports.count_by(recent, ["release_year"], "movie_count").orderBy("release_year")


def count_by_decade(spark, folder):
    return reports.mean_by(
        fx.items(spark, folder), ["decade"], {"avg_vote": "vote_average"}, "movie_count"
    )


def count_over_view(spark, folder):
    register_views(items=fx.items(spark, folder), item_tokens=fx.item_tokens(spark, folder))
    return spark.sql(
        "select original_language, genre_name, count(*) as movie_count from item_tokens"
        " group by original_language, genre_name"
    )


def catalog_summary(spark, folder):
    rows = fx.kept_items(spark, folder)
    return reports.summary(
        rows,
        explode_tokens(rows, "genre", "genre_name"),
        token="genre_name",
        language="original_language",
        year="release_year",
        vote="vote_average",
        popularity="popularity",
    )


def missing_values(spark, folder):
    return quality.missing_values(fx.typed(spark, folder), REQUIRED, TEXT_COLUMNS)


def outlier_thresholds(spark, folder):
    return quality.outlier_thresholds(fx.kept_items(spark, folder), OUTLIER_METRICS)


def outlier_examples(spark, folder):
    examples = quality.outlier_examples(
        fx.kept_items(spark, folder), OUTLIER_METRICS, ["item_id", "title", "genre"], "item_id"
    )
    return examples.withColumn("distance_from_bound", F.round("distance_from_bound", 6))


EVENT_METRICS = {"value": "A far value can dominate a mean."}


def event_outlier_thresholds(spark, folder):
    return quality.outlier_thresholds(fx.table(spark, folder, "events"), EVENT_METRICS)


def event_outlier_examples(spark, folder):
    examples = quality.outlier_examples(
        fx.table(spark, folder, "events"), EVENT_METRICS, ["event_id", "event_type"], "event_id"
    )
    return examples.withColumn("distance_from_bound", F.round("distance_from_bound", 6))


def top_popular(spark, folder):
    return reports.top_rows(
        fx.items(spark, folder), _by_popularity(), 20, ["item_id", *RANKING_COLUMNS]
    )


def high_quality_top(spark, folder):
    voted = fx.items(spark, folder).where(F.col("vote_count") >= MIN_VOTES)
    return reports.top_rows(
        voted, [F.desc("vote_average"), *_by_popularity()], 20, ["item_id", *RANKING_COLUMNS]
    )


def top_genres(spark, folder):
    return count_by_genre(spark, folder).limit(3)


def top_languages(spark, folder):
    return count_by_language(spark, folder).limit(10)


def top_rated_genres(spark, folder):
    return avg_vote_by_genre(spark, folder).limit(4)


def group_stats(spark, folder):
    return grouping.group_stats(
        fx.items(spark, folder), "original_language", "vote_average", "popularity", "release_year"
    )


def token_counts_by_group(spark, folder):
    return grouping.token_counts(fx.item_tokens(spark, folder), "original_language", "genre_name")


def top_tokens_per_group(spark, folder):
    return grouping.top_tokens_per_group(
        fx.item_tokens(spark, folder), "original_language", "genre_name"
    )


def top_tokens_label(spark, folder):
    return grouping.top_tokens_label(fx.item_tokens(spark, folder), "original_language", "genre_name")


def group_profile(spark, folder):
    rows = fx.kept_items(spark, folder)
    return grouping.group_profile(
        rows,
        explode_tokens(rows, "genre", "genre_name"),
        "original_language",
        "genre_name",
        "vote_average",
        "popularity",
        "release_year",
    )


def recommend_similar(spark, folder):
    return recommend(
        fx.kept_items(spark, folder),
        PROBES,
        group="original_language",
        title="title",
        id_column="item_id",
        order=["vote_average", "popularity"],
        output=["item_id", "title", "release_year", "genre", "vote_average", "popularity"],
    )


def union_by_name(spark, folder):
    """Two one-sided lists with their columns in different order, stacked by name."""
    rows = fx.items(spark, folder)
    early = rows.where(F.col("decade") < 2000).select("item_id", "title", "vote_average")
    late = rows.where(F.col("decade") >= 2000).select("vote_average", "item_id", "title")
    return reports.stack_by_name([early, late])


def catalog_job(spark, folder):
    """The statistics job as a whole, from a written CSV to its eleven saved reports: one row per report cell, read back from the saved files."""
    job = new_path(spark, "catalog-job")
    write_delimited(fx.catalog_raw(spark, folder), f"{job}/raw")
    raw = read_delimited(spark, f"{job}/raw").withColumn("item_id", F.col("item_id").cast("bigint"))
    found = catalog_report(raw, fx.ITEM_COLUMNS, min_votes=MIN_VOTES)
    if set(found) != set(JOB_REPORTS):
        raise ValueError(f"reports without a listing: {sorted(set(found) ^ set(JOB_REPORTS))}")
    write_reports(found, f"{job}/reports")
    saved = {name: read_delimited(spark, f"{job}/reports/{name}", columns=frame.columns) for name, frame in found.items()}
    return reports.stack_by_name([cells(saved[name], name, *listed) for name, listed in JOB_REPORTS.items()])


def cells(frame, name, keys, numbers, texts):
    """(report, key, column_name, value, text): one row per cell, numbers in value, other cells in text."""
    nothing = {"value": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    cells = [
        F.struct(F.lit(c).alias("column_name"), *[(cell if kind == k else nothing[k]).alias(k) for k in nothing])
        for kind, columns in (("value", numbers), ("text", texts))
        for c in columns
        for cell in [F.round(F.col(c).cast("double"), 6) if kind == "value" else F.col(c)]
    ]
    return frame.select(F.lit(name).alias("report"), F.concat_ws("|", *keys).alias("key"), F.inline(F.array(*cells)))


# Every report of the job: the columns of its key, its numbers and its other cells.
_RANKING_CELLS = (
    ["title", "release_year", "genre"],
    ["popularity", "vote_average", "vote_count"],
    ["original_language"],
)
JOB_REPORTS = {
    "summary": (
        [],
        [
            "movies_after_cleaning",
            "movie_genre_rows",
            "distinct_languages",
            "distinct_genres",
            "min_release_year",
            "max_release_year",
            "typed_columns",
            "avg_vote",
            "avg_popularity",
        ],
        [],
    ),
    "films_by_genre": (["genre_name"], ["movie_count"], []),
    "avg_vote_by_genre": (["genre_name"], ["avg_vote", "avg_popularity", "movie_count"], []),
    "films_by_language": (["original_language"], ["movie_count"], []),
    "films_by_year": (["release_year"], ["movie_count"], []),
    "films_by_decade": (["decade"], ["movie_count", "avg_vote"], []),
    "top_popular_movies": _RANKING_CELLS,
    "high_quality_popular_movies": _RANKING_CELLS,
    "data_quality_missing_values": (["column_name"], ["total_rows", "missing_count", "missing_percent"], ["why_problem"]),
    "data_quality_outlier_thresholds": (
        ["metric"],
        ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count"],
        ["rule", "why_check_this_metric"],
    ),
    "data_quality_outlier_examples": (
        ["metric", "title", "genre"],
        ["release_year", "metric_value", "lower_bound", "upper_bound", "distance_from_bound"],
        ["original_language", "outlier_side", "why_outlier"],
    ),
}


def cells_sql(name: str, sql: str, keys: list[str], numbers: list[str], texts: list[str]) -> str:
    key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    cells = [(c, f"round(cast({c} as double), 6)", "cast(null as varchar)") for c in numbers]
    cells += [(c, "cast(null as double)", c) for c in texts]
    return "\nunion all\n".join(
        f"select '{name}' as report, {key} as key, '{c}' as column_name, {value} as value, {text} as text from ({sql})"
        for c, value, text in cells
    )


STATS_SQL = f"""stats as (
    select original_language, count(*) as row_count, {r('avg(vote_average)')} as avg_vote,
           {r('stddev_samp(vote_average)')} as std_vote, {r('avg(popularity)')} as avg_popularity,
           cast({r('avg(release_year)', 0)} as int) as avg_release_year
    from items group by original_language)"""

RANKED_SQL = """ranked as (
    select original_language, genre_name, token_count, cast(row_number() over (
               partition by original_language order by token_count desc, genre_name) as int) as token_rank
    from (select original_language, genre_name, count(*) as token_count
          from item_tokens group by original_language, genre_name)),
labels_by_group as (
    select original_language, string_agg(genre_name, ' / ' order by token_rank) as top_tokens
    from ranked where token_rank <= 3 group by original_language)"""


def thresholds_sql(source: str, metrics: dict[str, str]) -> str:
    parts = [
        f"""select '{m}' as metric, {r('q1')} as q1, {r('q3')} as q3, {r('q3 - q1')} as iqr,
       {r('q1 - 1.5e0 * (q3 - q1)')} as lower_bound, {r('q3 + 1.5e0 * (q3 - q1)')} as upper_bound,
       (select count(*) from {source} s
        where s.{m} < q1 - 1.5e0 * (q3 - q1) or s.{m} > q3 + 1.5e0 * (q3 - q1)) as outlier_count,
       '{quality.IQR_RULE}' as rule, '{reason}' as why_check_this_metric
from (select cast(quantile_disc({m}, 0.25) as double) as q1, cast(quantile_disc({m}, 0.75) as double) as q3
      from {source})"""
        for m, reason in metrics.items()
    ]
    return "\nunion all\n".join(parts)


def examples_sql(source: str, metrics: dict[str, str], keep: str, tie_breaker: str) -> str:
    parts = [
        f"""select * from (
select '{m}' as metric, {keep}, cast({m} as double) as metric_value,
       {r('lo')} as lower_bound, {r('hi')} as upper_bound,
       case when {m} < lo then 'low' else 'high' end as outlier_side,
       round(case when {m} < lo then lo - {m} else {m} - hi end, 6) as distance_from_bound,
       '{reason}' as why_outlier
from {source}, (select q1 - 1.5e0 * (q3 - q1) as lo, q3 + 1.5e0 * (q3 - q1) as hi
                from (select cast(quantile_disc({m}, 0.25) as double) as q1,
                             cast(quantile_disc({m}, 0.75) as double) as q3 from {source}))
where {m} < lo or {m} > hi
order by case when {m} < lo then lo - {m} else {m} - hi end desc, {tie_breaker} limit 20)"""
        for m, reason in metrics.items()
    ]
    return "\nunion all\n".join(parts)


def missing_sql() -> str:
    parts = []
    for column, reason in REQUIRED.items():
        test = f"{column} is null"
        if column in TEXT_COLUMNS:
            test += f" or trim({column}) = ''"
        missing = f"count(*) filter (where {test})"
        parts.append(
            f"select '{column}' as column_name, count(*) as total_rows, {missing} as missing_count,"
            f" {r(f'{missing} / cast(count(*) as double) * 100')} as missing_percent,"
            f" '{reason}' as why_problem from typed"
        )
    return "\nunion all\n".join(parts)


RANKING_LIST = ", ".join(["item_id", *RANKING_COLUMNS])
GENRE_COUNT_SQL = "select genre_name, count(*) as movie_count from item_tokens group by genre_name"
LANGUAGE_COUNT_SQL = (
    "select original_language, count(*) as movie_count from items group by original_language"
)
YEAR_COUNT_SQL = "select release_year, count(*) as movie_count from items"
RATED_SQL = f"""select genre_name, {r('avg(vote_average)')} as avg_vote,
       {r('avg(popularity)')} as avg_popularity, count(*) as movie_count
from item_tokens group by genre_name having count(*) >= 50"""

_typed, _items, _tokens = f"with {TYPED_SQL}\n", f"with {ITEMS_SQL}\n", f"with {TOKENS_SQL}\n"

CASES = {
    "standardize": (standardize, _typed + "select * from typed"),
    "clean_rows": (
        clean_rows,
        _items + "select item_id, title, release_date, release_year, decade from items",
    ),
    "explode_genres": (explode_genres, _tokens + "select item_id, genre_name from item_tokens"),
    "genre_array": (
        genre_array,
        _tokens
        + """select item_id, cast(count(*) as int) as tokens, string_agg(genre_name, '|' order by place) as joined
from (select item_id, trim(unnest(string_split(genre, ','))) as genre_name,
             unnest(range(len(string_split(genre, ',')))) as place from items)
where genre_name <> '' group by item_id""",
    ),
    "log_features": (
        log_features,
        _items
        + """select item_id, round(ln(1 + popularity), 9) as log_popularity,
       round(ln(1 + cast(vote_count as double)), 9) as log_vote_count from items""",
    ),
    "light_view": (
        light_view,
        _items
        + """select item_id, title, release_date, release_year, genre, vote_average, popularity, vote_count,
       original_language from items""",
    ),
    "count_by_genre": (count_by_genre, _tokens + GENRE_COUNT_SQL),
    "avg_vote_by_genre": (avg_vote_by_genre, _tokens + RATED_SQL),
    "count_by_language": (count_by_language, _items + LANGUAGE_COUNT_SQL),
    "count_by_year": (count_by_year, _items + YEAR_COUNT_SQL + " group by release_year"),
    "count_by_year_since": (
        count_by_year_since,
        _items + YEAR_COUNT_SQL + " where release_year >= 1998 group by release_year",
    ),
    "count_by_decade": (
        count_by_decade,
        _items
        + f"select decade, count(*) as movie_count, {r('avg(vote_average)')} as avg_vote"
        + " from items group by decade",
    ),
    "count_over_view": (
        count_over_view,
        _tokens
        + "select original_language, genre_name, count(*) as movie_count from item_tokens"
        + " group by original_language, genre_name",
    ),
    "catalog_summary": (
        catalog_summary,
        _tokens
        + f"""select count(*) as row_count, (select count(*) from item_tokens) as token_rows,
       cast(12 as bigint) as typed_columns, count(distinct original_language) as distinct_languages,
       (select count(distinct genre_name) from item_tokens) as distinct_tokens,
       min(release_year) as min_release_year, max(release_year) as max_release_year,
       {r('avg(vote_average)')} as avg_vote, {r('avg(popularity)')} as avg_popularity from items""",
    ),
    "missing_values": (missing_values, _typed + missing_sql()),
    "outlier_thresholds": (outlier_thresholds, _items + thresholds_sql("items", OUTLIER_METRICS)),
    "outlier_examples": (
        outlier_examples,
        _items + examples_sql("items", OUTLIER_METRICS, "item_id, title, genre", "item_id"),
    ),
    "event_outlier_thresholds": (event_outlier_thresholds, thresholds_sql("events", EVENT_METRICS)),
    "event_outlier_examples": (
        event_outlier_examples,
        examples_sql("events", EVENT_METRICS, "event_id, event_type", "event_id"),
    ),
    "top_popular": (
        top_popular,
        _items + f"select {RANKING_LIST} from items order by popularity desc, item_id limit 20",
    ),
    "high_quality_top": (
        high_quality_top,
        _items
        + f"select {RANKING_LIST} from items where vote_count >= {MIN_VOTES}"
        + " order by vote_average desc, popularity desc, item_id limit 20",
    ),
    "top_genres": (
        top_genres,
        _tokens + GENRE_COUNT_SQL + " order by movie_count desc, genre_name limit 3",
    ),
    "top_languages": (
        top_languages,
        _items + LANGUAGE_COUNT_SQL + " order by movie_count desc, original_language limit 10",
    ),
    "top_rated_genres": (
        top_rated_genres,
        _tokens + RATED_SQL + " order by avg_vote desc, movie_count desc, genre_name limit 4",
    ),
    "group_stats": (group_stats, _items.rstrip() + f", {STATS_SQL} select * from stats"),
    "token_counts_by_group": (
        token_counts_by_group,
        _tokens
        + "select original_language, genre_name, count(*) as token_count from item_tokens"
        + " group by original_language, genre_name",
    ),
    "top_tokens_per_group": (
        top_tokens_per_group,
        _tokens.rstrip() + f", {RANKED_SQL} select * from ranked where token_rank <= 3",
    ),
    "top_tokens_label": (
        top_tokens_label,
        _tokens.rstrip() + f", {RANKED_SQL} select * from labels_by_group",
    ),
    "group_profile": (
        group_profile,
        _tokens.rstrip()
        + f", {STATS_SQL}, {RANKED_SQL} select * from stats join labels_by_group using (original_language)",
    ),
    "recommend_similar": (
        recommend_similar,
        _items.rstrip()
        + f""", probes as (select unnest({PROBES!r}) as because),
homes as (select because, original_language as home from (
              select because, original_language,
                     row_number() over (partition by because order by item_id) as rn
              from items join probes on lower(title) = lower(because)) where rn = 1)
select because, item_id, title, release_year, genre, vote_average, popularity, place from (
    select because, item_id, title, release_year, genre, vote_average, popularity,
           cast(row_number() over (partition by because order by vote_average desc, popularity desc, item_id)
                as int) as place
    from items join homes on original_language = home and lower(title) <> lower(because))
where place <= 10""",
    ),
    "union_by_name": (
        union_by_name,
        _items + "select item_id, title, vote_average from items where decade is not null",
    ),
}

_TOP_SQL = "select * from items {} order by {}popularity desc, item_id limit 20"
_JOB_SQL = {
    "summary": CASES["catalog_summary"][1].removeprefix(_tokens).replace("row_count", "movies_after_cleaning")
    .replace("token_rows", "movie_genre_rows").replace("distinct_tokens", "distinct_genres"),
    "films_by_genre": GENRE_COUNT_SQL,
    "avg_vote_by_genre": RATED_SQL,
    "films_by_language": LANGUAGE_COUNT_SQL,
    "films_by_year": YEAR_COUNT_SQL + " group by release_year",
    "films_by_decade": CASES["count_by_decade"][1].removeprefix(_items),
    "top_popular_movies": _TOP_SQL.format("", ""),
    "high_quality_popular_movies": _TOP_SQL.format(f"where vote_count >= {MIN_VOTES}", "vote_average desc, "),
    "data_quality_missing_values": missing_sql(),
    "data_quality_outlier_thresholds": thresholds_sql("items", OUTLIER_METRICS),
    "data_quality_outlier_examples": examples_sql(
        "items", OUTLIER_METRICS, "title, release_year, genre, original_language", "item_id"
    ),
}
CASES["catalog_job"] = (
    catalog_job,
    _tokens + "\nunion all\n".join(cells_sql(name, _JOB_SQL[name], *listed) for name, listed in JOB_REPORTS.items()),
)
