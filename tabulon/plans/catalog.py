"""Statistics job over a catalog: typing, cleaning, quality reports, counts, means and rankings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.quality import (
    iqr_bounds,
    missing_values,
    outlier_examples,
    outlier_thresholds,
)
from tabulon.operators.reports import count_by, mean_by, summary, top_rows
from tabulon.operators.standardize import ColumnSpec, clean, standardize, with_year_and_decade
from tabulon.operators.tokens import explode_tokens
from tabulon.sources import materialize, register_views

# The columns of the catalog file, the reasons shown in the quality reports and the limits.
CATALOG_SPECS = (
    ColumnSpec("Release_Date", "release_date", "date"),
    ColumnSpec("Title", "title", "text"),
    ColumnSpec("Overview", "overview", "text"),
    ColumnSpec("Popularity", "popularity", "double"),
    ColumnSpec("Vote_Count", "vote_count", "int"),
    ColumnSpec("Vote_Average", "vote_average", "double"),
    ColumnSpec("Original_Language", "original_language", "text"),
    ColumnSpec("Genre", "genre", "text"),
    ColumnSpec("Poster_Url", "poster_url", "raw"),
)
REQUIRED = {
    "release_date": "Required to analyze movies by year and decade.",
    "title": "Required to identify each movie clearly in the results.",
    "popularity": "Required to rank the most popular movies.",
    "vote_count": "Required to assess how reliable an average rating is.",
    "vote_average": "Required to compare movie and genre ratings.",
    "original_language": "Required to analyze the distribution by original language.",
    "genre": "Required to analyze the distribution by genre.",
}
TEXT_COLUMNS = ("title", "original_language", "genre")
OUTLIER_METRICS = {
    "popularity": "A popularity value far from the rest can dominate rankings.",
    "vote_count": "A very high vote count can indicate a much more exposed movie.",
    "vote_average": "A very low or very high rating can influence genre averages.",
}
RANKING_COLUMNS = (
    "title",
    "release_year",
    "original_language",
    "genre",
    "popularity",
    "vote_average",
    "vote_count",
)
MIN_ROWS_PER_GENRE = 50
MIN_VOTES = 1000
RANKING_ROWS = 20


@dataclass(frozen=True)
class CatalogColumns:
    """Columns the input adds to the catalog's own, and how equal rows are put in order."""

    extra: tuple[ColumnSpec, ...] = ()
    tie_breaker: str = "title"
    required: Mapping[str, str] = field(default_factory=lambda: dict(REQUIRED))
    text_columns: tuple[str, ...] = TEXT_COLUMNS


def typed_catalog(raw: DataFrame, columns: CatalogColumns = CatalogColumns(), strict: bool = False) -> DataFrame:
    return standardize(raw, [*CATALOG_SPECS, *columns.extra], strict)


def clean_catalog(typed: DataFrame, columns: CatalogColumns = CatalogColumns()) -> DataFrame:
    return with_year_and_decade(clean(typed, list(columns.required)), "release_date")


def catalog_report(
    raw: DataFrame,
    columns: CatalogColumns = CatalogColumns(),
    rel_error: float | None = None,
    min_votes: int = MIN_VOTES,
    views: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The eleven reports of the statistics job by name.

    The typed rows are written once as a table that all reports read. rel_error switches the quartiles from
    exact to approximate. views names the clean rows and the token rows for use from spark.sql.
    """
    typed = materialize(typed_catalog(raw, columns), "typed-catalog")
    rows = clean_catalog(typed, columns)
    tokens = explode_tokens(rows, "genre", "genre_name")
    if views:
        register_views(**{views[0]: rows, views[1]: tokens})

    bounds = iqr_bounds(rows, list(OUTLIER_METRICS), rel_error)
    figures = summary(
        rows,
        tokens,
        token="genre_name",
        language="original_language",
        year="release_year",
        vote="vote_average",
        popularity="popularity",
    )
    by_popularity = [F.desc("popularity"), columns.tie_breaker]
    return {
        "summary": figures.withColumnsRenamed(
            {
                "row_count": "movies_after_cleaning",
                "token_rows": "movie_genre_rows",
                "distinct_tokens": "distinct_genres",
            }
        ),
        "films_by_genre": count_by(tokens, ["genre_name"], "movie_count"),
        "avg_vote_by_genre": mean_by(
            tokens,
            ["genre_name"],
            {"avg_vote": "vote_average", "avg_popularity": "popularity"},
            "movie_count",
            MIN_ROWS_PER_GENRE,
        ),
        "films_by_language": count_by(rows, ["original_language"], "movie_count"),
        "films_by_year": count_by(rows, ["release_year"], "movie_count").orderBy(F.desc("release_year")),
        "films_by_decade": mean_by(rows, ["decade"], {"avg_vote": "vote_average"}, "movie_count")
        .select("decade", "movie_count", "avg_vote")
        .orderBy(F.desc("decade")),
        "top_popular_movies": top_rows(rows, by_popularity, RANKING_ROWS, RANKING_COLUMNS),
        "high_quality_popular_movies": top_rows(
            rows.where(F.col("vote_count") >= min_votes),
            [F.desc("vote_average"), *by_popularity],
            RANKING_ROWS,
            RANKING_COLUMNS,
        ),
        "data_quality_missing_values": missing_values(typed, columns.required, columns.text_columns),
        "data_quality_outlier_thresholds": outlier_thresholds(rows, OUTLIER_METRICS, bounds),
        "data_quality_outlier_examples": outlier_examples(
            rows,
            OUTLIER_METRICS,
            ["title", "release_year", "original_language", "genre"],
            columns.tie_breaker,
            bounds=bounds,
        ).orderBy("metric", F.desc("distance_from_bound")),
    }
