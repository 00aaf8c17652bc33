"""The whole jobs, from a dirty file to saved reports."""

from __future__ import annotations

import csv
import os
import time

import pytest
from pyspark.sql import functions as F
from tabulon.operators.standardize import ColumnSpec
from tabulon.plans import (
    CatalogColumns,
    CatalogModel,
    TelemetryColumns,
    catalog_report,
    cluster_report,
    telemetry_report,
    typed_catalog,
    write_reports,
)
from tabulon.plans.catalog import clean_catalog
from tabulon.sources import read_delimited, table_scope, write_delimited
from workload import fixtures as fx

COLUMNS = CatalogColumns(extra=(ColumnSpec("item_id", "item_id", "int"),), tie_breaker="item_id")


@pytest.fixture(scope="module")
def raw(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalog") / "raw")
    write_delimited(fx.catalog_raw(spark, small), path)
    return read_delimited(spark, path)


@pytest.fixture(scope="module")
def reports(raw):
    return catalog_report(raw, COLUMNS, min_votes=5, views=("movies", "movie_genres"))


def test_reports_have_the_published_columns(reports):
    ranking = "title release_year original_language genre popularity vote_average vote_count"
    expected = {
        "summary": "movies_after_cleaning movie_genre_rows typed_columns distinct_languages distinct_genres"
        " min_release_year max_release_year avg_vote avg_popularity",
        "films_by_genre": "genre_name movie_count",
        "avg_vote_by_genre": "genre_name avg_vote avg_popularity movie_count",
        "films_by_language": "original_language movie_count",
        "films_by_year": "release_year movie_count",
        "films_by_decade": "decade movie_count avg_vote",
        "top_popular_movies": ranking,
        "high_quality_popular_movies": ranking,
        "data_quality_missing_values": "column_name total_rows missing_count missing_percent why_problem",
        "data_quality_outlier_thresholds": "metric q1 q3 iqr lower_bound upper_bound outlier_count rule"
        " why_check_this_metric",
        "data_quality_outlier_examples": "metric title release_year original_language genre metric_value"
        " lower_bound upper_bound outlier_side distance_from_bound why_outlier",
    }
    assert {name: " ".join(frame.columns) for name, frame in reports.items()} == expected


def test_counts_of_the_reports_agree(spark, reports):
    summary = reports["summary"].first()
    assert summary.typed_columns == 12
    for name in ("films_by_language", "films_by_year", "films_by_decade"):
        assert sum(r.movie_count for r in reports[name].collect()) == summary.movies_after_cleaning
    assert sum(r.movie_count for r in reports["films_by_genre"].collect()) == summary.movie_genre_rows
    assert spark.sql("select count(*) as n from movies").first().n == summary.movies_after_cleaning
    assert spark.sql("select count(*) as n from movie_genres").first().n == summary.movie_genre_rows


def test_reports_are_ordered(reports):
    years = [r.release_year for r in reports["films_by_year"].collect()]
    assert years == sorted(years, reverse=True)
    decades = [r.decade for r in reports["films_by_decade"].collect()]
    assert decades == sorted(decades, reverse=True)
    counts = [r.movie_count for r in reports["films_by_genre"].collect()]
    assert counts == sorted(counts, reverse=True)


def test_saved_reports(reports, tmp_path):
    write_reports(reports, str(tmp_path), single_file=list(reports))
    assert {f for f in os.listdir(tmp_path) if f.endswith(".csv") and not f.startswith(".")} == {
        f"{name}.csv" for name in reports
    }
    with open(tmp_path / "films_by_genre.csv", encoding="utf-8", newline="") as file:
        saved = list(csv.reader(file))
    assert saved[0] == ["genre_name", "movie_count"]
    assert len(saved) - 1 == reports["films_by_genre"].count()


def test_clustering_job(raw, tmp_path):
    titles = ["Customer#000000001", "customer#000000042", "nope"]
    found = cluster_report(raw, titles, "item_id", COLUMNS, k_min=3, k_max=4)
    assert " ".join(found["cluster_profiles"].columns) == (
        "cluster movie_count avg_vote std_vote avg_popularity avg_release_year top_genres"
    )
    assert " ".join(found["recommendations"].columns) == (
        "title release_year genre vote_average popularity cluster because_you_watched"
    )
    rows = found["movies_with_clusters"].count()
    assert sum(r.movie_count for r in found["cluster_profiles"].collect()) == rows
    assert found["projection"].count() == rows
    per_title = found["recommendations"].groupBy("because_you_watched").count().collect()
    assert all(r["count"] <= 10 for r in per_title) and "nope" not in {r[0] for r in per_title}
    write_reports(found, str(tmp_path), single_file=["cluster_profiles"])
    assert os.path.isdir(tmp_path / "movies_with_clusters")
    assert os.path.isfile(tmp_path / "cluster_profiles.csv")


def test_clustering_job_scores_with_the_saved_model(spark, raw, tmp_path):
    path = str(tmp_path / "model")
    with table_scope():
        before = sorted(cluster_report(raw, [], "item_id", COLUMNS, k=4)["movies_with_clusters"].collect(), key=repr)
        after = sorted(cluster_report(raw, [], "item_id", COLUMNS, k=4, model_path=path)["movies_with_clusters"].collect(), key=repr)
    assert before == after
    rows = clean_catalog(typed_catalog(raw, COLUMNS), COLUMNS)
    scored = CatalogModel.load(spark, path).score(rows).select("title", "release_year", "genre", "vote_average", "popularity", "vote_count", "original_language", "cluster")
    assert sorted(scored.collect(), key=repr) == after


def test_fixed_k_skips_the_search(raw):
    found = cluster_report(raw, [], "item_id", COLUMNS, k=3)
    assert "k_scores" not in found
    assert found["cluster_profiles"].count() == 3
    assert found["recommendations"].count() == 0


def test_telemetry_job(spark, small):
    rounds = fx.rounds(spark, small)
    found = telemetry_report(
        rounds, TelemetryColumns(), share_reasons=["1-URGENT"], paired_reasons=["1-URGENT", "5-LOW"]
    )
    for name, frame in found.items():
        assert frame.count() > 0 or name == "durations_outside_band", name
    total = rounds.count()
    assert found["count_by_mode_and_map"].agg(F.sum("row_count")).first()[0] == total
    assert found["won_lost_by_rank"].agg(F.sum(F.col("Won") + F.col("Lost"))).first()[0] == total
    assert not {"dateid", "matchid"} & {r.column_a for r in found["correlation"].collect()}
    assert len(found["top_objectives_1-URGENT"].collect()) == 5


def test_reports_are_written_side_by_side(spark, tmp_path):
    """Each of six frames waits for a second in its tasks; one after the other they would take six."""

    def waiting(batches):
        time.sleep(1)
        yield from batches

    slow = {f"r{i}": spark.range(3).coalesce(1).mapInArrow(waiting, "id bigint") for i in range(6)}
    slow["r0"].count()
    started = time.time()
    write_reports(slow, str(tmp_path), single_file=["r5"])
    assert time.time() - started < 5
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["r0", "r1", "r2", "r3", "r4", "r5.csv"]
    broken = {"good": spark.range(3), "bad": spark.range(3).select(F.raise_error(F.lit("no such thing")))}
    with pytest.raises(Exception, match="no such thing"):
        write_reports(broken, str(tmp_path / "more"))
    assert spark.read.csv(str(tmp_path / "more" / "good"), header=True).count() == 3


def test_counted_telemetry_reports_share_one_scan(spark, small):
    found = telemetry_report(fx.rounds(spark, small), share_reasons=["1-URGENT"], paired_reasons=["1-URGENT"])
    counted = ["count_by_mode_and_map", "count_by_mode_and_role", "picks_by_operator", "weapon_types", "duration_by_map", "objective_by_reason", "kills_by_weapons", "won_lost_by_rank", "text_profile", "distinct_values", "top_objectives_1-URGENT"]
    for name in counted:
        plan = found[name]._jdf.queryExecution().executedPlan().toString()
        assert "grouped-counts" in plan and "telemetry-rows" not in plan, name
