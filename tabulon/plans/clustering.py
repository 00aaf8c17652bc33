"""Clustering job: features, choice of k, clusters, profiles, projection and similar rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import token_array
from tabulon.operators import clusters
from tabulon.operators.features import FeatureModel, fit_features, with_log_columns
from tabulon.operators.grouping import group_profile
from tabulon.operators.kmeans import ClusterModel
from tabulon.operators.similar import recommend
from tabulon.operators.tokens import explode_tokens
from tabulon.plans.catalog import CatalogColumns, clean_catalog, typed_catalog
from tabulon.sources import materialize, release

# The numeric features, and the columns of the results.
NUMERICS = ("log_popularity", "vote_average", "log_vote_count")
LIGHT_COLUMNS = (
    "title",
    "release_year",
    "genre",
    "vote_average",
    "popularity",
    "vote_count",
    "original_language",
    "cluster",
)
SIMILAR_COLUMNS = ("title", "release_year", "genre", "vote_average", "popularity", "cluster")


def feature_input(rows: DataFrame) -> DataFrame:
    """Clean catalog rows with the token array and the log columns the features are made of; twice is as good as once."""
    return with_log_columns(
        rows.withColumn("genre_array", token_array(F.col("genre"))), ["popularity", "vote_count"]
    )


@dataclass(frozen=True)
class CatalogModel:
    """What the clustering job has learnt: the features of a row and the centers."""

    features: FeatureModel
    clusters: ClusterModel

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.save(spark, f"{path}/features")
        self.clusters.save(spark, f"{path}/clusters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CatalogModel:
        return cls(FeatureModel.load(spark, f"{path}/features"), ClusterModel.load(spark, f"{path}/clusters"))

    def score(self, rows: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Clean catalog rows, or the columns to keep of them, with their vector, in the column features, and the cluster it belongs to."""
        vectors = self.features.transform(feature_input(rows))
        if keep is not None:
            vectors = vectors.select(*[c for c in dict.fromkeys(keep) if c not in ("features", "cluster")], "features")
        return clusters.assign(vectors, self.clusters)


def cluster_report(
    raw: DataFrame,
    titles: Sequence[str],
    id_column: str,
    columns: CatalogColumns = CatalogColumns(),
    k: int | None = None,
    k_min: int = clusters.K_MIN,
    k_max: int = clusters.K_MAX,
    model_path: str | None = None,
) -> dict[str, DataFrame]:
    """The frames of the clustering job by name; a given k skips the search.

    Clean rows with their vectors, and clustered rows with theirs, are each written once as a table that all later steps read; fits run
    while the job is put together, all results but the search scores are lazy. With model_path the model is saved there, and the
    rows are scored by the one that is loaded again.
    """
    # Later steps read and write these only.
    needed = list(dict.fromkeys([id_column, *[c for c in LIGHT_COLUMNS if c != "cluster"], "genre_array", *NUMERICS]))
    rows = materialize(feature_input(clean_catalog(typed_catalog(raw, columns), columns)).select(needed), "catalog")
    fitted = fit_features(rows, "genre_array", NUMERICS)
    features = materialize(fitted.transform(rows).select(id_column, "features"), "features")
    reports = {}
    if k is None:
        scores = clusters.search_k(features, id_column, k_min, k_max)
        reports["k_scores"] = scores
        k = clusters.best_k(scores)
    model = CatalogModel(fitted, clusters.fit_kmeans(features, id_column, k))
    release(features)
    if model_path is not None:
        model.save(raw.sparkSession, model_path)
        model = CatalogModel.load(raw.sparkSession, model_path)
    kept = list(dict.fromkeys([id_column, *LIGHT_COLUMNS, "features"]))
    clustered = materialize(model.score(rows, kept).select(kept), "clustered")
    release(rows)
    light = clustered.drop("features")
    return reports | {
        "movies_with_clusters": light.select(*LIGHT_COLUMNS),
        "cluster_profiles": group_profile(
            light,
            explode_tokens(light, "genre", "genre_name"),
            group="cluster",
            token="genre_name",
            vote="vote_average",
            popularity="popularity",
            year="release_year",
        ).withColumnsRenamed({"row_count": "movie_count", "top_tokens": "top_genres"}),
        "projection": clusters.project_2d(clustered),
        "recommendations": recommend(
            light,
            titles,
            group="cluster",
            title="title",
            id_column=id_column,
            order=["vote_average", "popularity"],
            output=SIMILAR_COLUMNS,
            probe_name="because_you_watched",
        )
        .orderBy("because_you_watched", "place")
        .select(*SIMILAR_COLUMNS, "because_you_watched"),
    }
