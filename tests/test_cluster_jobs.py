"""What the clustering queries read, write and pass on."""

from __future__ import annotations

import pytest
from tabulon.operators import clusters, kmeans
from tabulon.operators.features import fit_features
from tabulon.plans import CatalogModel
from tabulon.plans.clustering import NUMERICS, feature_input
from workload import fixtures as fx
from workload import learning


@pytest.fixture(scope="module")
def catalog(spark, small):
    return feature_input(fx.items(spark, small)).persist()


def test_scored_rows_hold_what_is_asked_for(catalog):
    fitted = fit_features(catalog, "genre_array", NUMERICS)
    model = CatalogModel(fitted, clusters.fit_kmeans(fitted.transform(catalog), "item_id", 3))
    kept = model.score(catalog, ["item_id", "title", "cluster"])
    assert kept.columns == ["item_id", "title", "features", "cluster"]
    every = model.score(catalog)
    assert set(every.columns) == {*catalog.columns, "features", "cluster"}
    assert {r.item_id: r.cluster for r in kept.collect()} == {r.item_id: r.cluster for r in every.select("item_id", "cluster").collect()}


def test_a_search_packs_the_rows_once(catalog, monkeypatch):
    calls, pack = [], kmeans.packed

    def counted(*args):
        calls.append(args)
        return pack(*args)

    monkeypatch.setattr(kmeans, "packed", counted)
    vectors = fit_features(catalog, "genre_array", NUMERICS).transform(catalog)
    found = {r.k: r.silhouette for r in clusters.search_k(vectors, "item_id", 3, 4).collect()}
    assert len(calls) == 1
    models = kmeans.fit_all(vectors, "item_id", [3, 4], clusters.SEARCH_ITERATIONS)
    assert found == {k: round(s, 4) for k, s in clusters.silhouettes(vectors, "item_id", models).items()}


def written(monkeypatch, name, spark, small):
    """The columns of the tables that a query writes."""
    tables, write = {}, learning.materialize

    def noted(df, table):
        tables[table] = df.columns
        return write(df, table)

    monkeypatch.setattr(learning, "materialize", noted)
    getattr(learning, name)(spark, small)
    return tables


def test_projection_writes_ids_vectors_and_clusters_only(spark, small, monkeypatch):
    assert written(monkeypatch, "pca_2d", spark, small) == {"vectors": ["item_id", "features"], "clustered": ["item_id", "features", "cluster"]}


def test_similar_rows_are_found_without_vectors(spark, small, monkeypatch):
    clustered = written(monkeypatch, "recommend_in_cluster", spark, small)["clustered"]
    assert clustered == ["item_id", *learning.SIMILAR_COLUMNS[:-1], "cluster"] and "features" not in clustered
