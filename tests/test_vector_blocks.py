"""Vectors in blocks: whatever their form and number of dimensions, and without columns that nobody asked for."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector, Vectors
from pyspark.sql import functions as F
from tabulon.functions import token_array
from tabulon.operators import clusters
from tabulon.operators.features import fit_features
from tabulon.operators.kmeans import fit_all
from tabulon.operators.sparse import DENSE_DIMENSIONS, blocks_of, packed


def vectors(dims):
    """Dense and sparse vectors side by side, an empty one, and their numbers."""
    random = np.random.default_rng(dims)
    numbers = np.where(random.random((500, dims)) < 6 / dims, random.normal(size=(500, dims)), 0.0)
    numbers[7] = 0.0
    made = [DenseVector(x) if i % 3 == 0 else SparseVector(dims, {int(j): float(x[j]) for j in np.flatnonzero(x)}) for i, x in enumerate(numbers)]
    return numbers, list(enumerate(made))


@pytest.mark.parametrize("dims", [1, 9, DENSE_DIMENSIONS, DENSE_DIMENSIONS + 1, 300])
def test_blocks_hold_every_vector(spark, dims):
    numbers, rows = vectors(dims)
    df = spark.createDataFrame(rows, ["id", "features"]).repartition(3)
    blocks = packed(df, dims, [F.col("id")])
    # Scans take a step per block, not per row.
    assert blocks.count() <= 3
    points = np.random.default_rng(1).normal(size=(4, dims))
    seen = {}
    for part, lists in blocks_of(blocks.toArrow().to_batches(), dims):
        distances, found = part.distances(points), part.weighted(np.ones((1, len(part))), dims)
        ids = lists["id"].to_pylist()
        assert np.allclose(found[0], numbers[ids].sum(0))
        for i, number in enumerate(ids):
            places, values = part.entries(i)
            again = np.zeros(dims)
            again[places] = values
            assert (again == numbers[number]).all()
            seen[number] = distances[:, i]
    assert sorted(seen) == list(range(500))
    for number, distances in seen.items():
        assert np.allclose(distances, ((points - numbers[number]) ** 2).sum(1))


@pytest.mark.parametrize("dims", [9, 300])
def test_fits_and_labels_of_mixed_vectors(spark, dims):
    numbers, rows = vectors(dims)
    df = spark.createDataFrame(rows, ["id", "features"])
    model = fit_all(df, "id", [3])[3]
    labels = {r.id: r.cluster for r in clusters.assign(df, model).collect()}
    distances = ((numbers[:, None, :] - model.centers[None]) ** 2).sum(2)
    assert all(distances[i, label] <= distances[i].min() + 1e-9 for i, label in labels.items()) and len(labels) == 500
    assert sum(model.sizes) == 500 and model.cost == pytest.approx(distances.min(1).sum())
    same = clusters.assign(df, model).orderBy("id").collect()
    assert [(r.id, r.features) for r in same] == rows


def test_a_label_does_not_depend_on_the_rows_beside_it(spark):
    """Two equal centers apart from the last bits: every copy of a row gets the same one."""
    row = Vectors.dense([0.1, 0.2, 0.3, 0.7, 0.1, 0.9, 0.3])
    df = spark.createDataFrame([(i, row) for i in range(1003)], ["id", "features"])
    model = fit_all(df, "id", [1])[1]
    two = type(model)(np.array([row.toArray() + 0.5, row.toArray() - 0.5]), (0, 0), 0.0, 2)
    for parts in (1, 7, 64):
        assert clusters.assign(df.repartition(parts), two).select("cluster").distinct().count() == 1


def test_features_add_one_column(spark):
    df = spark.createDataFrame([(1, "a, b", 1.0), (2, "a, b", 2.0)], "id int, cell string, x double").withColumn("t", token_array(F.col("cell")))
    assert fit_features(df, "t", ["x"]).transform(df).columns == ["id", "cell", "x", "t", "features"]
