from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from tabulon.functions import token_array
from tabulon.operators import clusters
from tabulon.operators.features import (
    FeatureModel,
    features_long,
    fit_features,
    min_max_scaled,
    token_presence,
    vocabulary,
    vocabulary_list,
    with_log_columns,
)
from tabulon.operators.kmeans import ClusterModel, fit_all


@pytest.fixture(scope="module")
def rows(spark):
    random = np.random.default_rng(3)
    tokens = ["red", "green", "blue", "rare"]
    data = []
    for i in range(300):
        kind = i % 3
        data.append((i, f"{tokens[kind]}, {tokens[(kind + i // 150) % 3]}", float(random.normal(kind * 5, 1)), i % 7))
    data.append((300, "rare", 1.0, 1))
    df = spark.createDataFrame(data, "id int, cell string, score double, votes int")
    return df.withColumn("tokens", token_array(F.col("cell")))


def featured(rows):
    return fit_features(rows, "tokens", ["score", "votes"]).transform(rows)


def test_vocabulary_keeps_tokens_of_two_rows(rows):
    words = vocabulary_list(rows, "tokens")
    counted = {r.token: r.row_count for r in vocabulary(rows, "tokens").collect()}
    assert "rare" not in counted and min(counted.values()) >= 2
    assert words == sorted(counted, key=lambda token: (-counted[token], token))
    assert vocabulary(rows, "tokens", min_rows=1).count() == 4


def test_features_hold_numbers_then_presence(rows):
    model = fit_features(rows, "tokens", ["score", "votes"])
    long = {(r.id, r.dim): r.value for r in features_long(rows, "id", model).collect()}
    present = {(r.id, r.token) for r in token_presence(rows, "id", "tokens").collect()}
    assert {key for key in long if key[1] not in ("score", "votes")} == present
    assert all(long[key] == 1.0 for key in present)
    assert model.names[:2] == ("score", "votes") and len(model.names) == 5


def test_constant_column_scales_to_one_half(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (2, 5.0, 4.0), (3, 5.0, 1.0)], "id int, a double, b double")
    scaled = sorted(min_max_scaled(df, "id", ["a", "b"]).collect())
    assert [tuple(r) for r in scaled] == [(1, 0.5, 0.0), (2, 0.5, 1.0), (3, 0.5, 0.25)]


def test_null_in_a_numeric_feature_raises(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "id int, a double")
    with pytest.raises(Exception, match="null"):
        min_max_scaled(df, "id", ["a"]).collect()


def test_log_columns(spark):
    df = with_log_columns(spark.createDataFrame([(0.0, 1)], "a double, b int"), ["a", "b"])
    assert tuple(df.first()) == (0.0, 1, 0.0, pytest.approx(np.log(2)))


def test_every_row_joins_its_nearest_center(rows):
    features = featured(rows)
    model = clusters.fit_kmeans(features, "id", 4)
    found = clusters.assign(features, model).select("id", "cluster", vector_to_array("features").alias("x"))
    centers = np.array(clusters.ordered_centers(model))
    assert found.count() == rows.count()
    cost = 0.0
    for row in found.collect():
        distances = ((centers - np.array(row.x)) ** 2).sum(axis=1)
        assert distances[row.cluster] <= distances.min() + 1e-9
        cost += distances[row.cluster]
    assert cost == pytest.approx(model.summary.trainingCost, rel=1e-9)


def test_labels_do_not_depend_on_the_layout_of_the_input(rows):
    def labels(df):
        features = featured(df)
        model = clusters.fit_kmeans(features, "id", 4)
        return {r.id: r.cluster for r in clusters.assign(features, model).select("id", "cluster").collect()}

    first = labels(rows)
    assert labels(rows) == first
    assert labels(rows.repartition(1)) == first
    assert labels(rows.orderBy(F.desc("score")).repartition(7)) == first


def test_search_prefers_the_best_score_and_then_the_smallest_k(spark, rows):
    scores = clusters.search_k(featured(rows), "id", 2, 5)
    found = {r.k: r.silhouette for r in scores.collect()}
    assert sorted(found) == [2, 3, 4, 5]
    assert all(-1 <= s <= 1 for s in found.values())
    assert clusters.best_k(scores) == min(k for k in found if found[k] == max(found.values()))
    ties = spark.createDataFrame([(7, 0.5), (6, 0.5), (5, 0.1)], "k int, silhouette double")
    assert clusters.best_k(ties) == 6


def test_search_refuses_bad_ranges(rows):
    with pytest.raises(ValueError):
        clusters.search_k(rows, "id", 6, 5)
    with pytest.raises(ValueError):
        clusters.search_k(rows, "id", 1, 5)


def test_silhouette_needs_two_clusters(spark):
    df = spark.createDataFrame([([0.0, 1.0], 0), ([1.0, 0.0], 0)], "v array<double>, label int")
    with pytest.raises(Exception, match="[Cc]luster"):
        clusters.silhouette_of_arrays(df, "v", "label")


def test_projection_keeps_the_explained_variance(rows):
    features = clusters.assign(featured(rows), clusters.fit_kmeans(featured(rows), "id", 3))
    points = np.array([[r.x, r.y] for r in clusters.project_2d(features, ["id"]).collect()])
    vectors = np.array(
        [r.x for r in features.select(vector_to_array("features").alias("x")).collect()]
    )
    eigenvalues = np.sort(np.linalg.eigvalsh(np.cov(vectors.T)))[::-1]
    covariance = np.cov(points.T)
    assert covariance[0, 0] == pytest.approx(eigenvalues[0], rel=1e-6)
    assert covariance[1, 1] == pytest.approx(eigenvalues[1], rel=1e-6)
    assert covariance[0, 1] == pytest.approx(0.0, abs=1e-9)


def test_projection_has_a_fixed_sign(spark):
    schema = StructType([StructField("a", DoubleType()), StructField("b", DoubleType())])
    df = spark.createDataFrame([(float(i), float(-3 * i)) for i in range(10)], schema)
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    rows = clusters.project_2d(vectors, ["a"]).orderBy("a").collect()
    # The largest loading is b's; made positive, x falls while a rises.
    assert rows[0].x > rows[-1].x


def test_labels_are_the_same_for_any_number_of_partitions(spark, rows):
    features = featured(rows).select("id", "features")
    found = []
    for partitions in (8, 32, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            laid_out = features.repartition(partitions)
            model = clusters.fit_kmeans(laid_out, "id", 5)
            labels = {r.id: r.cluster for r in clusters.assign(laid_out, model).select("id", "cluster").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        found.append((model.centers.tolist(), labels))
    assert found[0] == found[1] == found[2] and len(set(found[0][1].values())) == 5


def test_centers_are_the_means_of_their_rows(rows):
    features = featured(rows)
    model = clusters.fit_kmeans(features, "id", 4)
    assigned = clusters.assign(features, model).select("cluster", vector_to_array("features").alias("x")).collect()
    for number, center in enumerate(model.centers):
        mine = np.array([r.x for r in assigned if r.cluster == number])
        assert len(mine) == model.sizes[number] and np.allclose(mine.mean(0), center, atol=1e-3)
    assert [tuple(c) for c in model.centers] == sorted(tuple(c) for c in model.centers)


def test_starting_points_are_spread(spark):
    """Three far groups of very different size: each gets a center."""
    random = np.random.default_rng(1)
    points = np.concatenate([random.normal(c, 0.1, (n, 2)) for c, n in (((0, 0), 900), ((50, 0), 30), ((0, 80), 5))])
    df = spark.createDataFrame([(i, DenseVector(p)) for i, p in enumerate(points)], ["id", "features"])
    model = clusters.fit_kmeans(df, "id", 3)
    assert sorted(model.sizes) == [5, 30, 900]


def test_fewer_different_rows_than_centers_and_bad_input(spark):
    df = spark.createDataFrame([(i, SparseVector(4, {i % 2: 1.0})) for i in range(20)], ["id", "features"])
    model = clusters.fit_kmeans(df, "id", 5)
    assert model.sizes == (10, 10) and model.cost == 0.0
    with pytest.raises(ValueError):
        clusters.fit_kmeans(df.limit(0), "id", 2)
    with pytest.raises(ValueError):
        clusters.fit_kmeans(df, "id", 0)


def test_silhouettes_agree_with_spark(rows):
    features = featured(rows)
    models = fit_all(features, "id", [2, 4, 6])
    for k, score in clusters.silhouettes(features, "id", models).items():
        assigned = clusters.assign(features, models[k])
        assert score == pytest.approx(clusters.silhouette(assigned, "features", "cluster"), abs=1e-9)


def test_models_score_after_loading_as_before(spark, rows, tmp_path):
    fitted = fit_features(rows, "tokens", ["score", "votes"])
    model = clusters.fit_kmeans(fitted.transform(rows), "id", 4)
    for _ in range(2):
        fitted.save(spark, str(tmp_path / "features"))
        model.save(spark, str(tmp_path / "clusters"))
    again = FeatureModel.load(spark, str(tmp_path / "features"))
    centers = ClusterModel.load(spark, str(tmp_path / "clusters"))
    assert again.names == fitted.names and (centers.centers == model.centers).all() and centers.summary.trainingCost == model.summary.trainingCost
    scored = [{r.id: (r.features, r.cluster) for r in clusters.assign(f.transform(rows), m).select("id", "features", "cluster").collect()} for f, m in ((fitted, model), (again, centers))]
    assert scored[0] == scored[1]


def test_projection_of_a_hundred_thousand_dimensions(spark):
    """Two strong directions, each over its own half of the first dimensions, and a little of every other one."""
    random = np.random.default_rng(9)
    dims, data = 100_000, []
    for i in range(400):
        a, b = random.normal(0, 9), random.normal(0, 5)
        entries = {j: a if j < 10 else b for j in range(20)} | {int(j): float(random.normal()) for j in random.integers(20, dims, 5)}
        data.append((i, a, b, SparseVector(dims, sorted(entries.items()))))
    df = spark.createDataFrame(data, ["id", "a", "b", "features"])
    found = np.array([[r.x, r.y, r.a, r.b] for r in clusters.project_2d(df, ["id", "a", "b"]).collect()])
    correlations = np.abs(np.corrcoef(found.T))
    assert correlations[0, 2] > 0.999 and correlations[1, 3] > 0.999
    assert abs(np.cov(found[:, 0], found[:, 1])[0, 1]) < 1e-6
