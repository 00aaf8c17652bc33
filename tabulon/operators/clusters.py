"""KMeans with stable labels, silhouette scores and a two-dimensional projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.kmeans import FINAL_ITERATIONS, SEED, ClusterModel, fit_all, fit_kept, kept_rows, moments, with_labels
from tabulon.operators.sparse import BLOCK, blocks_of, dimensions, entries_of, nearest, packed, summed, with_numbers

# Fixed values of the clustering job.
SEARCH_ITERATIONS = 20
K_MIN, K_MAX = 5, 14
#: Directions that the projection follows at once, more than the two it gives, so that it gets there in few scans.
DIRECTIONS = 10
MAX_SCANS = 100
RESIDUAL = 1e-9


def fit_kmeans(features: DataFrame, id_column: str, k: int, max_iter: int = FINAL_ITERATIONS, seed: int = SEED) -> ClusterModel:
    """Fit on the vector column features; the result depends on the ids and vectors only."""
    return fit_all(features, id_column, [k], max_iter, seed)[k]


def assign(features: DataFrame, model: ClusterModel) -> DataFrame:
    """Adds the cluster of each row, clusters being numbered by the order of their centers."""
    return with_labels(features, model, "cluster")


def ordered_centers(model: ClusterModel) -> list[list[float]]:
    """Centers in the numbering that assign() uses."""
    return [[float(x) for x in center] for center in model.centers]


def silhouette(df: DataFrame, features: str, label: str) -> float:
    """Mean silhouette with squared euclidean distance; linear in the rows, needs two clusters."""
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=label, metricName="silhouette"
    ).evaluate(df)


def silhouette_of_arrays(df: DataFrame, array: str, label: str) -> DataFrame:
    """One row with the silhouette of labelled points given as number arrays."""
    points = df.select(array_to_vector(F.col(array).cast("array<double>")).alias("features"), label)
    return df.sparkSession.createDataFrame([(silhouette(points, "features", label),)], "silhouette double")


def silhouettes(features: DataFrame, id_column: str, models: dict[int, ClusterModel]) -> dict[int, float]:
    """The mean silhouette of each model, with squared euclidean distance; two scans for all models.

    The distances of a row to all rows of a cluster add up to n |x|^2 + sum |y|^2 - 2 x sum y, so the moments of the clusters are enough. A row
    alone in its cluster scores 0.
    """
    with kept_rows(features, id_column) as (rows, dims):
        return silhouettes_of_kept(rows, dims, models)


def silhouettes_of_kept(rows: DataFrame, dims: int, models: dict[int, ClusterModel]) -> dict[int, float]:
    """The same on rows that kept_rows() holds."""
    centers = [m.centers for m in models.values()]
    counts, sums, squares, _ = moments(rows, centers, dims)

    def scores(batches):
        total = np.zeros((len(centers), 2))
        for part, _ in blocks_of(batches, dims):
            every = np.arange(len(part))
            for number, (points, n, y, psi) in enumerate(zip(centers, counts, sums, squares)):
                own = nearest(part.distances(points))[0]
                away = np.maximum(n[:, None] * part.norms + psi[:, None] - 2 * part.times(y), 0.0)
                inside = away[own, every] / np.maximum(n[own] - 1, 1)
                means = np.where(n[:, None] > 0, away / np.maximum(n, 1)[:, None], np.inf)
                means[own, every] = np.inf
                outside = means.min(0)
                greater = np.maximum(inside, outside)
                score = np.where((n[own] > 1) & (greater > 0) & np.isfinite(outside), (outside - inside) / np.where(greater > 0, greater, 1), 0.0)
                total[number] += score.sum(), len(part)
        yield entries_of(total, ("model", "place", "value"))

    found = np.zeros((len(centers), 2))
    for model, place, value in summed(rows.select(*BLOCK).mapInArrow(scores, "model int, place int, value double"), ["model", "place"], "value"):
        found[int(model), int(place)] = value
    return {k: float(total / n) if n else 0.0 for k, (total, n) in zip(models, found)}


def search_k(
    features: DataFrame,
    id_column: str,
    k_min: int = K_MIN,
    k_max: int = K_MAX,
    seed: int = SEED,
    max_iter: int = SEARCH_ITERATIONS,
) -> DataFrame:
    """(k, silhouette) for each k, scores rounded to four digits.

    All models start from the same candidates and move in the same scans; their scores take two more.
    """
    if k_min > k_max:
        raise ValueError(f"empty range of k: {k_min}..{k_max}")
    if k_min < 2:
        raise ValueError("a silhouette needs at least two clusters")
    with kept_rows(features, id_column, seed) as (rows, dims):
        models = fit_kept(rows, dims, range(k_min, k_max + 1), max_iter, seed)
        scores = silhouettes_of_kept(rows, dims, models)
    return features.sparkSession.createDataFrame([(k, round(score, 4)) for k, score in scores.items()], "k int, silhouette double")


def best_k(scores: DataFrame) -> int:
    """The k with the highest score, the smallest one of equals."""
    return scores.orderBy(F.desc("silhouette"), "k").first()["k"]


def principal_directions(features: DataFrame, count: int = 2, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(directions, mean): the main components of the vectors, a line each, of any number of dimensions.

    Block subspace iteration: a few random directions are multiplied with the covariance, one scan each time, and turned to the main directions of
    their span, until these hardly change under the covariance. Only dimensions times DIRECTIONS numbers are held. Products use
    the stored entries of the vectors and the mean apart. The largest loading of each direction is positive.
    """
    dims = dimensions(features)
    rows = packed(features, dims).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, mean = _mean(rows, dims)
        if n < 2 or dims < count:
            raise ValueError(f"{count} components need two rows and {count} dimensions, not {n} and {dims}")
        found = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, min(dims, DIRECTIONS))))[0]
        for _ in range(MAX_SCANS):
            moved = _times_covariance(rows, found, mean, n)
            within = found.T @ moved
            values, turned = np.linalg.eigh((within + within.T) / 2)
            turned = turned[:, ::-1]
            main, image = found @ turned, moved @ turned
            rest = np.linalg.norm(image[:, :count] - main[:, :count] * values[::-1][:count], axis=0)
            if rest.max() <= RESIDUAL * max(values[-1], np.finfo(float).tiny):
                break
            found = np.linalg.qr(moved)[0]
    finally:
        rows.unpersist()
    out = main[:, :count].T
    return out * np.where(out[np.arange(count), np.abs(out).argmax(1)] >= 0, 1.0, -1.0)[:, None], mean


def _mean(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    def sums(batches):
        out = np.zeros((1, dims + 1))
        for part, _ in blocks_of(batches, dims):
            out[:, :dims] += part.sums(np.zeros(len(part), np.int64), 1, dims)
            out[0, dims] += len(part)
        yield entries_of(out, ("line", "place", "value"))

    total = np.zeros(dims + 1)
    for _, place, value in summed(rows.mapInArrow(sums, "line int, place int, value double"), ["line", "place"], "value"):
        total[int(place)] = value
    return int(total[dims]), total[:dims] / max(total[dims], 1)


def _times_covariance(rows: DataFrame, directions: np.ndarray, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance of the rows times some directions, a column each."""
    dims, width = directions.shape
    shift = mean @ directions

    def products(batches):
        out = np.zeros((width, dims))
        for part, _ in blocks_of(batches, dims):
            out += part.weighted(part.times(directions.T) - shift[:, None], dims)
        yield entries_of(out, ("line", "place", "value"))

    found = summed(rows.mapInArrow(products, "line int, place int, value double"), ["line", "place"], "value")
    out = np.zeros((width, dims))
    out[found[:, 0].astype(int), found[:, 1].astype(int)] = found[:, 2]
    # The deviations from the mean along a direction add up to 0, so the mean itself has no part.
    return out.T / (n - 1)


def project_2d(features: DataFrame, keep: Sequence[str] = ("cluster",)) -> DataFrame:
    """The kept columns and x, y: the vectors along the two main components of all of them, which any number of dimensions may have."""
    directions, _ = principal_directions(features)
    fields = [T.StructField(name, T.DoubleType()) for name in ("x", "y")]
    rows = features.select("features", *[c for c in keep if c not in ("features", "x", "y")])
    return with_numbers(rows, directions.shape[1], fields, lambda part: list(part.times(directions))).select(*keep, "x", "y")
