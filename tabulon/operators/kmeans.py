"""KMeans whose result depends on the rows alone: not on their order, files or partitions.

Starting points come from parallel oversampling: in each round a row joins the candidates if a number drawn from a digest of the seed, its id and the round is below its share
of the cost so far. Each candidate weighs the rows nearest to it, and k of them are chosen one after the other, each the one with the
greatest weight times squared distance to those before. Then rows join their nearest center and centers move to the mean
of their rows. Each step is one aggregate over the rows, for any number of models at once; the driver holds candidates, centers and their sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.sparse import BLOCK, Rows, blocks_of, dimensions, entries_of, nearest, packed, summed, with_numbers

# Fixed values of the clustering job.
SEED = 42
FINAL_ITERATIONS = 50
#: Rounds of oversampling, and candidates wanted in each one per center.
ROUNDS = 2
OVERSAMPLING = 2
#: A model is done when no center moves further.
TOLERANCE = 1e-4
#: Digits of a center that count, so that the order in which rows were added up does not show.
DIGITS = 9
ENTRIES = "center int, place int, value double"
NAMES = ("center", "place", "value")


@dataclass(frozen=True)
class ClusterModel:
    """Centers in the order of their coordinates, so a cluster's number does not depend on how it was found; rows in each, and their cost."""

    centers: np.ndarray
    sizes: tuple[int, ...]
    cost: float
    k: int = field(default=0)

    @property
    def summary(self) -> SimpleNamespace:
        return SimpleNamespace(trainingCost=self.cost, k=self.k, clusterSizes=list(self.sizes))

    def save(self, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
        """Write the model as a table of its centers."""
        rows = [(i, [float(x) for x in center], size, self.cost, self.k) for i, (center, size) in enumerate(zip(self.centers, self.sizes, strict=True))]
        spark.createDataFrame(rows, "cluster int, center array<double>, size bigint, cost double, k int").coalesce(1).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterModel:
        rows = spark.read.parquet(path).orderBy("cluster").collect()
        return cls(np.array([r["center"] for r in rows]), tuple(r["size"] for r in rows), rows[0]["cost"], rows[0]["k"])


def drawn(seed: int, step: int, key: Column) -> Column:
    """A number from 0 to 1 that a digest of the seed, the step and the id draws."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cost(rows: DataFrame, dims: int, points: np.ndarray) -> float:
    def costs(batches):
        total = 0.0
        for part, _ in blocks_of(batches, dims):
            total += float(nearest(part.distances(points))[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["cost"])

    return rows.select(*BLOCK).mapInArrow(costs, "cost double").agg(F.sum("cost")).first()[0] or 0.0


def _candidates(rows: DataFrame, dims: int, k: int, seed: int) -> np.ndarray:
    """Some ROUNDS * OVERSAMPLING * k rows, in the order in which they were drawn."""
    id_type = rows.schema["id"].dataType.elementType
    lists = [T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    fields = T.StructType([T.StructField("u", T.DoubleType()), T.StructField("id", id_type), *lists])

    def dense(found: Sequence) -> np.ndarray:
        out = np.zeros((len(found), dims))
        for i, row in enumerate(found):
            out[i, list(row["indices"])] = row["values"]
        return out

    def taken(part: Rows, lists: dict, u: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        entries = [part.entries(i) for i in numbers]
        columns = [
            pa.array(u[numbers]),
            lists["id"].take(pa.array(numbers)),
            pa.array([e[0].tolist() for e in entries], pa.list_(pa.int32())),
            pa.array([e[1].tolist() for e in entries], pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=fields.names)

    def least(batches):
        for part, lists in blocks_of(batches, dims):
            u = lists["u0"].to_numpy()
            yield taken(part, lists, u, np.flatnonzero(u == u.min()))

    first = rows.select(*BLOCK, "id", "u0").mapInArrow(least, fields).agg(F.min(F.struct(*fields.names)).alias("row")).first()["row"]
    points = dense([] if first is None else [first])
    for step in range(1, ROUNDS + 1):
        cost = _cost(rows, dims, points) if len(points) else 0.0
        if not cost:
            break
        known, draws = points, f"u{step}"

        def chosen(batches):
            for part, lists in blocks_of(batches, dims):
                u = lists[draws].to_numpy()
                share = OVERSAMPLING * k * nearest(part.distances(known))[1] / cost
                yield taken(part, lists, u, np.flatnonzero(u < share))

        more = rows.select(*BLOCK, "id", draws).mapInArrow(chosen, fields)
        points = np.concatenate([points, dense(sorted(more.collect(), key=lambda r: (r["u"], r["id"])))])
    return points


def _weights(rows: DataFrame, dims: int, points: np.ndarray) -> np.ndarray:
    """How many rows are nearest to each point."""

    def counts(batches):
        total = np.zeros(len(points))
        for part, _ in blocks_of(batches, dims):
            total += np.bincount(nearest(part.distances(points))[0], minlength=len(points))
        yield entries_of(total[:, None], NAMES)

    out = np.zeros(len(points))
    for center, _, value in summed(rows.select(*BLOCK).mapInArrow(counts, ENTRIES), ["center", "place"], "value"):
        out[int(center)] = value
    return out


def chosen_points(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The k points that are taken one after the other, the first of equals; fewer if there are no more different ones."""
    if not len(points):
        return points
    chosen = [int(weights.argmax())]
    while len(chosen) < k:
        gain = weights * ((points[:, None, :] - points[chosen]) ** 2).sum(2).min(1)
        if gain.max() <= 0:
            break
        chosen.append(int(gain.argmax()))
    return points[chosen]


def moments(rows: DataFrame, models: Sequence[np.ndarray], dims: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[float]]:
    """Per model the counts, the sums, the sums of squared norms and the cost of the rows nearest to each center; one scan for all of them."""
    begins = np.cumsum([0, *map(len, models)])
    stacked, total = np.concatenate(models), int(begins[-1])

    def sums(batches):
        out = np.zeros((total, dims + 3))
        for part, _ in blocks_of(batches, dims):
            distances = part.distances(stacked)
            for begin, end in zip(begins[:-1], begins[1:]):
                label, least = nearest(distances[begin:end])
                out[begin:end, :dims] += part.sums(label, end - begin, dims)
                out[begin:end, dims] += np.bincount(label, minlength=end - begin)
                out[begin:end, dims + 1] += np.bincount(label, weights=part.norms, minlength=end - begin)
                out[begin, dims + 2] += least.sum()
        yield entries_of(out, NAMES)

    whole = np.zeros((total, dims + 3))
    found = summed(rows.select(*BLOCK).mapInArrow(sums, ENTRIES), ["center", "place"], "value")
    whole[found[:, 0].astype(int), found[:, 1].astype(int)] = found[:, 2]
    parts = [whole[begin:end] for begin, end in zip(begins[:-1], begins[1:])]
    return [p[:, dims] for p in parts], [p[:, :dims] for p in parts], [p[:, dims + 1] for p in parts], [float(p[0, dims + 2]) if len(p) else 0.0 for p in parts]


@contextmanager
def kept_rows(features: DataFrame, id_column: str, seed: int = SEED) -> Iterator[tuple[DataFrame, int]]:
    """The blocks of the rows with their ids and draws, read and packed once and kept, and the dimensions of their vectors."""
    dims = dimensions(features)
    drawn_at = [drawn(seed, step, F.col(id_column)).alias(f"u{step}") for step in range(ROUNDS + 1)]
    rows = packed(features, dims, [F.col(id_column).alias("id"), *drawn_at]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows, dims
    finally:
        rows.unpersist()


def fit_all(features: DataFrame, id_column: str, ks: Sequence[int], max_iter: int = FINAL_ITERATIONS, seed: int = SEED) -> dict[int, ClusterModel]:
    """A model for each k, fitted side by side: every step is one scan for all that still move. The rows are read once and kept.

    Ids must be unique and not null, as they decide the draws. A model has fewer centers than k if there are fewer different candidates; a center
    that no row is nearest to stays where it is.
    """
    _check(ks)
    with kept_rows(features, id_column, seed) as (rows, dims):
        return fit_kept(rows, dims, ks, max_iter, seed)


def _check(ks: Sequence[int]) -> None:
    if not ks or min(ks) < 1:
        raise ValueError(f"k must be at least 1: {list(ks)}")


def fit_kept(rows: DataFrame, dims: int, ks: Sequence[int], max_iter: int = FINAL_ITERATIONS, seed: int = SEED) -> dict[int, ClusterModel]:
    """The same on rows that kept_rows() holds."""
    _check(ks)
    points = _candidates(rows, dims, max(ks), seed)
    if not len(points):
        raise ValueError("no rows to fit on")
    weights = _weights(rows, dims, points)
    centers = {k: chosen_points(points, weights, k) for k in ks}
    moving = list(centers)
    for _ in range(max_iter):
        if not moving:
            break
        counts, sums, _, _ = moments(rows, [centers[k] for k in moving], dims)
        still = []
        for k, n, total in zip(moving, counts, sums, strict=True):
            new = np.where(n[:, None] > 0, np.round(total / np.maximum(n, 1)[:, None], DIGITS), centers[k])
            if ((new - centers[k]) ** 2).sum(1).max() > TOLERANCE**2:
                still.append(k)
            centers[k] = new
        moving = still
    # Sorted by the first coordinate, then the next ones.
    ordered = {k: c[np.lexsort(c.T[::-1])] for k, c in centers.items()}
    counts, _, _, costs = moments(rows, list(ordered.values()), dims)
    return {k: ClusterModel(c, tuple(int(x) for x in n), cost, k) for (k, c), n, cost in zip(ordered.items(), counts, costs, strict=True)}


def with_labels(features: DataFrame, model: ClusterModel, out: str) -> DataFrame:
    """The rows with the number of the center nearest to the vector in the column features, the first of equals; a column out is replaced."""
    centers = model.centers
    return with_numbers(features, centers.shape[1], [T.StructField(out, T.IntegerType())], lambda part: [nearest(part.distances(centers))[0].astype(np.int32)])
