"""Exact top-k search by inner product with a pivot-distance index.

Vectors are whole numbers, floor(256 x) of each component. Each is keyed by its nearest pivot and its distance to it. Sorted by that key they are cut
into annuli: blocks of at most BLOCK vectors of one pivot, with their least and greatest distance and their greatest norm, so a pivot
that draws a third of all vectors has many annuli. A query q with a k-th best score t so far needs no vector x with

    |q - x|^2 > |q|^2 + max|x|^2 - 2 t,

as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, and by the triangle inequality no annulus whose distances to its pivot differ by more than that from
the query's. Queries take t from their own annulus first; then the annuli that are left are met in the order of that difference, t rises, and
those that it excludes by then are passed over. Bounds have room for rounding and scores are whole numbers, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabulon.sources.shared import materialize

SCALE = 256
#: Vectors that the pivots are fitted on, those with the least hash; all vectors are indexed.
SAMPLE = 4096
PIVOTS = 64
ROUNDS = 8
BLOCK = 1024
#: Queries that meet an annulus together.
QUERIES = 512
#: Annuli of all vectors that one task meets for the same queries at most, on average.
BLOCKS_A_TASK = 256
SEED = 13
_EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)

BLOCK_TYPE = "pivot int, near double, far double, norm double, n int, ids binary, vectors binary"
QUERY_TYPE = "block bigint, position int, id bigint, vector binary, floor double"
CHUNK_TYPE = "n int, queries binary, vectors binary"
#: A query's place in the index, its id, and the score that its own annulus guarantees.
QUERY = np.dtype([("block", "<i8"), ("position", "<i8"), ("id", "<i8"), ("floor", "<f8")])
FOUND = pa.schema([("query_block", pa.int64()), ("query_position", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
NO_ID = np.iinfo(np.int64).max


def whole_components(vector: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def searchable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they all fit in."""
    most = max(-int(numbers.min(initial=0)), int(numbers.max(initial=0)) + 1)
    kind = next((k for k, bits in (("<i2", 15), ("<i4", 31)) if most <= 1 << bits), "<i8")
    return numbers.astype(kind).tobytes()


def _unpacked(data: bytes, n: int, dims: int) -> np.ndarray:
    size = len(data) // max(1, n * dims)
    return np.frombuffer(data, f"<i{size}").reshape(n, dims) if n * dims else np.zeros((n, dims), np.int64)


def fit_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Centers of the sample: far-off starts drawn by squared distance, then a few rounds of means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    draw = np.random.default_rng(SEED)
    centers = [sample[0]]
    gaps = ((sample - centers[0]) ** 2).sum(1)
    while len(centers) < pivots and gaps.sum() > 0:
        centers.append(sample[np.searchsorted(np.cumsum(gaps), draw.random() * gaps.sum()).clip(0, len(sample) - 1)])
        gaps = np.minimum(gaps, ((sample - centers[-1]) ** 2).sum(1))
    points = np.array(centers, float)
    for _ in range(ROUNDS):
        nearest = _distances(sample, points).argmin(1)
        sizes = np.bincount(nearest, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, nearest, sample)
        points[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return points


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, each from the differences themselves, so that small ones are exact too."""
    out = np.empty((len(rows), len(points)))
    for i, point in enumerate(points):
        out[:, i] = np.sqrt(((rows - point) ** 2).sum(1))
    return out


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole-number inner products; those outside 64 bits become the nearest number of 64 bits."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0))
    if most * max(1, queries.shape[1]) < _EXACT:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, *_LONG).astype(np.int64)


@dataclass(frozen=True)
class PivotIndex:
    """blocks: one row per annulus (block, pivot, near, far, norm, n, ids, vectors); pivots: their points; dims: components."""

    blocks: DataFrame
    pivots: np.ndarray
    dims: int


def build_index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK) -> PivotIndex:
    """The index of all searchable vectors, written as a table.

    Vectors that are null or hold null or non-finite components are left out; shorter ones are filled up with zeros; a null id, equal ids and
    equal vectors are indexed each. An empty table gives an index without blocks. Pivots are fitted on SAMPLE vectors at most, and the range sort
    by pivot, distance and hash of the row spreads any pivot, and any vector that many rows share, over many tasks.
    """
    rows = df.where(searchable(F.col(vector))).select(F.col(vec_id).cast("bigint").alias("id"), whole_components(F.col(vector)).alias("v"))
    total, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # Of the hashes below a share that holds some four times as many, so that tasks send few rows each.
    low = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * SAMPLE / max(1, total)))
    sampled = rows.where(low).orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()
    points = fit_pivots(_filled([r["v"] for r in sampled], dims).astype(float), pivots)

    def keyed(batches):
        for batch in batches:
            values = _filled(batch.column(1).to_pylist(), dims)
            distances = _distances(values.astype(float), points)
            nearest = distances.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(nearest.astype(np.int32)),
                    pa.array(distances[np.arange(len(values)), nearest]),
                    pa.array([_packed(v) for v in values], pa.binary()),
                ],
                names=["id", "pivot", "distance", "vector"],
            )

    def blocks_of(batches) -> Iterator[pa.RecordBatch]:
        ids: list = []
        distances: list[float] = []
        vectors: list[np.ndarray] = []
        pivot = None

        def cut():
            values = np.array(vectors, np.int64).reshape(len(ids), dims)
            numbers = np.array([NO_ID if i is None else i for i in ids], "<i8")
            norm = float(np.sqrt((values.astype(float) ** 2).sum(1).max(initial=0)))
            columns = [[pivot], [min(distances)], [max(distances)], [norm], [len(ids)], [numbers.tobytes()], [_packed(values)]]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["pivot", "near", "far", "norm", "n", "ids", "vectors"])

        for batch in batches:
            for key, own, distance, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (own != pivot or len(ids) >= block):
                    yield cut()
                    ids, distances, vectors = [], [], []
                pivot = own
                ids.append(key)
                distances.append(distance)
                vectors.append(_unpacked(data, 1, dims)[0])
        if ids:
            yield cut()

    placed = rows.mapInArrow(keyed, "id bigint, pivot int, distance double, vector binary")
    order = ["pivot", "distance", F.xxhash64("id", "vector")]
    packed = placed.repartitionByRange(*order).sortWithinPartitions("pivot", "distance", "id").mapInArrow(blocks_of, BLOCK_TYPE)
    return PivotIndex(materialize(packed.withColumn("block", F.monotonically_increasing_id()), "annuli"), points, dims)


def _floors(scores: np.ndarray) -> np.ndarray:
    """Scores as numbers that no better score is below; those at the end of 64 bits may stand for any lower one."""
    floors = scores.astype(float)
    floors = np.where(np.abs(floors) >= _EXACT, np.nextafter(floors, -np.inf), floors)
    return np.where(scores == _LONG[0], -np.inf, floors)


def _filled(values: list, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows, with zeros behind the shorter ones."""
    out = np.zeros((len(values), dims), np.int64)
    for i, value in enumerate(values):
        out[i, : len(value)] = value
    return out


def _best(k: int, owner: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k first of each owner, by falling score, then rising id."""
    # The larger of -score and score is the same order, also at the end of the range.
    order = np.lexsort((ids, ~scores, owner))
    owners = owner[order]
    first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def _queries(index: PivotIndex, modulus: int, k: int) -> DataFrame:
    """The query rows with the k-th best score in their own annulus, minus infinity if it has fewer others."""
    dims = index.dims

    def own(batches):
        for batch in batches:
            for number, n, ids, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keys, vectors = np.frombuffer(ids, "<i8"), _unpacked(data, n, dims)
                asked = np.flatnonzero((keys != NO_ID) & (keys % modulus == 0))
                if not len(asked):
                    continue
                floors = np.full(len(asked), -np.inf)
                if n > k:
                    scores = _floors(inner_products(vectors[asked], vectors))
                    scores[np.arange(len(asked)), asked] = -np.inf
                    floors = np.partition(scores, n - k, axis=1)[:, n - k]
                columns = [
                    pa.array(np.full(len(asked), number)),
                    pa.array(asked.astype(np.int32)),
                    pa.array(keys[asked]),
                    pa.array([_packed(v) for v in vectors[asked]], pa.binary()),
                    pa.array(floors),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "position", "id", "vector", "floor"])

    return index.blocks.select("block", "n", "ids", "vectors").mapInArrow(own, QUERY_TYPE)


def _chunks(queries: DataFrame, dims: int, size: int) -> DataFrame:
    """One row for each size queries that are neighbours in the index."""

    def chunks(batches):
        facts: list[tuple] = []
        vectors: list[np.ndarray] = []

        def cut():
            columns = [[len(facts)], [np.array(facts, QUERY).tobytes()], [_packed(np.array(vectors, np.int64).reshape(len(facts), dims))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["n", "queries", "vectors"])

        for batch in batches:
            for number, position, key, data, least in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                facts.append((number, position, key, least))
                vectors.append(_unpacked(data, 1, dims)[0])
                if len(facts) >= size:
                    yield cut()
                    facts, vectors = [], []
        if facts:
            yield cut()

    ordered = queries.repartitionByRange("block", "position").sortWithinPartitions("block", "position")
    return materialize(ordered.mapInArrow(chunks, CHUNK_TYPE).withColumn("chunk", F.monotonically_increasing_id()), "query-chunks")


def _radii(norms: np.ndarray, largest: float, floors: np.ndarray) -> np.ndarray:
    """How far from a query a vector of at most that norm may be to reach the score; below 0 if none can."""
    reached = norms**2 + largest**2 - 2 * floors
    room = 1e-9 * (norms**2 + largest**2 + 2 * np.abs(np.where(np.isfinite(floors), floors, 0))) + 1e-6
    return np.where(reached + room < 0, -1.0, np.sqrt(np.maximum(reached, 0) + room) * (1 + 1e-9) + 1e-6)


def _ranges(index: PivotIndex, chunks: DataFrame) -> DataFrame:
    """(chunk, pivot, low, high, center): disjoint ranges of distances to a pivot that some query of the chunk cannot exclude."""
    points, dims = index.pivots, index.dims
    per_pivot = index.blocks.groupBy("pivot").agg(F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
    known = sorted((r["pivot"], r["far"], r["norm"]) for r in per_pivot)

    def ranges(batches):
        for batch in batches:
            out = []
            for chunk, n, facts, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                floors = np.frombuffer(facts, QUERY)["floor"]
                vectors = _unpacked(data, n, dims).astype(float)
                norms = np.sqrt((vectors**2).sum(1))
                distances = _distances(vectors, points)
                for pivot, far, largest in known:
                    radius, at = _radii(norms, largest, floors), distances[:, pivot]
                    low, high = at - radius, at + radius
                    needed = np.flatnonzero((radius >= 0) & (low <= far))
                    needed = needed[np.argsort(low[needed], kind="stable")]
                    if not len(needed):
                        continue
                    tops = np.maximum.accumulate(high[needed])
                    begins = np.flatnonzero(np.r_[True, low[needed][1:] > tops[:-1]])
                    for a, b in zip(begins, np.r_[begins[1:], len(needed)]):
                        out.append((chunk, pivot, float(low[needed[a]]), float(tops[b - 1]), float(np.median(at[needed[a:b]]))))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "pivot", "low", "high", "center"])

    return chunks.select("chunk", "n", "queries", "vectors").mapInArrow(ranges, "chunk bigint, pivot int, low double, high double, center double")


def top_k(index: PivotIndex, k: int, modulus: int, queries_at_once: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best scores of each indexed row whose id is divisible by modulus, against all other rows.

    A row is never its own result; other rows with the same id or vector are. Ties go to the smaller id, null ids last; a query has fewer
    rows if the index has. Scores outside 64 bits become the nearest number of 64 bits. Queries that are neighbours in the
    index meet an annulus together; an annulus goes only to the tasks whose queries cannot exclude it.
    """
    dims, points = index.dims, index.pivots
    chunks = _chunks(_queries(index, modulus, k), dims, queries_at_once)
    parts = -(-index.blocks.count() // BLOCKS_A_TASK) or 1
    part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")
    facts = index.blocks.select("pivot", "near", "far", "block").withColumn("part", part)
    gap = F.greatest(F.col("near") - F.col("center"), F.col("center") - F.col("far"), F.lit(0.0))
    overlap = (F.col("near") <= F.col("high")) & (F.col("far") >= F.col("low"))
    tiles = _ranges(index, chunks).join(facts, "pivot").where(overlap).groupBy("chunk", "part", "block").agg(F.min(gap).alias("gap"))
    tiles = materialize(tiles, "query-annuli")

    met = tiles.join(index.blocks, "block")
    met = met.select("chunk", "part", "gap", "block", "pivot", "near", "far", "norm", "n", F.col("ids").alias("facts"), "vectors")
    asking = tiles.select("chunk", "part").distinct().join(chunks, "chunk")
    none = F.lit(None)
    # The queries of a task come before the annuli they meet.
    heads = asking.select("chunk", "part", F.lit(-1.0).alias("gap"), none.cast("bigint").alias("block"), none.cast("int").alias("pivot"), none.cast("double").alias("near"), none.cast("double").alias("far"), none.cast("double").alias("norm"), "n", F.col("queries").alias("facts"), "vectors")
    streams = heads.unionByName(met).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "gap", "block")

    def visited(batches):
        meeting = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if row["block"] is None:
                    if meeting is not None:
                        yield meeting.found()
                    meeting = _Meeting(row, points, dims, k)
                else:
                    meeting.meet(row)
        if meeting is not None:
            yield meeting.found()

    found = streams.mapInArrow(visited, "query_block bigint, query_position bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_block", "query_position").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Meeting:
    """Some queries and the best they have found in the annuli they met."""

    def __init__(self, row: dict, points: np.ndarray, dims: int, k: int):
        self.facts = np.frombuffer(row["facts"], QUERY)
        self.vectors = _unpacked(row["vectors"], row["n"], dims)
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        self.distances = _distances(self.vectors.astype(float), points)
        self.floors = self.facts["floor"].copy()
        self.dims, self.k = dims, k
        none = np.zeros(0, np.int64)
        self.owner, self.scores, self.ids = none, none, none

    def meet(self, row: dict) -> None:
        radius = _radii(self.norms, row["norm"], self.floors)
        at = self.distances[:, row["pivot"]]
        needed = np.flatnonzero((radius >= 0) & (at - radius <= row["far"]) & (at + radius >= row["near"]))
        if not len(needed):
            return
        ids, vectors = np.frombuffer(row["facts"], "<i8"), _unpacked(row["vectors"], row["n"], self.dims)
        scores = inner_products(self.vectors[needed], vectors)
        good = scores >= self.floors[needed, None]
        same = np.flatnonzero(self.facts["block"][needed] == row["block"])
        good[same, self.facts["position"][needed[same]]] = False
        at, column = np.nonzero(good)
        if not len(at):
            return
        self.owner = np.concatenate([self.owner, needed[at]])
        self.scores = np.concatenate([self.scores, scores[at, column]])
        self.ids = np.concatenate([self.ids, ids[column]])
        kept = _best(self.k, self.owner, self.scores, self.ids)
        self.owner, self.scores, self.ids = self.owner[kept], self.scores[kept], self.ids[kept]
        full = np.flatnonzero(np.bincount(self.owner, minlength=len(self.facts)) >= self.k)
        last = np.searchsorted(self.owner, full, side="right") - 1
        self.floors[full] = np.maximum(self.floors[full], _floors(self.scores[last]))

    def found(self) -> pa.RecordBatch:
        facts = self.facts[self.owner]
        columns = [pa.array(facts["block"]), pa.array(facts["position"]), pa.array(facts["id"]), pa.array(self.ids, mask=self.ids == NO_ID), pa.array(self.scores)]
        return pa.RecordBatch.from_arrays(columns, schema=FOUND)
