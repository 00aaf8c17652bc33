"""Connected components of an edge table, by minimum labels that are passed along and shortened."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.shared import materialize, release

#: Edges that a task looks at together.
EDGES_AT_ONCE = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id (a whole number) in the edge table (a, b): root is the least id of its component.

    Tasks first join what the edges they hold connect. Then large-star and small-star rounds: each node links its larger neighbours, then its smaller
    ones and itself, to the least of them, until the edges are stars, which one grouping by node tells; edges that are stars from the start take no
    round. The edges of each half round are written to the shared folder, so plans and lineage stay short.
    """
    proper = edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    current = materialize(_contracted(proper).distinct(), "edges")
    while not _stars_alone(current):
        links = materialize(_contracted(_larger_linked(current)), "edges")
        release(current)
        current = materialize(_smaller_linked(links), "edges")
        release(links)
    return current.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def _with_least(both: DataFrame) -> DataFrame:
    """The edges (a, b) with m, the least of a and its neighbours."""
    return both.join(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "a")


def _larger_linked(current: DataFrame) -> DataFrame:
    both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smaller_linked(links: DataFrame) -> DataFrame:
    """links: each with the larger id as a."""
    least = links.groupBy("a").agg(F.min("b").alias("b"))
    others = links.join(least.withColumnRenamed("b", "m"), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least).distinct()


def _stars_alone(current: DataFrame) -> bool:
    """Whether each id is linked to one smaller id at most, and to none if others are linked to it; current: different edges, the larger id as a."""
    sides = current.select(F.col("a").alias("id"), F.lit(1).alias("up")).union(current.select(F.col("b").alias("id"), F.lit(0).alias("up")))
    per_id = sides.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return per_id.where((F.col("ups") > 1) | (F.col("ups") > F.col("least"))).agg(F.count(F.lit(1))).first()[0] == 0


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same ids: each id that a task meets linked to the least one that the task's edges join it to."""

    def linked(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES_AT_ONCE:
                yield _joined(held)
                held, size = [], 0
        if size:
            yield _joined(held)

    return edges.mapInArrow(linked, "a bigint, b bigint")


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([batch.column(side).to_numpy() for batch in batches]) for side in (0, 1))
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = places[: len(a)], places[len(a) :]
    root = np.arange(len(ids))
    while True:
        one, other = root[one], root[other]
        apart = one != other
        one, other = one[apart], other[apart]
        if not len(one):
            break
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while not np.array_equal(further := root[root], root):
            root = further
    at = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])
