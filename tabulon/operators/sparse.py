"""Feature vectors as lists of their stored entries, and sums over them that tasks make with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of up to so many dimensions are held as full lines, which numpy adds up faster than entries.
DENSE_DIMENSIONS = 64
#: The columns of a block of vectors.
BLOCK = {"size": pa.int32(), "lengths": pa.binary(), "places": pa.binary(), "numbers": pa.binary()}

def stored_entries(vector: str = "features") -> tuple[Column, Column]:
    """(indices, values) of a vector column; a dense vector has no indices."""
    stored = F.unwrap_udt(vector)
    return stored["indices"].alias("indices"), stored["values"].alias("values")


def dimensions(df: DataFrame, vector: str = "features") -> int:
    """The length of the vectors, 0 without rows; read from one of them."""
    first = df.select(vector).first()
    return 0 if first is None else first[0].size


@dataclass(frozen=True)
class Rows:
    """Some vectors: up to DENSE_DIMENSIONS a line of numbers per dimension, otherwise their entries end to end and where each begins.

    Lines are added up one dimension after the other, so what a vector gives does not depend on those beside it.
    """

    norms: np.ndarray
    lines: np.ndarray | None = None
    starts: np.ndarray | None = None
    indices: np.ndarray | None = None
    values: np.ndarray | None = None

    @classmethod
    def of(cls, indices: pa.Array, values: pa.Array, dims: int) -> Rows:
        """From lists of places and numbers; without places the numbers are those of all dimensions."""
        lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        listed, places = indices.is_valid().to_numpy(zero_copy_only=False), indices.flatten().to_numpy(zero_copy_only=False)
        if not listed.all():
            every = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            every[np.repeat(listed, lengths)] = places
            places = every
        return cls._made(lengths, places, values.flatten().to_numpy(zero_copy_only=False), dims)

    @classmethod
    def _made(cls, lengths: np.ndarray, indices: np.ndarray, values: np.ndarray, dims: int) -> Rows:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        if dims <= DENSE_DIMENSIONS:
            lines = np.zeros((dims, len(lengths)))
            lines[indices, owner] = values
            return cls._of_lines(lines)
        return cls(np.bincount(owner, weights=values * values, minlength=len(lengths)), None, np.cumsum(lengths) - lengths, indices, values)

    @classmethod
    def _of_lines(cls, lines: np.ndarray) -> Rows:
        norms = np.zeros(lines.shape[1])
        for line in lines:
            norms += line * line
        return cls(norms, lines)

    @classmethod
    def unpacked(cls, block: dict, dims: int) -> Rows:
        """The vectors of a row of packed()."""
        numbers = np.frombuffer(block["numbers"], np.float64)
        if dims <= DENSE_DIMENSIONS:
            return cls._of_lines(numbers.reshape(dims, block["size"]))
        return cls._made(np.frombuffer(block["lengths"], np.int32), np.frombuffer(block["places"], np.int32), numbers, dims)

    def packed(self) -> dict:
        if self.lines is not None:
            return {"size": len(self), "lengths": None, "places": None, "numbers": self.lines.tobytes()}
        places, lengths = self.indices.astype(np.int32).tobytes(), self._lengths.astype(np.int32).tobytes()
        return {"size": len(self), "lengths": lengths, "places": places, "numbers": np.asarray(self.values, np.float64).tobytes()}

    def __len__(self) -> int:
        return len(self.norms)

    @property
    def _lengths(self) -> np.ndarray:
        return np.diff(np.r_[self.starts, len(self.values)])

    @property
    def _owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self._lengths)

    def entries(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and numbers of a vector."""
        if self.lines is not None:
            places = np.flatnonzero(self.lines[:, row])
            return places, self.lines[places, row]
        part = slice(self.starts[row], self.starts[row] + self._lengths[row])
        return self.indices[part], self.values[part]

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The products with each row of a dense matrix: one line per row of the matrix, a column per vector."""
        out = np.zeros((len(matrix), len(self)))
        if self.lines is not None:
            term = np.empty(len(self))
            for product, weights in zip(out, matrix):
                for line, weight in zip(self.lines, weights):
                    np.multiply(line, weight, out=term)
                    product += term
            return out
        filled = np.flatnonzero(self._lengths)
        if len(filled):
            out[:, filled] = np.add.reduceat(matrix[:, self.indices] * self.values, self.starts[filled], axis=1)
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distances, a line per point."""
        out = self.times(points)
        out *= -2
        out += self.norms
        out += (points * points).sum(1)[:, None]
        return np.maximum(out, 0.0, out=out)

    def sums(self, group: np.ndarray, groups: int, dims: int) -> np.ndarray:
        """The sum of the vectors of each group."""
        if self.lines is not None:
            return np.stack([np.bincount(group, weights=line, minlength=groups) for line in self.lines], axis=1) if dims else np.zeros((groups, 0))
        return np.bincount(group[self._owner] * dims + self.indices, weights=self.values, minlength=groups * dims).reshape(groups, dims)

    def weighted(self, weights: np.ndarray, dims: int) -> np.ndarray:
        """For each line of weights the sum of the vectors times their weight."""
        if self.lines is not None:
            return np.array([[float((line * w).sum()) for line in self.lines] for w in weights])
        owner = self._owner
        return np.stack([np.bincount(self.indices, weights=self.values * w[owner], minlength=dims) for w in weights])


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest point, the first of equals, and its distance, from a line of distances per point."""
    least, label = distances[0].copy(), np.zeros(distances.shape[1], np.int64)
    for number in range(1, len(distances)):
        label[distances[number] < least] = number
        np.minimum(least, distances[number], out=least)
    return label, least


def packed(df: DataFrame, dims: int, more: Sequence[Column] = ()) -> DataFrame:
    """Blocks of the vectors in the column features, at most an Arrow batch in each, that tasks read without a step per row.

    Of the named columns more, the block has lists under their own names.
    """
    rows = df.select(*stored_entries(), *more)
    listed = rows.schema.fields[2:]

    def blocks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block = {name: pa.array([value], kind) for (name, value), kind in zip(Rows.of(batch.column(0), batch.column(1), dims).packed().items(), BLOCK.values(), strict=True)}
            block |= {f.name: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(i + 2)) for i, f in enumerate(listed)}
            yield pa.RecordBatch.from_arrays(list(block.values()), names=list(block))

    columns = [T.StructField("size", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in list(BLOCK)[1:]]]
    return rows.mapInArrow(blocks, T.StructType([*columns, *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in listed]]))


def blocks_of(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[Rows, dict[str, pa.Array]]]:
    """The vectors of each block and its lists, inside a task."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = {name: batch.column(n)[i].as_buffer() if batch.column(n)[i].is_valid else None for n, name in enumerate(batch.schema.names) if name in BLOCK and name != "size"}
            block["size"] = batch.column(batch.schema.names.index("size"))[i].as_py()
            lists = {name: batch.column(n)[i].values for n, name in enumerate(batch.schema.names) if name not in BLOCK}
            yield Rows.unpacked(block, dims), lists


def summed(parts: DataFrame, keys: list[str], value: str) -> np.ndarray:
    """The rows (keys, value) of all tasks, added up per key: an array with the keys and the sum in each line."""
    table = parts.groupBy(*keys).agg(F.sum(value).alias(value)).toArrow()
    return np.stack([table.column(c).to_numpy().astype(float) for c in (*keys, value)], axis=1) if table.num_rows else np.zeros((0, len(keys) + 1))


def entries_of(matrix: np.ndarray, names: tuple[str, str, str]) -> pa.RecordBatch:
    """The entries of a matrix that are not 0 as rows (line, place, value)."""
    line, place = np.nonzero(matrix)
    return pa.RecordBatch.from_arrays([pa.array(line, pa.int32()), pa.array(place, pa.int32()), pa.array(matrix[line, place])], names=list(names))


def with_numbers(df: DataFrame, dims: int, fields: Sequence[T.StructField], numbers: Callable[[Rows], Sequence[np.ndarray]]) -> DataFrame:
    """The rows with further columns that numbers makes of their vectors, in the column features; columns of those names are replaced.

    All columns pass through the tasks' Python: leave out before what is not wanted after.
    """
    rows = df.drop(*[f.name for f in fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    place = rows.columns.index("features")

    def added(batches):
        for batch in batches:
            vectors = batch.column(place)
            found = numbers(Rows.of(vectors.field("indices"), vectors.field("values"), dims))
            columns = [*batch.columns, *[pa.array(n, k) for n, k in zip(found, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[f.name for f in fields]])

    return rows.mapInArrow(added, T.StructType([*rows.schema.fields, *fields]))
