"""Packing by powers of two: every piece of a document has a binary length and is a sequence of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.encoding import default_vocabulary, encode, id_bytes

MAX_LENGTH = 2048
END_ID = 1
ROWS_PER_BATCH = 4096


def binary_pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many longest ones as fit, then the binary digits of the rest."""
    start = 0
    while start < n:
        length = min(longest, 1 << ((n - start).bit_length() - 1))
        yield start, length
        start += length


def pack(df: DataFrame, doc_id: str, text: str, vocabulary: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, start, length, bucket, ids, doc_tokens, sequence_id, offset): one row per piece and sequence.

    A document is the ids of its whole text and then END_ID, so a null or empty text is one piece of length 1. Pieces
    have lengths of powers of two up to longest; bucket is the exponent. A sequence holds one piece: it never
    crosses documents, needs no padding, and offset is 0. ids are little-endian unsigned 32-bit numbers. Sequence ids are
    unique, end in the bucket, and stay the same for the same input files. Equal rows are packed each; no shuffle.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    path = vocabulary or default_vocabulary()
    id_type = pa.string() if df.schema[doc_id].dataType.typeName() == "string" else pa.int64()
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def pieces(batches):
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(path, value.as_py())
                ids.append(END_ID)
                data = id_bytes(ids)
                for start, length in binary_pieces(len(ids), longest):
                    rows.append((key, start, length, length.bit_length() - 1, data[4 * start : 4 * (start + length)], len(ids)))
                size += len(data)
                if len(rows) >= ROWS_PER_BATCH or size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    key = F.col(doc_id).cast("string" if id_type == pa.string() else "bigint").alias("doc_id")
    packed = df.select(key, F.col(text).alias("text")).mapInArrow(
        pieces, f"doc_id {'string' if id_type == pa.string() else 'bigint'}, start bigint, length bigint, bucket int, ids binary, doc_tokens bigint"
    )
    buckets = 32
    return packed.withColumn("sequence_id", F.monotonically_increasing_id() * buckets + F.col("bucket")).withColumn(
        "offset", F.lit(0).cast("bigint")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder of files per length, for batches of equal shape."""
    pieces.write.partitionBy("bucket").parquet(path)
